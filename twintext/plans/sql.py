"""DuckDB SQL of the queries over the test tables."""

from __future__ import annotations

from twintext.functions import text as T
from twintext.plans.queries import RATES, TODAY



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normal(x: str) -> str:
    kept, soft = T.VARIANTS[:-1], T.VARIANTS[-1]
    folded = f"replace(replace(translate(nfc_normalize({x}), {_quoted(kept)}, {_quoted(T.CANONICAL)}), '{soft}', ''), '…', '...')"
    return f"regexp_replace(regexp_replace({folded}, {_quoted(T.SPACE)} || '+', ' ', 'g'), '^ | $', '', 'g')"


def words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, {_quoted(T.SEPARATOR)} || '+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')))"


LINES = """lines AS (
  SELECT doc_id, lang, source, (i - 1)::INT AS ord, line FROM (
    SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE trim(line, ' ') <> '')"""
HASHED = f"{LINES}, hashed AS (SELECT *, sha256(plain) AS hash FROM (SELECT *, {normal('line')} AS plain FROM lines))"
MEMORY = f"""memory AS (
  SELECT *, sha256(plain) AS hash FROM (
    SELECT item_id AS tu_id, 'en' AS lang, {normal('text')} AS plain, 1 AS priority, 3 AS quality, '2024-01-01' AS updated_at FROM benchmark
    UNION ALL
    SELECT doc_id * 100000 + ord + 1000000, lang, {normal('line')}, 2, (doc_id % 5)::INT, '2024-02-01' FROM lines
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)))"""
TURNS = """turns AS (
  SELECT * FROM (SELECT conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS target FROM conversations)
  WHERE target IS NOT NULL)"""


VERSIONS = """ours AS (SELECT o_orderkey, (o_orderkey % 4)::INT AS rev, strftime(o_orderdate, '%Y-%m-%d') AS updated_at, o_orderpriority AS plain, (o_custkey % 5)::INT AS quality, o_orderkey % 7 AS usage_count FROM orders WHERE o_orderkey % 3 <> 0),
theirs AS (SELECT o_orderkey, (o_orderkey % 5)::INT AS rev, strftime(o_orderdate, '%Y-%m-%d') AS updated_at, o_orderpriority || '!' AS plain, (o_custkey % 4)::INT AS quality, o_orderkey % 5 AS usage_count FROM orders WHERE o_orderkey % 4 <> 1)"""

_BODY = r"regexp_replace({x}, '^[\t-\r ]*[0-9A-Za-z]{{1,2}}\)', '')"
_CLOSERS = r"""[\t-\r "''“”‘’«»‹›)\]}]+$"""


def _n(x: str, mark: str) -> str:
    return f"(length({x}) - length(replace({x}, {_quoted(mark)}, '')))"


def _imbalances(x: str) -> str:
    body = _BODY.format(x=x)
    parts = [f"CASE WHEN {_n(body, a)} <> {_n(body, b)} THEN '{a}{b}' || {_n(body, a)} || 'x' || {_n(body, b)} END" for a, b in (("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"))]
    parts += [f"CASE WHEN ({' + '.join(_n(body, m) for m in marks)}) % 2 <> 0 THEN {_quoted(marks[0])} || ({' + '.join(_n(body, m) for m in marks)}) END" for marks in ('"', "“”„")]
    return "[" + ", ".join(parts) + "]"


def _terminal(x: str) -> str:
    return f"regexp_matches(regexp_replace({x}, {_quoted(_CLOSERS.replace(chr(39) * 2, chr(39)))}, ''), '[.!?…]$')"


_SP = "[ \u00a0\u202f\u2009]"
LINE_PAIRS = f"""{LINES}, line_pairs AS (
  SELECT * FROM (SELECT doc_id, ord, line AS source, lead(line) OVER (PARTITION BY doc_id ORDER BY ord) AS target FROM lines) WHERE target IS NOT NULL)"""
QA = f"""{LINE_PAIRS}, issues AS (
  SELECT doc_id, ord, 'seg.empty' AS rule, 'error' AS severity FROM line_pairs WHERE trim(target, ' ') = ''
  UNION ALL SELECT doc_id, ord, 'seg.untranslated', 'warning' FROM line_pairs WHERE source = target AND regexp_matches(source, '\\p{{L}}')
  UNION ALL SELECT doc_id, ord, 'punct.terminal', 'info' FROM line_pairs WHERE trim(target, ' ') <> '' AND {_terminal('source')} <> {_terminal('target')}
  UNION ALL SELECT doc_id, ord, 'punct.brackets', 'warning' FROM line_pairs
    WHERE len(list_filter({_imbalances('target')}, lambda i: i IS NOT NULL AND NOT coalesce(list_contains({_imbalances('source')}, i), FALSE))) > 0
  UNION ALL SELECT doc_id, ord, 'punct.spacing', 'info' FROM line_pairs
    WHERE trim(target, ' ') <> '' AND (regexp_matches(target, '{_SP}{{2,}}') OR regexp_matches(target, '{_SP}[,;:]') OR regexp_matches(target, '{_SP}\\.([^.]|$)')))"""

DECISIONS = """decisions AS (
  SELECT *, string_split_regex(lower(lang), '[-_]')[1] AS primary_lang FROM (
    SELECT event_id AS id, user_id % 40 AS term_id, CASE event_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN 'de-AT' ELSE 'fr_CA' END AS lang, 'r' || (event_id % 5) AS chosen,
           CASE WHEN event_id % 40 = 0 THEN 'deprecation' WHEN event_id % 30 = 1 THEN 'choice' WHEN event_id % 30 = 7 THEN 'override' ELSE 'segment_exception' END AS kind,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS decided_at, CASE WHEN event_id % 11 <> 0 THEN event_type END AS project, user_id AS segment FROM events)),
variants AS (SELECT *, variant_id % 4 = 0 AS forbidden FROM (SELECT term_id, lang, primary_lang, chosen AS plain, min(id) AS variant_id FROM decisions GROUP BY ALL)),
rulings AS (SELECT term_id, primary_lang, chosen, max(decided_at) AS decided_at, max(id) AS id FROM decisions WHERE kind NOT IN ('deprecation', 'segment_exception') GROUP BY ALL),
preferred AS (SELECT * FROM (
  SELECT v.*, r.decided_at, row_number() OVER (PARTITION BY v.term_id, v.primary_lang ORDER BY r.decided_at DESC NULLS LAST, r.id DESC NULLS LAST, v.variant_id) AS place
  FROM variants v LEFT JOIN rulings r ON r.term_id = v.term_id AND r.primary_lang = v.primary_lang AND r.chosen = v.plain WHERE NOT forbidden) WHERE place = 1)"""
_FLAGS = """keys AS (SELECT DISTINCT user_id % 200 AS term_key FROM events),
entries AS (SELECT term_key, CASE WHEN term_key % 2 = 0 THEN 'click' ELSE 'view' END AS preferred FROM keys WHERE term_key % 5 = 0),
renderings AS (SELECT user_id % 200 AS term_key, CASE WHEN user_id % 200 % 3 = 0 THEN 'click' ELSE event_type END AS rendering, max(value / 500) AS confidence FROM events WHERE user_id % 7 <> 0 GROUP BY 1, 2)"""


def _xml(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"


_TIER = "CASE WHEN p = 0 THEN 'exact' WHEN p <= 2 THEN 'fuzzy_95_99' WHEN p <= 4 THEN 'fuzzy_85_94' WHEN p <= 6 THEN 'fuzzy_75_84' ELSE 'no_match' END"

SQL = {
    "normalize_hash": f"SELECT doc_id, length(plain)::BIGINT AS n, sha256(plain) AS hash FROM (SELECT doc_id, {normal('text')} AS plain FROM documents)",
    "word_counts": f"SELECT doc_id, {words('text')}::BIGINT AS words, regexp_replace(lower(lang), '[-_].*', '') NOT IN {T.UNSPACED} AS spaced FROM documents",
    "repetition_analysis": f"""WITH {HASHED}, n AS (SELECT *, {words('line')} AS words, row_number() OVER (PARTITION BY hash ORDER BY doc_id, ord) = 1 AS first FROM hashed)
SELECT source, count(*) AS segments, sum(words)::BIGINT AS words, count(*) FILTER (NOT first) AS repeated, coalesce(sum(words) FILTER (NOT first), 0)::BIGINT AS repeated_words FROM n GROUP BY source""",
    "exact_match": f"""WITH {HASHED}, {MEMORY}, best AS (SELECT *, row_number() OVER (PARTITION BY hash, lang ORDER BY priority, quality DESC, updated_at DESC, tu_id) AS r FROM memory)
SELECT doc_id, ord, tu_id, priority, quality FROM hashed JOIN best USING (hash, lang) WHERE r = 1""",
    "propagation": f"""WITH {HASHED}, donors AS (SELECT hash, lang, doc_id AS donor_doc_id, ord AS donor_ord, row_number() OVER (PARTITION BY hash, lang ORDER BY doc_id, ord) AS r FROM hashed WHERE doc_id % 3 = 0)
SELECT doc_id, ord, donor_doc_id, donor_ord FROM hashed JOIN donors USING (hash, lang) WHERE r = 1 AND doc_id % 3 <> 0""",
    "segment_context": f"WITH {HASHED} SELECT doc_id, ord, hash, lag(hash) OVER w AS prev_hash, lead(hash) OVER w AS next_hash FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY ord)",
    "context_match": f"""WITH {HASHED}, c AS (SELECT doc_id, ord, hash, lag(hash) OVER w AS p, lead(hash) OVER w AS n FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT a.doc_id, a.ord, min(b.doc_id * 100000 + b.ord) AS tu_id FROM c a JOIN c b ON a.hash = b.hash AND a.p IS NOT DISTINCT FROM b.p AND a.n IS NOT DISTINCT FROM b.n WHERE b.doc_id % 2 = 0 GROUP BY 1, 2""",
    "ambiguous_siblings": f"""WITH {HASHED}, g AS (SELECT *, length(line) % 3 AS unit_group FROM hashed WHERE length(line) < 200)
SELECT * FROM (SELECT doc_id, ord, count(*) OVER (PARTITION BY doc_id, unit_group, hash) AS n FROM g) WHERE n > 1""",
    "concordance": f"""WITH {LINES}, hits AS (SELECT doc_id, ord FROM lines WHERE contains(' ' || lower(strip_accents(array_to_string(regexp_extract_all(line, '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), ' '))) || ' ', ' the ')),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC, ord DESC)::INT AS rank, (SELECT count(*) FROM hits) > 50 AS more FROM hits)
SELECT doc_id, ord, rank, more FROM ranked WHERE rank <= 50""",
    "term_document_frequency": """SELECT term, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(strip_accents(array_to_string(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}]+'), ' '))), ' ')) AS term FROM documents)
WHERE term <> '' GROUP BY term""",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS dot FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(dot, 4) AS dot, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    # A forbidden plural lies inside a span of the term unless an ending follows it.
    "term_mismatch": f"""WITH {TURNS}, w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM benchmark),
terms AS (SELECT term FROM w GROUP BY term HAVING count(*) >= 2),
t AS (SELECT conv_id, turn, lower(source) AS s, lower(target) AS x FROM turns WHERE trim(target, ' ') <> ''),
met AS (SELECT * FROM t, terms WHERE contains(s, term) AND regexp_matches(s, '(^|[^\\p{{L}}\\p{{N}}])' || term || '(s|es)?($|[^\\p{{L}}\\p{{N}}])')),
k AS (SELECT DISTINCT conv_id, turn, term, regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}])' || term || 'ed(s|es)?($|[^\\p{{L}}\\p{{N}}])') AS used,
  CASE WHEN regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}])' || term || 's(s|es)($|[^\\p{{L}}\\p{{N}}])') THEN 'forbidden'
  WHEN NOT regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}])' || term || '(s|es)?($|[^\\p{{L}}\\p{{N}}])') THEN 'missing_preferred' END AS kind FROM met)
SELECT conv_id, turn, term, kind, CASE WHEN kind = 'forbidden' THEN term || 's' WHEN used THEN term || 'ed' END AS found FROM k WHERE kind IS NOT NULL""",
    "unembedded": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "memory_merge": f"""WITH {VERSIONS}, j AS (
  SELECT coalesce(o.o_orderkey, t.o_orderkey) AS o_orderkey, o.o_orderkey IS NOT NULL AS ho, t.o_orderkey IS NOT NULL AS ht,
         o.rev AS orev, t.rev AS trev, o.updated_at AS oat, t.updated_at AS tat, o.plain AS op, t.plain AS tp, o.quality AS oq, t.quality AS tq, o.usage_count AS ou, t.usage_count AS tu
  FROM ours o FULL JOIN theirs t ON o.o_orderkey = t.o_orderkey),
w AS (SELECT *, NOT ho OR (ht AND (trev > orev OR (trev = orev AND (tat > oat OR (tat = oat AND (tp > op OR (tp = op AND tq > oq))))))) AS theirs_win FROM j)
SELECT o_orderkey, CASE WHEN theirs_win THEN trev ELSE orev END + CASE WHEN ho AND ht AND orev = trev AND (op <> tp OR oq <> tq) THEN 1 ELSE 0 END AS rev,
       CASE WHEN theirs_win THEN tat ELSE oat END AS updated_at, CASE WHEN theirs_win THEN tp ELSE op END AS plain, CASE WHEN theirs_win THEN tq ELSE oq END AS quality,
       greatest(ou, tu) AS usage_count, CASE WHEN theirs_win THEN 'theirs' ELSE 'ours' END AS source FROM w""",
    "write_back_upsert": f"""WITH {VERSIONS}, c AS (SELECT * FROM theirs WHERE o_orderkey % 7 = 0)
SELECT coalesce(o.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(c.plain, o.plain) AS plain, greatest(o.quality, c.quality) AS quality, coalesce(c.updated_at, o.updated_at) AS updated_at,
       coalesce(o.rev, 0) + (c.o_orderkey IS NOT NULL)::INT AS rev FROM ours o FULL JOIN c ON o.o_orderkey = c.o_orderkey""",
    "memory_languages": "SELECT lang, count(DISTINCT doc_id) AS units, count(*) AS variants FROM documents GROUP BY lang",
    "qa_issues": f"WITH {QA} SELECT doc_id, ord, rule, severity FROM issues",
    "qa_marks": f"""WITH {QA} SELECT doc_id, ord, CASE max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS worst, count(*) AS n FROM issues GROUP BY doc_id, ord""",
    "qa_rule_counts": f"WITH {QA} SELECT rule, count(*) FILTER (doc_id % 2 <> 0) AS open, count(*) FILTER (doc_id % 2 = 0) AS dismissed FROM issues GROUP BY rule",
    "qa_consistency": f"""WITH {LINE_PAIRS}, t AS (SELECT doc_id, ord, lower(source) AS source, lower(target) AS target FROM line_pairs)
SELECT doc_id, ord, 'consistency.target_differs' AS rule FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.source = t.source AND u.target <> t.target)
UNION ALL SELECT doc_id, ord, 'consistency.source_differs' FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.target = t.target AND u.source <> t.source)""",
    "preferred_variant": f"WITH {DECISIONS} SELECT term_id, primary_lang AS lang, variant_id, plain, decided_at FROM preferred",
    "exception_proposals": f"""WITH {DECISIONS}
SELECT d.term_id, d.lang, d.chosen, p.plain AS preferred, count(DISTINCT d.project || chr(31) || d.segment) AS segments
FROM decisions d JOIN variants v ON v.term_id = d.term_id AND v.lang = d.lang AND v.plain = d.chosen AND NOT v.forbidden
JOIN preferred p ON p.term_id = d.term_id AND p.primary_lang = d.primary_lang AND p.variant_id <> v.variant_id
WHERE d.kind = 'segment_exception' AND d.project IS NOT NULL AND d.segment IS NOT NULL AND d.term_id % 13 <> 0
  AND d.id > coalesce((SELECT max(r.id) FROM decisions r WHERE r.term_id = d.term_id AND r.primary_lang = d.primary_lang AND r.kind <> 'segment_exception'), 0)
GROUP BY ALL HAVING segments >= 3""",
    "flag_terms": f"""WITH {_FLAGS}, g AS (
  SELECT r.term_key, count(*) AS renderings, max(confidence) AS confidence, coalesce(bool_or(rendering <> preferred), FALSE) AS other FROM renderings r LEFT JOIN entries USING (term_key) GROUP BY r.term_key)
SELECT term_key, renderings, concat_ws(',', CASE WHEN renderings >= 2 THEN 'inconsistent' WHEN confidence < 0.7 THEN 'uncertain' END, CASE WHEN other THEN 'glossary_mismatch' END) AS reasons
FROM g WHERE renderings >= 2 OR confidence < 0.7 OR other""",
    "flag_unaligned": f"WITH {_FLAGS} SELECT term_key, 0::BIGINT AS renderings, 'unaligned' AS reasons FROM keys WHERE term_key NOT IN (SELECT term_key FROM entries)",
    "changed_words": f"""WITH {HASHED}, known AS (SELECT DISTINCT hash FROM hashed WHERE doc_id % 2 = 0), n AS (SELECT source AS file, hash, {words('line')} AS words FROM hashed WHERE doc_id % 2 = 1)
SELECT file, sum(words)::BIGINT AS words, coalesce(sum(words) FILTER (hash NOT IN (SELECT hash FROM known)), 0)::BIGINT AS changed FROM n GROUP BY file""",
    "client_rates": """WITH n AS (SELECT n_nationkey AS pair, n_nationkey * 0.01::DOUBLE AS rate, n_regionkey * 5.0::DOUBLE AS minimum FROM nation),
o AS (SELECT c_nationkey AS pair, round(avg(c_acctbal) / 10000, 4) AS rate, NULL::DOUBLE AS minimum FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT coalesce(o.pair, n.pair) AS pair, CASE WHEN o.pair IS NULL THEN n.rate ELSE o.rate END AS rate, CASE WHEN o.pair IS NULL THEN n.minimum ELSE o.minimum END AS minimum, o.pair IS NOT NULL AS own FROM n FULL JOIN o ON n.pair = o.pair""",
    "order_estimate": """WITH l AS (SELECT l_orderkey AS order_id, l_linestatus AS tgt_lang, floor(l_quantity * 10)::BIGINT AS w FROM lineitem),
s AS (SELECT order_id, tgt_lang, sum(CASE WHEN w = 0 THEN 0 WHEN tgt_lang = 'O' THEN greatest(w, 100) ELSE w END)::BIGINT AS words FROM l GROUP BY 1, 2)
SELECT order_id, tgt_lang, words, round(CASE tgt_lang WHEN 'O' THEN greatest(words * 0.12::DOUBLE, 40) ELSE greatest(words * 0.09::DOUBLE, 0) END, 4) AS price FROM s""",
    "deadline_agenda": f"""SELECT o_orderkey, status, CASE WHEN due IS NULL THEN 'undated' WHEN due < DATE '{TODAY}' THEN 'overdue' WHEN due = DATE '{TODAY}' THEN 'today' ELSE 'later' END AS bucket
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'F' THEN 'delivered' ELSE 'in_progress' END AS status, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS due FROM orders) WHERE status <> 'delivered'""",
    "notices_due": f"""SELECT job_id, lead_hours, strftime(due - to_hours(lead_hours), '%Y-%m-%d %H:%M:%S') AS notice_at FROM (SELECT o_orderkey AS job_id, o_orderdate AS due FROM orders), (VALUES (24), (72)) v(lead_hours)
WHERE due - to_hours(lead_hours) <= TIMESTAMP '{TODAY} 00:00:00' AND due - to_hours(lead_hours) >= due - INTERVAL 2 DAY AND NOT (job_id % 5 = 0 AND lead_hours = 24)""",
    "tier_payable": f"""WITH l AS (SELECT l_suppkey AS vendor_id, {_TIER} AS tier, l_quantity::BIGINT AS words FROM (SELECT *, round(l_discount * 100) AS p FROM lineitem)),
rates(tier, micros) AS (VALUES {', '.join(str(r) for r in RATES)}), t AS (SELECT vendor_id, l.tier, sum(words)::BIGINT AS words, any_value(micros) AS micros FROM l LEFT JOIN rates r ON r.tier = l.tier GROUP BY 1, 2)
SELECT vendor_id, sum(words)::BIGINT AS words, sum(words * coalesce(micros, 0))::BIGINT AS micros_due, coalesce(sum(words) FILTER (micros IS NULL), 0)::BIGINT AS unpriced_words,
string_agg(tier, ',' ORDER BY list_position({list(T.TIERS)}, tier)) AS tiers FROM t GROUP BY vendor_id""",
    "currency_totals": """WITH p AS (SELECT CASE WHEN n_regionkey <> 3 THEN 'C' || n_regionkey END AS currency, CASE WHEN l_tax > 0.01 THEN round(l_extendedprice * 100)::BIGINT * 10000 END AS micros, l_returnflag = 'R' AS paid
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT currency, count(*) AS n, sum(CASE WHEN paid THEN micros ELSE 0 END)::BIGINT AS paid, sum(micros - CASE WHEN paid THEN micros ELSE 0 END)::BIGINT AS unpaid, sum(micros)::BIGINT AS total, count(*) FILTER (micros IS NULL) AS incomplete FROM p GROUP BY currency""",
    "vendor_record": """WITH a AS (SELECT l_suppkey AS vendor_id, CASE WHEN l_returnflag = 'R' THEN 'declined' WHEN l_linestatus = 'F' THEN 'delivered' ELSE 'accepted' END AS status, o_orderdate + INTERVAL 30 DAY AS deadline, l_shipdate AS given FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT vendor_id, count(*) AS answered, count(*) FILTER (status <> 'declined') AS accepted, count(*) FILTER (status = 'delivered') AS delivered, count(*) FILTER (status = 'delivered') AS timed, count(*) FILTER (status = 'delivered' AND given <= deadline) AS on_time FROM a GROUP BY vendor_id""",
    "eligibility": """SELECT s_suppkey, r_name, array_to_string(list_filter([CASE WHEN s_nationkey % 5 <> r_regionkey THEN 'language_pair' END, CASE WHEN s_suppkey % 3 = 0 THEN 'specialty' END,
CASE WHEN s_acctbal >= 0 AND s_acctbal < 3000 THEN 'busy' END, CASE WHEN s_acctbal < 0 THEN 'away' END, CASE WHEN s_suppkey % 7 = 0 THEN 'not_in_client_pool' END], lambda x: x IS NOT NULL), ',') AS reasons FROM supplier, region""",
    "status_counts": """SELECT p.o_orderpriority, s.o_orderstatus, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN (VALUES ('O'), ('F'), ('P'), ('X')) s(o_orderstatus)
LEFT JOIN orders o ON o.o_orderpriority = p.o_orderpriority AND o.o_orderstatus = s.o_orderstatus GROUP BY 1, 2""",
    "illegal_transitions": """WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'approved' WHEN 'signup' THEN 'in_progress' WHEN 'purchase' THEN 'delivered' ELSE 'cancelled' END AS state FROM events)
SELECT event_id, from_state, state AS to_state FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM e)
WHERE from_state IS NOT NULL AND from_state <> state AND NOT (state = 'cancelled' AND from_state IN ('submitted', 'approved', 'in_progress'))
AND (from_state, state) NOT IN (('submitted', 'approved'), ('approved', 'in_progress'), ('in_progress', 'delivered'))""",
    "progress": f"""WITH {LINES}, n AS (SELECT source, {words('line')} AS words, doc_id % 3 = 0 AS done FROM lines WHERE doc_id % 10 <> 9)
SELECT source, count(*) FILTER (done) AS confirmed, count(*) AS segments, coalesce(sum(words) FILTER (done), 0)::BIGINT AS confirmed_words, sum(words)::BIGINT AS words FROM n GROUP BY source""",
    "next_open": f"""WITH {LINES} SELECT doc_id, ord, min(CASE WHEN (doc_id + ord) % 3 = 0 THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_open FROM lines""",
    "payment_ledger": "SELECT event_id % 1000 AS assignment_id, arg_max(event_type, event_id) AS kind, max(event_id) AS event_id FROM events GROUP BY 1",
    "membership_union": "SELECT c_nationkey AS tenant, c_name AS member, 'client' AS role FROM customer UNION ALL SELECT s_nationkey, s_name, 'vendor' FROM supplier",
    "fold_export": f"""WITH {LINES} SELECT doc_id, sha256(string_agg(CASE WHEN ord % 2 = 0 THEN '[' || line || ']' ELSE line END, ' ' ORDER BY ord)) AS text_hash, count(*) FILTER (ord % 2 = 0) AS translated, count(*) AS segments FROM lines GROUP BY doc_id""",
    "find_replace": f"""WITH {LINES} SELECT doc_id, ord, len(regexp_extract_all(line, 'the')) AS n, sha256(replace(line, 'the', 'THE')) AS replaced FROM lines WHERE contains(line, 'the')""",
    "grid_filter": f"WITH {LINES} SELECT source, count(*) AS shown FROM lines WHERE contains(lower(line), 'tion') AND length(line) > 40 GROUP BY source",
    "csv_cells": """SELECT doc_id, sha256(CASE WHEN regexp_matches(t, '[",\\r\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END) AS cell
FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS t FROM documents)""",
    "tmx_export": f"""WITH {LINE_PAIRS}, v AS (SELECT doc_id * 100000 + ord AS tu_id, source, target FROM line_pairs)
SELECT tu_id, sha256('<tu tuid="' || tu_id || '"><tuv xml:lang="en"><seg>' || {_xml('source')} || '</seg></tuv><tuv xml:lang="xx"><seg>' || {_xml('target')} || '</seg></tuv></tu>') AS unit
FROM v WHERE tu_id % 9 <> 0""",
    "pair_choices": "SELECT a.lang AS src, b.lang AS tgt FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT lang FROM documents) b WHERE a.lang <> b.lang",
}

_MISMATCH, _ESTIMATE = SQL["term_mismatch"], SQL["order_estimate"]
SQL |= {
    "panel_counts": f"""WITH {QA} SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM issues WHERE rule IN ('punct.brackets', 'punct.terminal') GROUP BY 1, 2
UNION ALL SELECT 'rule', rule, count(*) FROM issues WHERE severity = 'warning' GROUP BY 1, 2""",
    "tier_forecast": f"""WITH l AS (SELECT l_suppkey, {_TIER} AS tier, l_quantity::BIGINT AS words FROM (SELECT *, round(l_discount * 100) AS p FROM lineitem)),
rates(tier, micros) AS (VALUES {', '.join(str(r) for r in RATES)})
SELECT l_suppkey, sum(words * micros)::BIGINT AS micros_due, CASE WHEN count(micros) > 0 THEN 'EUR' END AS currency, coalesce(sum(words) FILTER (micros IS NULL), 0)::BIGINT AS unpriced_words FROM l LEFT JOIN rates USING (tier) GROUP BY 1""",
    "draft_selection": f"""WITH {HASHED}, {MEMORY}, c AS (SELECT *, concat_ws(chr(10), lag(plain) OVER w, lead(plain) OVER w) AS context FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, ord) AS r FROM c WHERE doc_id % 3 <> 0 AND hash NOT IN (SELECT hash FROM memory))
SELECT doc_id, ord, sha256(plain) AS plain, sha256(context) AS context FROM r WHERE r = 1""",
    "source_preview": f"""WITH {LINES} SELECT doc_id, segments, place, text FROM (SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS segments, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place, sha256(line) AS text FROM lines) WHERE place <= 3""",
    "quote_lines": f"WITH e AS ({_ESTIMATE}) SELECT * FROM e WHERE order_id % 3 <> 0",
    "term_entries": f"""WITH {DECISIONS}
SELECT v.term_id, v.primary_lang AS lang, max(p.variant_id) AS preferred, coalesce(string_agg(v.variant_id, ',' ORDER BY v.variant_id) FILTER (NOT v.forbidden AND v.variant_id <> p.variant_id), '') AS alternatives,
       coalesce(string_agg(v.variant_id, ',' ORDER BY v.variant_id) FILTER (v.forbidden), '') AS forbidden
FROM variants v LEFT JOIN preferred p ON p.term_id = v.term_id AND p.primary_lang = v.primary_lang GROUP BY 1, 2""",
    "stale_scan": f"""WITH f AS (SELECT * FROM ({_MISMATCH}) WHERE found IS NOT NULL), n AS (SELECT count(*) AS total FROM f) SELECT conv_id, turn, term, kind, found, total, total > 500 AS truncated FROM (SELECT * FROM f ORDER BY conv_id, turn, term LIMIT 500), n""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
