"""Queries over documents, glossary logs, sessions, commits and reruns of quality rules, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintext.functions import text as T
from twintext.functions import tokens as K
from twintext.functions.hidden import carry_hidden_tags
from twintext.operators import confirm, glossary_log, qa_runs
from twintext.operators.placing import pretranslated_targets
from twintext.operators.snapshots import Snapshots
from twintext.plans.queries import KEY, LANG, hashed_lines, line_pairs, lines, memory_of, page_tokens, statused, table
from twintext.plans.sql import HASHED, LINE_PAIRS, LINES, MEMORY, QA, normal
from twintext.sources import packages
from twintext.stages import materialise, new_path

#: Instants at which the glossary is looked at.
INSTANTS = ("2024-01-09 12:00:00", "2024-01-20 00:00:00", "2024-02-01 00:00:00")


def _glossary_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a glossary's log: revisions of variants, decisions, and now and then a tombstone."""
    e = table(spark, d, "events")
    i, term = F.col("event_id"), F.col("user_id")
    op = F.when(F.col("event_type") == "view", "variant").when(i % 97 == 0, "tombstone").otherwise("decision")
    lang = F.when(i % 4 == 0, "de").when(i % 4 == 1, "fr").when(i % 4 == 2, "de-AT").otherwise("fr_CA")
    text = F.when((op == "variant") & (i % 7 == 0), F.lit(None)).when(i % 53 == 0, " ").otherwise(F.concat(F.lit(" Wort "), i % 3, F.lit(" ")))
    kind = F.when(F.col("event_type") == "click", "choice").when(F.col("event_type") == "signup", "override").when(F.col("event_type") == "error", "segment_exception").otherwise("deprecation")
    return e.select(
        i.alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), op.alias("op"), term.alias("term_id"), (term * 12 + i % 4 * 3 + i % 3).alias("variant_id"), lang.alias("lang"), text.alias("text"),
        F.when(i % 9 == 0, "").when(i % 9 == 1, "seen").alias("note"), F.when(i % 5 == 0, True).when(i % 5 == 1, False).alias("forbidden"), kind.alias("kind"),
        F.array(F.lit("WORT 1"), F.lit("wort  2"), F.lit("")).alias("rejected"), F.col("event_type").alias("project"), F.col("user_id").alias("segment"),
    )


def glossary_versions(spark, d):
    return glossary_log.variant_versions(_glossary_log(spark, d))


def glossary_as_of(spark, d):
    log = _glossary_log(spark, d)
    at = [glossary_log.entries_as_of(log, t).withColumn("at", F.lit(t)) for t in INSTANTS]
    return at[0].unionByName(at[1]).unionByName(at[2])


def glossary_rulings(spark, d):
    return glossary_log.ruling_ranges(_glossary_log(spark, d))


def _session_events(spark, d):
    """Each user's events as sessions over a handful of terms; what comes first is mostly a flag."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    op = F.when(i % 3 == 0, "flag").when(F.col("event_type") == "click", "choose").when(F.col("event_type") == "signup", "propose").when(F.col("event_type") == "view", "skip").when(i % 71 == 1, "commit").when(i % 73 == 1, "discard").otherwise("reopen")
    rows = e.select(
        (F.col("user_id") * 8 + F.floor(i / 1500)).alias("session_id"), i.alias("seq"), op.alias("op"), F.concat(F.lit("term "), i % 4).alias("key"),
        F.when(i % 41 == 0, " ").when(i % 2 == 0, F.concat(F.lit("Wort "), i % 5)).otherwise("wort 1").alias("rendering"), F.when(i % 5 == 0, "deprecate").when(i % 5 == 4, "rename").otherwise("override").alias("edit"),
        F.when(i % 4 != 0, i % 4).alias("term_id"), F.array(F.lit("WORT 1"), F.lit("Wort 2")).alias("offered"),
    )
    # Every tenth event comes twice.
    return rows.unionByName(rows.where("seq % 10 = 0"))


def session_states(spark, d):
    s = glossary_log.session_states(_session_events(spark, d))
    return s.select("session_id", "key", "flag_seq", "state", "kind", "rendering", F.array_join("rejected", "|").alias("rejected"), "status")


def session_refusals(spark, d):
    return glossary_log.session_refusals(_session_events(spark, d))


NOW, ACTOR = "2024-06-01T00:00:00.000Z", "reviewer"


def _project(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Lines with the next one as target, and a memory of the lines of every fourth document."""
    p = line_pairs(spark, d)
    text = lambda c: F.array(K.token("text", F.col(c)))
    hash_of = T.text_hash(T.normalize(F.col("source")))
    status = F.when(F.col("ord") % 5 == 0, "confirmed").when(F.col("ord") % 5 == 1, "locked").otherwise("translated")
    segments = p.select(
        (F.col("doc_id") * 100_000 + F.col("ord")).alias("id"), F.col("doc_id").alias("file_id"), "ord", text("source").alias("tokens"), text("target").alias("target"), F.array().cast(K.FORMATS).alias("formats"),
        hash_of.alias("hash"), status.alias("status"), F.lit("2024-01-01").alias("updated_at"),
    )
    known = p.where("doc_id % 4 = 0").select(T.normalize(F.col("source")).alias("plain")).withColumn("hash", T.text_hash(F.col("plain")))
    known = materialise(known.distinct(), "known")
    known = known.withColumn("uuid", F.concat(F.lit("m"), F.left("hash", F.lit(16)))).withColumn("x", F.left("hash", F.lit(1)))
    day, none = F.lit("2020-01-01"), F.lit(None).cast("string")
    units = known.select("uuid", F.lit(1).alias("rev"), day.alias("updated_at"), day.alias("created_at"), F.lit("import").alias("created_by"), (F.col("x") == "0").alias("deleted"), F.create_map().cast("map<string,string>").alias("attrs"))
    coded = F.when(F.col("x") > "b", F.array(K.token("text", F.lit("alt")), K.token("ph", None, F.lit(1), F.lit("br")))).otherwise(F.array(K.token("text", F.lit("alt"))))

    def variant(lang, rev, tokens, plain):
        return [
            "uuid", F.lit(lang).alias("lang"), F.lit(rev).alias("rev"), day.alias("updated_at"), none.alias("updated_by"), tokens.alias("tokens"), plain.alias("plain"), T.text_hash(plain).alias("hash"),
            none.alias("prev_hash"), none.alias("next_hash"), F.when(F.col("x").between("1", "3"), 4).otherwise(1).alias("quality"), F.lit(5).cast("bigint").alias("usage_count"), none.alias("last_used_at"), day.alias("created_at"),
        ]

    variants = known.select(*variant("en", 2, text("plain"), F.col("plain"))).unionByName(known.where("x > '5'").select(*variant("de", 1, coded, F.lit("alt"))))
    history = spark.createDataFrame([], f"uuid string, lang string, rev int, tokens {K.TOKENS}, quality int, changed_at string, changed_by string")
    vectors = variants.where("lang = 'de'").select("uuid", "lang", F.array(F.lit(1.0).cast("float")).alias("vec"))
    log = spark.createDataFrame([(100, "2020-01-01", "import", "created", "project", "1", "{}")], "id bigint, at string, actor string, action string, subject_type string, subject_id string, detail string")
    return {"segments": segments, "units": units, "variants": variants, "history": history, "vectors": vectors, "log": log}


def _confirmed(spark, d, name):
    """A table of the version that confirming every third segment publishes."""
    store = Snapshots(spark, new_path(spark, "project"))
    store.commit(_project(spark, d), 0)
    wanted = store.read("segments").where("(file_id + ord) % 3 = 0").select("id", F.when(F.col("ord") % 7 == 3, "2023-12-31").otherwise(F.col("updated_at")).alias("base_updated_at"))
    return store.read(name, confirm.confirm(store, wanted, "en", "de", NOW, ACTOR))


def confirm_variants(spark, d):
    return _confirmed(spark, d, "variants").select("uuid", "lang", "rev", "hash", "prev_hash", "next_hash", "quality", "usage_count", "created_at", "updated_at", "updated_by")


def confirm_history(spark, d):
    return _confirmed(spark, d, "history").select("uuid", "lang", "rev", K.plain_text(F.col("tokens")).alias("plain"), "quality", "changed_at")


def confirm_log(spark, d):
    return _confirmed(spark, d, "log").where("id > 100").select("id", "subject_id", F.get_json_object("detail", "$.tm_write.tu_uuid").alias("tu_uuid"), F.get_json_object("detail", "$.tm_write.rev").cast("int").alias("rev"))


def hidden_carry(spark, d):
    """Each page's text edited between its visible tags; its hidden ones are carried."""
    pages = page_tokens(spark, d)
    edited = F.transform(K.without_hidden(F.col("tokens"), F.col("formats")), lambda x: F.struct(x["t"].alias("t"), F.regexp_replace(x["v"], "[aeo]", "u").alias("v"), x["id"].alias("id"), x["k"].alias("k")))
    pages = materialise(pages.select("page_id", "tokens", "formats", edited.alias("target")), "edited")
    carried = pages.select("page_id", "tokens", "formats", "target", carry_hidden_tags(F.col("target"), F.col("tokens"), F.col("formats")).alias("out"))
    t, f = F.col("out"), F.col("formats")
    count = lambda c: F.size(F.filter(c, lambda x: x["t"] != "text")) - F.size(F.filter(K.without_hidden(c, f), lambda x: x["t"] != "text"))
    carried = materialise(carried, "carried")
    return carried.select("page_id", F.sha2(K.plain_text(t), 256).alias("plain"), count(t).cast("bigint").alias("hidden"), (count(t) == count(F.col("tokens"))).alias("whole"), K.same_visible(t, F.col("target"), f).alias("same"))


def document_roundtrip(spark, d):
    """Each document as a text part, a paragraph a line, every fourth of them in bold; a third of the paragraphs are translated, and the part is written back."""
    xml = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    run = F.when(F.col("ord") % 4 == 0, "<w:r><w:rPr><w:b/></w:rPr>").otherwise("<w:r>")
    paragraph = F.concat(F.lit('<w:p><w:pPr><w:jc w:val="both"/></w:pPr>'), run, F.lit("<w:t>"), xml(F.col("line")), F.lit("</w:t></w:r></w:p>"))
    rows = lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", paragraph.alias("p")))).alias("ps"))
    body = F.concat(F.lit("<w:document><w:body>"), F.array_join("ps.p", ""), F.lit("</w:body></w:document>"))
    none = lambda kind: F.lit(None).cast(kind)
    parts = rows.select(
        F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("entry"), F.lit("word/document.xml").alias("part"), body.cast("binary").alias("content"),
        none("binary").alias("stored"), none("binary").alias("central"), none("binary").alias("tail"), none("string").alias("error"),
    )
    parts = materialise(parts, "parts")
    regions = materialise(packages.read_regions(parts), "regions")
    marked = F.transform("tokens", lambda t: F.when(t["t"] == "text", K.token("text", F.concat(F.lit("» "), t["v"]))).otherwise(K.token_of(t)))
    chosen = (F.col("path").cast("bigint") + F.col("ord")) % 3 == 0
    segments = regions.where("error is null").select("path", "part", "key", F.lit(0).alias("para_ord"), F.col("tokens").alias("source_tokens"), F.when(chosen, marked).alias("target_tokens"), "formats")
    edits = materialise(packages.fold_paragraphs(segments), "edits")
    spliced = packages.splice_parts(parts, edits)
    per_file = segments.groupBy("path").agg(F.count(F.lit(1)).alias("paragraphs"))
    done = edits.where("xml is not null").groupBy("path").agg(F.count(F.lit(1)).alias("rendered"))
    out = spliced.select("path", F.sha2(F.coalesce("changed", "content"), 256).alias("content_sha256")).join(per_file, "path").join(done, "path", "left")
    return out.select(F.col("path").cast("bigint").alias("doc_id"), "paragraphs", F.coalesce("rendered", F.lit(0).cast("bigint")).alias("rendered"), "content_sha256")


def cascade_targets(spark, d):
    """Exact and propagated matches of all lines with the targets that they bring; every third document is confirmed."""
    text = lambda mark, c: F.array(K.token("text", F.concat(F.lit(mark), c)))
    rows = statused(hashed_lines(spark, d)).withColumns({"tokens": text("", F.col("line")), "formats": F.array().cast(K.FORMATS)})
    rows = rows.withColumn("target", F.when(F.col("confirmed") & (F.col("ord") % 2 == 0), text("T:", F.col("line"))))
    memory = memory_of(spark, d).withColumn("tokens", text("M:", F.col("plain")))
    out = pretranslated_targets(rows.drop("line"), memory, KEY, None, LANG, ())
    return out.select(*KEY, "outcome", "status", F.sha2(K.plain_text(F.col("target")), 256).alias("target_sha256"), "tags_matched")


#: Rules that the reruns apply.
RERUN_RULES = ("seg.empty", "seg.untranslated", "punct.terminal", "punct.brackets", "punct.spacing")


def qa_rerun(spark, d):
    """Findings over all lines, kept up through an edit of every seventh document's third lines; some lines go."""
    pairs = materialise(line_pairs(spark, d).withColumns({"src_lang": F.lit("en"), "tgt_lang": F.lit("en")}), "pairs")
    before = materialise(qa_runs.full_run(pairs, KEY, RERUN_RULES).withColumn("dismissed", F.col("doc_id") % 2 == 0), "findings")
    hit = (F.col("doc_id") % 7 == 0) & (F.col("ord") % 3 == 0)
    target = F.when(F.col("ord") % 2 == 0, F.col("source")).otherwise(F.concat("target", F.lit(" (")))
    changes = pairs.where(hit).withColumn("target", target).withColumn("removed", F.col("ord") % 9 == 0)
    return qa_runs.rerun(pairs, changes, before, KEY, RERUN_RULES)


_LOG = f"""log AS (
  SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CASE WHEN event_type = 'view' THEN 'variant' WHEN event_id % 97 = 0 THEN 'tombstone' ELSE 'decision' END AS op, user_id AS term_id,
         user_id * 12 + event_id % 4 * 3 + event_id % 3 AS variant_id, CASE event_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN 'de-AT' ELSE 'fr_CA' END AS lang,
         CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN NULL WHEN event_id % 53 = 0 THEN ' ' ELSE ' Wort ' || (event_id % 3) || ' ' END AS text,
         CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'seen' END AS note, CASE event_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS forbidden,
         CASE event_type WHEN 'click' THEN 'choice' WHEN 'signup' THEN 'override' WHEN 'error' THEN 'segment_exception' ELSE 'deprecation' END AS kind FROM events),
keyed AS (SELECT *, lower({normal('text')}) AS key, string_split_regex(lower(lang), '[-_]')[1] AS primary_lang FROM log),
revisions AS (SELECT * FROM keyed k WHERE op = 'variant' AND (text IS NULL OR key <> '')
  AND (stamp, id) >= (SELECT min((f.stamp, f.id)) FROM keyed f WHERE f.op = 'variant' AND f.variant_id = k.variant_id AND f.text IS NOT NULL)),
decided AS (SELECT *, key AS chosen FROM keyed WHERE op = 'decision' AND key <> '')"""


def _as_of(at: str) -> str:
    """The reference's rule at one instant, read from the whole log."""
    return f"""SELECT '{at}' AS "at", term_id, primary_lang AS lang, count(*) AS variants, count(*) FILTER (forbidden) AS forbidden,
  first(variant_id ORDER BY decided_at DESC NULLS LAST, decision DESC NULLS LAST, variant_id) FILTER (NOT forbidden) AS preferred,
  first(plain ORDER BY decided_at DESC NULLS LAST, decision DESC NULLS LAST, variant_id) FILTER (NOT forbidden) AS plain,
  max(decided_at) FILTER (NOT forbidden) AS decided_at
FROM (SELECT v.*, max(d.stamp) AS decided_at, max(d.id) AS decision FROM (
    SELECT variant_id, arg_min(term_id, (stamp, id)) AS term_id, arg_min(primary_lang, (stamp, id)) AS primary_lang, lower({normal("arg_max(text, (stamp, id)) FILTER (text IS NOT NULL)")}) AS plain,
           coalesce(arg_max(forbidden, (stamp, id)) FILTER (forbidden IS NOT NULL), FALSE) AS forbidden FROM revisions WHERE stamp <= '{at}' GROUP BY variant_id) v
  LEFT JOIN decided d ON d.term_id = v.term_id AND d.primary_lang = v.primary_lang AND d.chosen = v.plain AND d.stamp <= '{at}' AND d.kind NOT IN ('deprecation', 'segment_exception') GROUP BY ALL)
WHERE term_id NOT IN (SELECT term_id FROM log WHERE op = 'tombstone' AND stamp <= '{at}') GROUP BY term_id, primary_lang"""


_SESSION = """ops AS (
  SELECT user_id * 8 + event_id // 1500 AS session_id, event_id AS seq, 'term ' || (event_id % 4) AS key,
         CASE WHEN event_id % 3 = 0 THEN 'flag' WHEN event_type = 'click' THEN 'choose' WHEN event_type = 'signup' THEN 'propose' WHEN event_type = 'view' THEN 'skip' WHEN event_id % 71 = 1 THEN 'commit' WHEN event_id % 73 = 1 THEN 'discard' ELSE 'reopen' END AS op,
         CASE WHEN event_id % 41 = 0 THEN ' ' WHEN event_id % 2 = 0 THEN 'Wort ' || (event_id % 5) ELSE 'wort 1' END AS rendering, CASE event_id % 5 WHEN 0 THEN 'deprecate' WHEN 4 THEN 'rename' ELSE 'override' END AS edit FROM events),
closings AS (SELECT session_id, min(seq) AS closed_at, arg_min(op, seq) AS closed FROM ops WHERE op IN ('commit', 'discard') GROUP BY 1),
flags AS (SELECT session_id, key, min(seq) AS flag_seq, arg_min(seq % 4 <> 0, seq) AS known FROM ops WHERE op = 'flag' GROUP BY 1, 2),
judged AS (SELECT o.*, flag_seq, known, closed_at, closed, CASE
    WHEN seq > closed_at THEN 'closed' WHEN op IN ('commit', 'discard') THEN NULL WHEN flag_seq IS NULL OR seq < flag_seq THEN 'no flag' WHEN op = 'flag' AND seq > flag_seq THEN 'flagged twice'
    WHEN op IN ('choose', 'propose') AND rendering = ' ' THEN 'no rendering' WHEN op = 'propose' AND NOT known THEN 'no entry' WHEN op = 'propose' AND edit = 'rename' THEN 'unknown edit' END AS refused
  FROM ops o LEFT JOIN flags USING (session_id, key) LEFT JOIN closings USING (session_id)),
last AS (SELECT session_id, key, min(flag_seq) AS flag_seq, arg_max(op, seq) AS op, arg_max(rendering, seq) AS rendering, arg_max(edit, seq) AS edit, any_value(closed) AS closed
  FROM judged WHERE refused IS NULL AND op NOT IN ('commit', 'discard') GROUP BY 1, 2)"""

_PROJECT = f"""{LINES}, p AS (
  SELECT doc_id * 100000 + ord AS id, doc_id, ord, line AS source, lead(line) OVER (PARTITION BY doc_id ORDER BY ord) AS target FROM lines),
seg AS (SELECT *, sha256({normal('source')}) AS hash, sha256({normal('target')}) AS thash, CASE ord % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'locked' ELSE 'translated' END AS status,
          (doc_id + ord) % 3 = 0 AND ord % 5 <> 1 AND ord % 7 <> 3 AND regexp_replace(target, {"'" + T.SPACE + "+'"}, '', 'g') <> '' AS accepted FROM p WHERE target IS NOT NULL),
known AS (SELECT DISTINCT hash, left(hash, 1) AS x, 'm' || left(hash, 16) AS uuid FROM seg WHERE doc_id % 4 = 0),
memory AS (
  SELECT uuid, 'en' AS lang, 2 AS rev, hash, CASE WHEN x BETWEEN '1' AND '3' THEN 4 ELSE 1 END AS quality, '' AS kinds, NULL AS plain FROM known
  UNION ALL SELECT uuid, 'de', 1, sha256('alt'), CASE WHEN x BETWEEN '1' AND '3' THEN 4 ELSE 1 END, CASE WHEN x > 'b' THEN 'br' ELSE '' END, 'alt' FROM known WHERE x > '5'),
sources AS (SELECT id, lag(hash) OVER w AS prev_hash, lead(hash) OVER w AS next_hash FROM seg WHERE status <> 'locked' WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
targets AS (SELECT id, lag(thash) OVER w AS prev_target, lead(thash) OVER w AS next_target FROM seg WHERE status = 'confirmed' OR accepted WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
accepted AS (SELECT seg.*, prev_hash, next_hash, prev_target, next_target, coalesce(k.uuid, 'n' || left(sha256('en:' || seg.hash), 32)) AS uuid
  FROM seg LEFT JOIN known k ON k.hash = seg.hash AND k.x <> '0' LEFT JOIN sources USING (id) LEFT JOIN targets USING (id) WHERE accepted),
changes AS (SELECT id, uuid, 'en' AS lang, hash, prev_hash, next_hash FROM accepted UNION ALL SELECT id, uuid, 'de', thash, prev_target, next_target FROM accepted),
last AS (SELECT uuid, lang, count(*) AS n, arg_max((hash, prev_hash, next_hash), id) AS c FROM changes GROUP BY 1, 2)"""
_EDITED = QA.replace(", issues AS (", """, edited AS (
  SELECT doc_id, ord, source, CASE WHEN doc_id % 7 = 0 AND ord % 3 = 0 THEN CASE WHEN ord % 2 = 0 THEN source ELSE target || ' (' END ELSE target END AS target
  FROM line_pairs WHERE NOT (doc_id % 7 = 0 AND ord % 9 = 0)), issues AS (""", 1)
_EDITED = _EDITED[: _EDITED.index("issues AS (")] + _EDITED[_EDITED.index("issues AS (") :].replace("FROM line_pairs", "FROM edited")
_OLD = QA.replace("issues AS (", "old_issues AS (").removeprefix(LINE_PAIRS)
_CONSISTENT = """SELECT doc_id, ord, 'consistency.target_differs' AS rule, 'warning' AS severity FROM {t} WHERE source IN (SELECT source FROM {t} GROUP BY source HAVING min(target) <> max(target))
  UNION ALL SELECT doc_id, ord, 'consistency.source_differs', 'info' FROM {t} WHERE target IN (SELECT target FROM {t} GROUP BY target HAVING min(source) <> max(source))"""
_WML = "'<w:p><w:pPr><w:jc w:val=\"both\"/></w:pPr>' || CASE WHEN ord % 4 = 0 THEN '<w:r><w:rPr><w:b/></w:rPr>' ELSE '<w:r>' END || "
_ESCAPED = "replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

SQL = {
    "cascade_targets": f"""WITH {HASHED}, {MEMORY}, hits AS (
  SELECT h.doc_id, h.ord, first('M:' || m.plain ORDER BY m.priority, m.quality DESC, m.updated_at DESC, m.tu_id) AS target FROM hashed h JOIN memory m ON m.hash = h.hash AND m.lang = h.lang WHERE h.doc_id % 3 <> 0 GROUP BY ALL),
donors AS (SELECT hash, lang, first('T:' || line ORDER BY doc_id, ord) AS target FROM hashed WHERE doc_id % 3 = 0 AND ord % 2 = 0 GROUP BY ALL),
found AS (SELECT h.doc_id, h.ord, CASE WHEN h.doc_id % 3 = 0 THEN 'skipped' WHEN hits.target IS NOT NULL THEN 'exact' WHEN d.target IS NOT NULL THEN 'propagated' ELSE 'unmatched' END AS outcome,
    CASE WHEN h.doc_id % 3 <> 0 THEN coalesce(hits.target, d.target) END AS target
  FROM hashed h LEFT JOIN hits ON hits.doc_id = h.doc_id AND hits.ord = h.ord LEFT JOIN donors d ON d.hash = h.hash AND d.lang = h.lang)
SELECT doc_id, ord, outcome, CASE outcome WHEN 'exact' THEN 'translated' WHEN 'propagated' THEN 'draft' END AS status, sha256(regexp_replace(target, '[\\x0B\\x0C]', ' ', 'g')) AS target_sha256, CASE WHEN target IS NOT NULL THEN TRUE END AS tags_matched FROM found""",
    "confirm_variants": f"""WITH {_PROJECT} SELECT coalesce(m.uuid, l.uuid) AS uuid, coalesce(m.lang, l.lang) AS lang, (coalesce(m.rev, 0) + coalesce(l.n, 0))::INT AS rev, CASE WHEN l.uuid IS NULL THEN m.hash ELSE l.c[1] END AS hash,
  l.c[2] AS prev_hash, l.c[3] AS next_hash, greatest(m.quality, CASE WHEN l.uuid IS NOT NULL THEN 3 END)::INT AS quality, CASE WHEN m.uuid IS NULL THEN 0 ELSE 5 END::BIGINT AS usage_count,
  CASE WHEN m.uuid IS NULL THEN '{NOW}' ELSE '2020-01-01' END AS created_at, CASE WHEN l.uuid IS NULL THEN '2020-01-01' ELSE '{NOW}' END AS updated_at, CASE WHEN l.uuid IS NOT NULL THEN '{ACTOR}' END AS updated_by
FROM memory m FULL JOIN last l ON m.uuid = l.uuid AND m.lang = l.lang""",
    "confirm_history": f"WITH {_PROJECT} SELECT m.uuid, m.lang, m.rev::INT AS rev, m.plain, m.quality::INT AS quality, '{NOW}' AS changed_at FROM memory m JOIN last l ON m.uuid = l.uuid AND m.lang = l.lang WHERE m.kinds <> ''",
    "confirm_log": f"""WITH {_PROJECT} SELECT 100 + row_number() OVER (ORDER BY a.id) AS id, a.id::VARCHAR AS subject_id, a.uuid AS tu_uuid,
  (coalesce(m.rev, 0) + row_number() OVER (PARTITION BY a.uuid ORDER BY a.id))::INT AS rev FROM accepted a LEFT JOIN memory m ON m.uuid = a.uuid AND m.lang = 'de'""",
    "document_roundtrip": f"""WITH {LINES}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS place FROM lines), marked AS (
  SELECT *, (doc_id + place) % 3 = 0 AND NOT regexp_matches(line, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}]') AS done FROM placed)
SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (done) AS rendered, sha256('<w:document><w:body>' || string_agg({_WML}
  CASE WHEN done THEN '<w:t xml:space="preserve">» ' ELSE '<w:t>' END || {_ESCAPED} || '</w:t></w:r></w:p>', '' ORDER BY ord) || '</w:body></w:document>') AS content_sha256 FROM marked GROUP BY doc_id""",
    "qa_rerun": f"""WITH {_EDITED}{_OLD}, new AS (SELECT * FROM issues UNION ALL {_CONSISTENT.format(t='edited')}), old AS (SELECT * FROM old_issues UNION ALL {_CONSISTENT.format(t='line_pairs')})
SELECT n.*, n.doc_id % 2 = 0 AND EXISTS (SELECT 1 FROM old o WHERE o.doc_id = n.doc_id AND o.ord = n.ord AND o.rule = n.rule) AS dismissed FROM new n""",
    "glossary_versions": f"""WITH {_LOG}, v AS (SELECT *, last_value(text IGNORE NULLS) OVER w AS latest, last_value(note IGNORE NULLS) OVER w AS noted, last_value(forbidden IGNORE NULLS) OVER w AS banned FROM revisions WINDOW w AS (PARTITION BY variant_id ORDER BY stamp, id))
SELECT first(term_id) OVER w AS term_id, variant_id, first(lang) OVER w AS lang, (row_number() OVER w)::INT AS rev, latest AS text, CASE WHEN noted <> '' THEN noted END AS note, coalesce(banned, FALSE) AS forbidden,
       stamp AS valid_from, lead(stamp) OVER w AS valid_to, lower({normal('latest')}) AS plain FROM v WINDOW w AS (PARTITION BY variant_id ORDER BY stamp, id)""",
    "glossary_as_of": f"WITH {_LOG} " + " UNION ALL ".join(f"({_as_of(t)})" for t in INSTANTS),
    "glossary_rulings": f"""WITH {_LOG} SELECT term_id, primary_lang AS lang, chosen, kind, id, stamp AS valid_from, lead(stamp) OVER (PARTITION BY term_id, primary_lang ORDER BY stamp, id) AS valid_to
FROM decided WHERE kind NOT IN ('deprecation', 'segment_exception')""",
    "session_states": f"""WITH {_SESSION} SELECT session_id, key, flag_seq, CASE op WHEN 'choose' THEN 'decided' WHEN 'propose' THEN 'proposed' WHEN 'skip' THEN 'skipped' ELSE 'flagged' END AS state,
  CASE WHEN op = 'choose' THEN CASE WHEN lower(rendering) IN ('wort 1', 'wort 2') THEN 'accepted_suggestion' ELSE 'custom' END WHEN op = 'propose' THEN CASE edit WHEN 'deprecate' THEN 'deprecation' ELSE edit END END AS kind,
  CASE WHEN op IN ('choose', 'propose') THEN rendering END AS rendering,
  CASE WHEN op IN ('choose', 'propose') THEN array_to_string(list_filter(['WORT 1', 'Wort 2'], lambda o: lower(o) <> lower(rendering)), '|') END AS rejected,
  CASE closed WHEN 'commit' THEN 'committed' WHEN 'discard' THEN 'discarded' ELSE 'open' END AS status FROM last""",
    "session_refusals": f"WITH {_SESSION} SELECT session_id, seq, refused FROM judged WHERE refused IS NOT NULL",
}

_ALL = (
    document_roundtrip, hidden_carry, cascade_targets, confirm_variants, confirm_history, confirm_log, qa_rerun, glossary_versions, glossary_as_of, glossary_rulings, session_states, session_refusals,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
