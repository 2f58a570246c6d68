"""Queries of the training-data operators, and DuckDB SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twintext.llm.conversations import damaged, repair
from twintext.llm.decontaminate import contamination
from twintext.llm.exact_dedup import exact_dedup
from twintext.llm.lang_id import fit_language, identify_language
from twintext.llm.mixing import cyclic_weights, mix
from twintext.llm.near_dedup import near_duplicates
from twintext.llm.periodic import longest_exponent, periodic_runs, stammered
from twintext.llm.quality import fit_quality, score_quality
from twintext.llm.repeats import remove_repeats
from twintext.llm.secrets import secret_spans
from twintext.llm.toxicity import fit_toxicity, score_toxicity
from twintext.llm.url_filter import url_filter
from twintext.llm.warc import archived_pages

#: The rules of op7: action, host, path.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def fold(k: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % k


#: Least score of a row that op3 and op5 predict as 1.
PREDICT_AT = 0.3


def _predicted(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _predicted(score_quality(docs, fit_quality(docs, labels, fold(5) != 0)), fold(5) == 0)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, fit_language(docs, fold(3) != 1))
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _predicted(score_toxicity(docs, fit_toxicity(docs, labels, fold(4) != 2)), fold(4) == 2)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans",
        "n_owned", "n_example", "n_live",
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "action string, host string, path string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, cyclic_weights(docs))


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("pieces")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(stammered(table(spark, sf_dir, "documents"))).withColumn("best", longest_exponent(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair(damaged(conversations), copies_col="copies")
    out = conversations.select("conv_id").distinct()
    for part in (found.summary(), found.digests()):
        part = part.withColumnRenamed("conv_id", "__id")
        out = out.join(part, out["conv_id"].eqNullSafe(part["__id"]), "left").drop("__id")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_decontamination, op3_quality, op4_language, op5_toxicity, op6_secret_scan, op7_url_filter, op8_mixing, op9_repeat_removal, op10_near_dedup, op11_periodic_runs, op12_warc, op13_conversation_repair)}


_OP1 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_OP7 = """
WITH rules(action, host, path) AS (VALUES {rules}),
urls AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
best AS (
  SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule,
         arg_max(r.action, length(r.host) + length(r.path)) AS action
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.host, u.path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM urls LEFT JOIN best USING (host, path)
""".format(rules=", ".join(str(r) for r in URL_RULES))

_OP8 = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(sha256('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS pos
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM docs GROUP BY source),
-- Clamped sources are a prefix of those in order of cap / weight.
levels AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         (SELECT sum(source_size) FROM sources)::DOUBLE AS total
  FROM sources),
filled AS (SELECT arg_min((total - held) / open_w, cap / w) FILTER ((total - held) / open_w * w <= cap) AS level FROM levels),
targets AS (
  SELECT source, source_size, least(cap, level * w)::DOUBLE AS target,
         CASE WHEN source_size > 0 THEN (round(least(cap, level * w))::BIGINT // source_size) ELSE 0 END AS whole
  FROM sources, filled),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.whole, round(t.target)::BIGINT - t.whole * t.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.pos, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + greatest(0, least(size, rest - start)))::BIGINT AS taken
FROM placed
"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII string, byte by byte."""
    bits = "list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda r: r::UBIGINT)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: {bits}), 4294967295::UBIGINT)"


_OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM p
"""


_OP11 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, {_crc32("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
seeded AS (SELECT *, len(words) AS n, h // 10 AS g, h % 10 = 0 AND doc_id IS NOT NULL AND len(words) > 0 AS stammers FROM docs),
tails AS (SELECT *, CASE WHEN stammers THEN g % n END AS a FROM seeded),
placed AS (
  SELECT row, n, i, CASE WHEN stammers AND i >= a THEN words[(a + (i - a) % (1 + (n - a) // (3 + g % 8)))::BIGINT + 1] ELSE words[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM tails)),
equal AS (SELECT x.row, y.i - x.i AS q, x.i FROM placed x JOIN placed y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n WHERE x.n >= 24),
stretches AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM equal) GROUP BY row, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT row, start, length, min(q) AS period FROM stretches GROUP BY row, start, length),
listed AS (
  SELECT row, count(*) AS n_runs, first(start ORDER BY length / period DESC, start, period) AS start, first(length ORDER BY length / period DESC, start, period) AS length, first(period ORDER BY length / period DESC, start, period) AS period,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY row),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM placed p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.row = p.row AND p.i >= r.start + r.period AND p.i < r.start + r.length) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed l USING (row) LEFT JOIN kept k USING (row)
"""


def _add(state: str, cost: str | int, op: str) -> str:
    """A state is its cost in twelve digits, then its audit: the least string is the cheapest, ties the ASCII-least."""
    return f"CASE WHEN {state} IS NOT NULL THEN lpad((left({state}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || '{op}' END"


def _op13() -> str:
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    keep = lambda initial, x: f"CASE WHEN initial = '{initial}' THEN {_add(x, 'late', 'K')} END"
    least = lambda *x: "least(" + ", ".join(x) + ")"
    closed = f"""s.n AS n, s.s AS s, CASE WHEN f.forced THEN s.u ELSE {least("s.u", _add("s.n", 3, "I"), _add("s.s", 3, "I"), _add("s.a", 3, "I"))} END AS u,
      CASE WHEN f.forced THEN s.a ELSE {least("s.a", _add("s.u", 3, "I"), _add("s.n", 6, "II"), _add("s.s", 6, "II"))} END AS a"""
    kept = lambda *x: f"CASE WHEN NOT forced THEN {least(*x, 'NULL')} END"
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE h <> 0),
placed AS (SELECT *, rtrim(text, {spaces}) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
turns AS (
  SELECT *, bare = '' AS blank, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
flagged AS (SELECT *, blank OR again AS forced, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS late FROM turns),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (late > 0) AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM flagged GROUP BY conv_id),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM sums
  UNION ALL
  SELECT conv_id, i, {_add("n", 4, "D")},
    {least(_add("s", 4, "D"), kept(keep("s", "n")))},
    {least(_add("u", 4, "D"), kept(*[keep("u", k) for k in "nsa"], *[_add(k, "late + 3", "R") for k in "nsa"]))},
    {least(_add("a", 4, "D"), kept(keep("a", "u"), _add("u", "late + 3", "R")))}
  FROM (SELECT f.conv_id, f.i, f.initial, f.forced, f.late, {closed} FROM steps s JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)),
best AS (
  SELECT m.*, {least("n", "a", _add("u", 3, "I"), _add("s", 6, "II"))} AS best FROM steps p JOIN sums m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.last = p.i),
letters AS (SELECT conv_id, unnest(string_split(substr(best, 13), '')) AS op, generate_subscripts(string_split(substr(best, 13), ''), 1) AS k FROM best),
numbered AS (SELECT *, count(*) FILTER (op <> 'I') OVER w AS i, count(*) FILTER (op <> 'D') OVER w - 1 AS nth FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
edits AS (SELECT e.*, f.role, f.text, bool_or(nth = 0 AND op = 'K' AND f.initial = 's') OVER (PARTITION BY e.conv_id) AS led FROM numbered e LEFT JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE op <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (nth - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha FROM edits GROUP BY conv_id)
SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(left(best, 12)::BIGINT, 0) AS cost, coalesce(substr(best, 13), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) r LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN repaired x ON x.conv_id IS NOT DISTINCT FROM r.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op7_url_filter": _OP7, "op8_mixing": _OP8, "op11_periodic_runs": _OP11, "op12_warc": _OP12, "op13_conversation_repair": _op13()}
