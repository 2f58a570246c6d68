"""Credential spans, separated by how widely the corpus shares their values.

Patterns find candidates in each text. The hash of every candidate's value is
then counted over the whole corpus by distinct repositories and owners: a
value that several owners or many repositories carry is an example, one that a
single owner carries in few repositories is taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintext.llm.storage import materialise

#: Fixed patterns: kind, pattern, group that holds the value, least length of that group.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The same candidates, found with less work: a run shorter than the least length cannot hold a longer one.
SCAN = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Candidates that only the ownership count decides: long tokens that mix letters and digits.
OPAQUE = ("owned", r"[A-Za-z0-9+/_=-]{20,}")
#: A value that at least so many owners carry is a widely copied example.
EXAMPLE_OWNERS = 3
#: So is one in so many repositories, even of a single owner.
EXAMPLE_REPOS = 20
SHARDS = 256


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind_rank, kind, end, value) of leftmost non-overlapping matches.

    The pieces between the matches and the matches themselves alternate, so
    their lengths add up to the offsets (in code points).
    """
    empty = F.array().cast("array<struct<s:int,r:int,kind:string,e:int,value:string>>")
    rank = next((i for i, k in enumerate(KINDS) if k[0] == kind), len(KINDS))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(gaps, 1, F.size(whole)).alias("gap"))
    state = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("s"), F.lit(rank).alias("r"), F.lit(kind).alias("kind"), end.alias("e"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(found, state, step, lambda acc: acc["spans"])).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str | None = "doc_id",
    owner_col: str = "source",
) -> DataFrame:
    """Finds credential spans in every text and tells examples from live ones.

    Returns one row per document: the id, ``n_assign``, ``n_access``, ``n_hex``
    (spans of the base patterns), ``base_spans``, ``spans`` (these and the
    ``owned`` ones, as ``kind:start:end`` by start and kind, comma-joined, end
    exclusive), ``n_owned``, ``n_example`` and ``n_live`` (different values of
    the document that are examples, or live).

    A value of one owner in fewer than ``EXAMPLE_REPOS`` repositories is live;
    one of ``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOS`` repositories is an
    example; others are neither. ``owned`` spans are live tokens outside the
    base spans with upper case, lower case and digits. A null text counts as
    empty. Null repositories, like null owners, count as one. Each row has its
    own result, rows that repeat an id or have none included. Other columns
    are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(repo_col or id_col).cast("string").alias("__repo"), F.col(owner_col).cast("string").alias("__owner"), text.alias("__text"))
    base = F.array_sort(F.concat(*[spans_of(F.col("__text"), k, SCAN.get(k, p), g, n) for k, p, g, n in KINDS]))
    kind, pattern = OPAQUE
    opaque = F.filter(
        spans_of(F.col("__text"), kind, pattern, 0, 1),
        lambda x: x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]") & x["value"].rlike("[0-9]"),
    )
    rows = rows.select("__id", "__repo", "__owner", base.alias("__base"), opaque.alias("__opaque"))
    # Written once: the patterns are the work, and the row number holds from here on.
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "secret-candidates")
    # A document's base spans are few, so the loop over them is short.
    alone = F.filter("__opaque", lambda x: ~F.exists("__base", lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    shard = F.pmod(F.xxhash64("__row"), F.lit(SHARDS)).cast("int")
    each = rows.select("__row", "__repo", "__owner", shard.alias("__shard"), F.explode(F.concat("__base", alone)).alias("__span")).withColumn("__hash", F.unhex(F.sha2("__span.value", 256)))
    owners = each.select("__hash", "__owner").distinct().groupBy("__hash").agg(F.count(F.lit(1)).alias("owners"))
    repos = each.select("__hash", "__repo").distinct().groupBy("__hash").agg(F.count(F.lit(1)).alias("repos"))
    owned = owners.join(repos, "__hash")
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS)
    verdict = F.when(example, "example").when(F.col("owners") == 1, "live").alias("verdict")
    dealt = each.select("__hash", "__shard").distinct().join(owned, "__hash").select("__hash", "__shard", verdict).where("verdict is not null")
    judged = each.join(dealt, ["__hash", "__shard"])
    live = F.col("verdict") == "live"
    per_row = judged.groupBy("__row").agg(
        F.collect_list(F.when((F.col("__span.kind") == kind) & live, F.col("__span"))).alias("__added"),
        F.count_distinct(F.when(~live, F.col("__hash"))).alias("n_example"),
        F.count_distinct(F.when(live, F.col("__hash"))).alias("n_live"),
    )
    out = rows.join(per_row, "__row", "left")
    none = F.array().cast("array<struct<s:int,r:int,kind:string,e:int,value:string>>")
    every = F.array_sort(F.concat("__base", F.coalesce("__added", none)))
    return out.select(
        F.col("__id").alias(id_col), *[_count(F.col("__base"), k[0]).alias(f"n_{k[0]}") for k in KINDS],
        _joined(F.col("__base")).alias("base_spans"), _joined(every).alias("spans"),
        F.size(F.coalesce("__added", none)).cast("long").alias("n_owned"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_example", "n_live")],
    )
