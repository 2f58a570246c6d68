"""URL rules by host suffixes and path prefixes.

Each URL is expanded into the expressions that a rule for it could have (every
host suffix with every path prefix of a length that some rule has). Expressions
and rules meet in an equi-join on the first bytes of their SHA-256; the full
digest then confirms the hit, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the hex digest in the join key.
PREFIX_HEX = 8
#: Most rules that are sent to every executor; more are joined by a shuffle.
BROADCAST_RULES = 50_000
#: Most distinct path lengths expanded per URL; with more, every length is.
MAX_LENGTHS = 64


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Judges each URL by ``rules`` (columns action, host, path).

    A rule fits its host and the host's subdomains if the URL's path starts
    with the rule's. The longest rule (host and path together) wins; then the
    longer host, then ``block``. Returns one row per page: the id, ``host``,
    ``path``, ``rule`` (host and path of the deciding rule, or null) and
    ``verdict`` (its action, or ``default``).

    A null url, or one without ``://``, has an empty host and path, which no
    rule fits. Rules with a null field are ignored, a repeated rule counts
    once. Repeated pages each give a row. Other columns are ignored.
    """
    rules = rules.select("action", "host", "path").dropna().distinct().withColumn("__full", _digest(F.col("host"), F.col("path")))
    rules = rules.select(F.substring("__full", 1, PREFIX_HEX).alias("__short"), "__full", F.col("action").alias("__action"), F.col("host").alias("__rule_host"), F.col("path").alias("__rule_path"))
    lengths = [r[0] for r in rules.select(F.length("__rule_path")).distinct().limit(MAX_LENGTHS + 1).collect()]
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    urls = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
    urls = urls.withColumn("host", url_host(F.col("__url"))).withColumn("path", url_path(F.col("__url")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)]) if 0 < len(lengths) <= MAX_LENGTHS else F.sequence(F.lit(0), F.length("path"))
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    keys = urls.select("host", "path").where("host <> ''").distinct()
    expressions = keys.withColumn("__suffix", F.explode(suffixes)).withColumn("__prefix", F.explode(prefixes))
    expressions = expressions.withColumn("__full", _digest(F.col("__suffix"), F.col("__prefix"))).withColumn("__short", F.substring("__full", 1, PREFIX_HEX))
    hits = expressions.join(F.broadcast(rules) if few else rules, ["__short"]).where(expressions["__full"] == rules["__full"])
    rank = F.struct(
        (F.length("__rule_host") + F.length("__rule_path")).alias("n"), F.length("__rule_host").alias("h"), (F.col("__action") == "block").alias("b"),
        F.concat("__rule_host", "__rule_path").alias("rule"), F.col("__action").alias("action"),
    )
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("__best"))
    judged = urls.join(best, ["host", "path"], "left")
    return judged.select(
        F.col("__id").alias(id_col), "host", "path", F.col("__best.rule").alias("rule"),
        F.coalesce(F.col("__best.action"), F.lit(default)).alias("verdict"),
    )
