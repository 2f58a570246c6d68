"""Exact deduplication by a log-structured merge index of text digests.

``DigestIndex`` keeps ``(digest, id)`` entries. ``flush`` writes a batch as a
level-0 run of files sorted by digest. ``compact`` merges all runs into level
1, one row per digest with the identifier that stays, and builds a filter of
the digests that occur more than once. A lookup probes the filter first: a row
that it rules out is the only one of its digest and reads nothing more; only
hits are joined with level 1. Hits are then compared byte by byte with the
text that stays; should two texts share a digest, their group is split by the
text.

Every group is aggregated in two steps, by ``(digest, shard)`` and by
``digest``, and results return to the rows through ``(digest, shard)``, so a
digest that a third of all rows carry is still dealt over all shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twintext.llm.storage import join_checked, materialise, new_path, per_shard

SHARDS = 256
#: Bits of the filter for each digest that occurs more than once: about one other digest in 16 hits it.
BITS_PER_DIGEST = 16
#: Most digests with copies that are sent to every executor (32 bytes each).
BROADCAST_DIGESTS = 100_000
#: Copies compared with one replica of the text that stays.
COPIES_PER_REPLICA = 512


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs of digests under ``path``; ``keep`` is ``"min"`` or ``"max"``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        keep: str = "min",
        digest: Callable[[Column], Column] = sha256_digest,
        shards: int = SHARDS,
    ):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.path, self.keep = spark, path or new_path(spark, "lsm"), keep
        self.digest, self.shards, self.runs, self.level1 = digest, shards, [], None

    def shard(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.shards)).cast("int")

    def flush(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Writes a batch as a run and returns the run: __id, __digest, __shard, __sha."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        run = f"{self.path}/level0/run-{len(self.runs):06d}"
        (
            docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
            .select("__id", self.digest(F.col("__text")).alias("__digest"), self.shard(F.col("__id")).alias("__shard"), F.unhex(F.sha2("__text", 256)).alias("__sha"))
            .sortWithinPartitions("__digest")
            .write.parquet(run)
        )
        self.runs.append(run)
        return self.spark.read.parquet(run)

    def compact(self) -> DataFrame:
        """Merges all runs: __digest, __keep, __n. Also (digest, shard) counts."""
        best = F.min if self.keep == "min" else F.max
        by_shard = self.spark.read.parquet(*self.runs).groupBy("__digest", "__shard").agg(best("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
        merged = by_shard.groupBy("__digest").agg(best("__keep").alias("__keep"), F.sum("__n").alias("__n"))
        path = new_path(self.spark, "lsm") if self.level1 is not None else f"{self.path}/level1"
        merged.sortWithinPartitions("__digest").write.parquet(path)
        self.level1 = self.spark.read.schema(merged.schema).parquet(path)
        self._build_filter()
        return self.level1

    def _place(self) -> Column:
        """A digest's place among the bits of the filter, from 1."""
        return F.pmod(F.xxhash64("__digest"), F.lit(self.bits)) + 1

    def _build_filter(self) -> None:
        """Bitmaps by bucket: a bit for each digest of several rows."""
        several = self.level1.where("__n > 1")
        self.bits = BITS_PER_DIGEST * max(several.count(), 1)
        rows = several.select(self._place().alias("x"))
        maps = rows.groupBy(F.bitmap_bucket_number("x").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("__map"))
        self.filter = materialise(maps, "lsm-filter")

    def probe(self, rows: DataFrame) -> DataFrame:
        """Adds ``__hit``: false only for rows whose digest no other row has."""
        x = self._place()
        rows = rows.withColumn("__bucket", F.bitmap_bucket_number(x)).withColumn("__bit", F.bitmap_bit_position(x))
        found = join_checked(rows, self.filter, ["__bucket"], how="left", row_bytes=4096)
        byte = F.conv(F.hex(F.substring(F.col("__map"), (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1, F.lit(False))
        return found.withColumn("__hit", hit).drop("__bucket", "__bit", "__map")

    def lookup(self, run: DataFrame) -> DataFrame:
        """Adds __keep and __n to the rows of a run; only hits of the filter meet level 1, by (digest, shard)."""
        probed = self.probe(run)
        alone = probed.where("not __hit").withColumn("__keep", F.col("__id")).withColumn("__n", F.lit(1).cast("long")).drop("__hit")
        hits = probed.where("__hit").drop("__hit")
        return alone.unionByName(per_shard(hits, self.level1, ["__digest"]).select(alone.columns))


def _verified(index: DigestIndex, docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each row in a group of several: whether its bytes equal those of the row that stays."""
    dups = index.level1.where("__n > 1").select("__digest", "__keep", "__n")
    few = dups.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).select("__id", "__text", index.digest(F.col("__text")).alias("__digest"), index.shard(F.col("__id")).alias("__shard"))
    if few:
        rows = rows.join(F.broadcast(dups), "__digest")
    else:
        # Only rows that the filter lets through bring their texts to the join.
        rows = index.probe(rows).where("__hit").drop("__hit")
        rows = rows.join(per_shard(hits.select("__digest", "__shard").distinct(), dups, ["__digest"]), ["__digest", "__shard"])
    replicas = F.ceil(F.col("__n") / F.lit(COPIES_PER_REPLICA)).cast("int")
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__id", F.lit("salt")), replicas).cast("int"))
    kept = (
        rows.where("__id <=> __keep").groupBy("__digest", "__n").agg(F.min("__text").alias("__kept_text"))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), replicas - 1))).drop("__n")
    )
    return rows.join(kept, ["__digest", "__salt"]).select("__digest", "__id", (F.col("__text") == F.col("__kept_text")).alias("__same"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = sha256_digest,
) -> DataFrame:
    """Groups rows of identical text; of each group the smallest (or largest) id stays.

    Returns one row per input row: the id column, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``.

    A null text counts as empty; empty texts form one group. A null id ranks
    below (``keep="max"``) or above (``"min"``) all others and stays only in a
    group without other ids. Rows that repeat an id with the same text are all
    counted, and all marked kept if that id stays. Other columns are ignored.
    An empty table gives an empty result.
    """
    index = DigestIndex(docs.sparkSession, keep=keep, digest=digest)
    run = index.flush(docs, id_col, text_col)
    index.compact()
    found = index.lookup(run)
    checks = materialise(_verified(index, docs, run, id_col, text_col), "lsm-verified")
    clash = checks.where("not __same").select("__digest").distinct()
    if clash.limit(1).count():
        found = _split(index, docs, found, clash, id_col, text_col)
    return found.select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def _split(index: DigestIndex, docs: DataFrame, found: DataFrame, clash: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Regroups the rows whose digest several texts share by the text itself."""
    best = F.min if index.keep == "min" else F.max
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).select("__id", "__text", index.digest(F.col("__text")).alias("__digest"), index.shard(F.col("__id")).alias("__shard"))
    rows = rows.join(clash, "__digest", "left_semi")
    by_shard = rows.groupBy("__text", "__shard").agg(best("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    groups = by_shard.groupBy("__text").agg(best("__keep").alias("__keep"), F.sum("__n").alias("__n"))
    again = per_shard(rows, groups, ["__text"]).select("__id", "__digest", "__shard", F.unhex(F.sha2("__text", 256)).alias("__sha"), "__keep", "__n")
    rest = found.join(clash, "__digest", "left_anti")
    return rest.select("__id", "__digest", "__shard", "__sha", "__keep", "__n").unionByName(again)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The documents, all columns, without the copies that ``exact_dedup`` drops.

    A row that repeats both the id and the text of the row that stays, stays.
    """
    found = exact_dedup(docs, id_col, text_col, keep).where("not kept")
    gone = materialise(found.select(F.col(id_col).alias("__gone"), F.unhex("text_sha256").alias("__sha")).distinct(), "lsm-gone")
    few = gone.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    same = docs[id_col].eqNullSafe(gone["__gone"]) & (F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)) == gone["__sha"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
