"""Tables between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder
    of its own; on a cluster its absence is an error.
    """
    path = spark.conf.get(_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-twintext-")
        spark.conf.set(_KEY, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Removes a query's shuffle files once it has ended; what it wrote needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    a lost executor costs no recomputation. The shuffle files of the write go."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that are written inside, but for those given to what it yields; these belong to the scope around.

    For steps whose results are tables themselves: nothing that is still to be
    computed may read what goes.
    """
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stage_path)
        return df

    _scopes.append([])
    try:
        yield keep
    except BaseException:
        _scopes.pop()
        raise
    for path in _scopes.pop():
        if path in kept:
            if _scopes:
                _scopes[-1].append(path)
        else:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Removes a table of ``materialise`` that nothing reads any more."""
    for scope in _scopes:
        if df._stage_path in scope:
            scope.remove(df._stage_path)
    _remove(df.sparkSession, df._stage_path)


#: Most bytes of the bits by which ``numbered`` finds rows; beyond, rows are shuffled.
BITS_BYTES = 32 << 20


def numbered(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows whose number ``name`` (0 or more) is among ``ids``, one bit for each number that is, so that the rows stay where they are.

    For numbers that lie close together, such as those of the rows of a table.
    """
    word, bit = F.shiftright(name, 6), F.expr(f"cast({name} & 63 AS int)")
    bits = ids.groupBy(word.alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 AS int))")).alias("__bits"))
    bits = materialise(bits, "bits")
    if bits.count() * 16 > BITS_BYTES:
        return rows.join(ids, name, "left_semi")
    found = rows.withColumn("__word", word).join(F.broadcast(bits), "__word")
    return found.where(F.getbit("__bits", bit) == 1).select(*rows.columns)


#: Bits of hashes by which ``sieved`` finds rows: 8 MB with their places at most, whatever there is to find.
SIEVE_BITS = 1 << 25


def sieved(rows: DataFrame, table: DataFrame, keys: list[str], others: bool = False) -> DataFrame:
    """The rows that a join with ``table`` may find, and few more, without a shuffle of the rows; with ``others`` all the rest, which it can't find."""
    slot = lambda: F.pmod(F.xxhash64(*keys), F.lit(SIEVE_BITS))
    bits = table.select(slot().alias("__slot")).groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__slot % 64 AS int)))").alias("__bits"))
    found = rows.withColumn("__slot", slot()).withColumn("__word", F.shiftright("__slot", 6)).join(F.broadcast(bits), "__word", "left" if others else "inner")
    return found.where(f"coalesce(bit_get(__bits, cast(__slot % 64 AS int)), 0) = {0 if others else 1}").select(*rows.columns)


def having(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in ``table``; only those which the sieve lets through are shuffled.

    Semi and anti joins would be pushed below the sieve, so these are plain ones.
    """
    return sieved(rows, table, keys).join(table.select(*keys).distinct(), keys).select(*rows.columns)


def flagged(rows: DataFrame, table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """All rows, with ``name`` true where their keys are in ``table``, else null; shuffled as in ``having``."""
    hit = table.select(*keys).distinct().withColumn(name, F.lit(True))
    maybe = sieved(rows, table, keys).join(hit, keys, "left").select(*rows.columns, name)
    return maybe.unionByName(sieved(rows, table, keys, others=True).withColumn(name, F.lit(None).cast("boolean")))


def lacking(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not in ``table``, shuffled as in ``having``."""
    return flagged(rows, table, keys, "__hit").where("__hit is null").drop("__hit")


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds the place (from 1) of each row within ``by``, in order; without ``by`` within all rows.

    Rows are dealt by ranges of key and order, numbered within each partition,
    and shifted by what earlier partitions hold of the same key. So a key of
    any size is spread, and no task sees more than a partition.
    """
    dealt = rows.repartitionByRange(*by, *order).withColumn("__pid", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    local = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__pid").orderBy(*order)))
    counts = dealt.groupBy(*by, "__pid").agg(F.count(F.lit(1)).alias("__count"))
    before = F.sum("__count").over(Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__pid").alias("__at"), F.coalesce(before, F.lit(0)).alias("__shift"))
    same = F.col("__pid") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return local.join(shifts, same).select(*rows.columns, (F.col("__n") + F.col("__shift")).alias(name))
