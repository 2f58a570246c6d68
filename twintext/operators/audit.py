"""Hash-chained audit logs: each link is checked on its own, so a chain is verified in parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "genesis:"


def canonical(*cols: str) -> Column:
    """The event's fields as a JSON list; nulls are literal."""
    field = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"""(?s)^\{"x":(.*)\}$""", 1)
    return F.concat(F.lit("["), F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit("null")).otherwise(field(c)) for c in cols]), F.lit("]"))


def chained(events: DataFrame, by: str, order: str, body: str = "body") -> DataFrame:
    """Adds ``chain_hash``: SHA-256 of the hash before and the row.

    Appending is sequential within one log. A log's rows come to one task in
    order and stream through it in batches; only the last hash is held.
    """
    columns = events.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema)}, chain_hash string"

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, ""
        for batch in batches:
            out = []
            for log, text in zip(batch.column(by).to_pylist(), batch.column(body).to_pylist(), strict=True):
                if of != (log,):
                    of, last = (log,), hashlib.sha256(f"{GENESIS}{log}".encode()).hexdigest()
                last = hashlib.sha256((last + text).encode()).hexdigest()
                out.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*columns, "chain_hash"])

    return events.repartition(by).sortWithinPartitions(by, order).mapInArrow(append, schema)


def verify_chain(log: DataFrame, by: str, order: str, body: str = "body") -> DataFrame:
    """Per log: its events, and the first whose hash doesn't follow from the one before or whose id repeats, or null."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.coalesce(F.lag("chain_hash").over(w), F.sha2(F.concat(F.lit(GENESIS), F.col(by).cast("string")), 256))
    good = (F.sha2(F.concat(before, F.col(body)), 256) == F.col("chain_hash")) & ~F.coalesce(F.lag(order).over(w) == F.col(order), F.lit(False))
    return log.select(by, order, good.alias("good")).groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.min(F.when(~F.col("good"), F.col(order))).alias("first_bad"))


def by_subject(log: DataFrame, subject_type: str, subject_id: str) -> DataFrame:
    """A subject's events, oldest first."""
    return log.where((F.col("subject_type") == subject_type) & (F.col("subject_id") == subject_id)).orderBy("id")


def by_batch(log: DataFrame, batch_id: int) -> DataFrame:
    """The events that a batch event started, and itself."""
    return log.where((F.col("batch_id") == batch_id) | (F.col("id") == batch_id)).orderBy("id")


def page_of(log: DataFrame, tenant_id: int, before: int | None = None, limit: int = 100) -> DataFrame:
    """A tenant's newest events below the id ``before``: one page by keyset."""
    rows = log.where(F.col("tenant_id") == tenant_id)
    return (rows if before is None else rows.where(F.col("id") < before)).orderBy(F.col("id").desc()).limit(limit)


def erased(log: DataFrame, actor: str) -> DataFrame:
    """The log with an actor's label erased; nothing else of an event ever changes."""
    return log.withColumn("actor_label", F.when(F.col("actor") == actor, F.lit("[erased]")).otherwise(F.col("actor_label")))


def forbidden_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events (id, change) that a later snapshot removed or altered otherwise than by erasing a label."""
    fixed = [c for c in before.columns if c not in ("id", "actor_label")]
    new = after.select("id", F.struct(*fixed).alias("__new"), F.col("actor_label").alias("__label"))
    both = before.join(new, "id", "left")
    label = F.col("__label").eqNullSafe(F.col("actor_label")) | F.coalesce(F.col("__label") == "[erased]", F.lit(False))
    change = F.when(F.col("__new").isNull(), "deleted").when(~F.struct(*fixed).eqNullSafe(F.col("__new")) | ~label, "updated")
    return both.select("id", change.alias("change")).where("change is not null")
