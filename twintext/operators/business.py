"""Words, prices, payables, deadlines and records around translation orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twintext.functions.text import TIERS

# The legal moves of an order.
TRANSITIONS = {"submitted": ("approved", "cancelled"), "approved": ("in_progress", "cancelled"), "in_progress": ("delivered", "cancelled"), "delivered": (), "cancelled": ()}
OPEN = ("submitted", "approved", "in_progress")
# The legal moves of an assignment, with the party that makes each.
ASSIGNMENT_MOVES = (
    ("offered", "accepted", "vendor"), ("offered", "declined", "vendor"), ("pool_open", "claimed", "vendor"), ("claimed", "accepted", "vendor"), ("claimed", "declined", "vendor"),
    ("accepted", "in_progress", "vendor"), ("in_progress", "delivered", "vendor"), ("delivered", "reviewed", "pm"),
)


def order_moves(spark: SparkSession) -> DataFrame:
    """The legal moves of orders: from_state, to_state."""
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_state string, to_state string")


def assignment_moves(spark: SparkSession) -> DataFrame:
    """The legal moves of assignments: from_state, to_state, party."""
    return spark.createDataFrame(list(ASSIGNMENT_MOVES), "from_state string, to_state string, party string")


def next_statuses(moves: DataFrame) -> DataFrame:
    """Per state where it can go next; a state without any is terminal."""
    states = moves.select(F.explode(F.array("from_state", "to_state")).alias("state")).distinct()
    return states.join(moves, F.col("state") == F.col("from_state"), "left").groupBy("state").agg(F.array_join(F.array_sort(F.collect_set("to_state")), ",").alias("next")).withColumn("terminal", F.col("next") == "")


def changed_words(base: DataFrame, new: DataFrame) -> DataFrame:
    """Per file of ``new`` (file, hash, words): all words, and those of segments whose hash ``base`` lacks."""
    known = base.select("hash", F.lit(True).alias("__known")).distinct()
    return new.join(known, "hash", "left").groupBy("file").agg(F.sum("words").alias("words"), F.sum(F.when(F.col("__known"), 0).otherwise(F.col("words"))).alias("changed"))


def complete_sum(col: str) -> Column:
    """The sum, or null where a value is missing or there is none."""
    return F.when(F.count(F.lit(1)) == F.count(col), F.sum(col))


def client_rates(defaults: DataFrame, own: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Default rates with a client's own rate, taken as a whole row, in place of each that it has."""
    mine = own.select(*on, F.struct(*values).alias("__own"))
    row = F.coalesce("__own", F.struct(*values))
    return defaults.join(mine, on, "full").select(*on, *[row[v].alias(v) for v in values], F.col("__own").isNotNull().alias("own"))


def billable(words: Column, per_file: Column) -> Column:
    """A file's words, at least ``per_file`` unless it has none."""
    return F.when(words == 0, F.lit(0)).otherwise(F.greatest(words, F.coalesce(per_file, F.lit(0))))


def line_total(rate: Column, minimum: Column, words: Column) -> Column:
    return F.greatest(words * rate, F.coalesce(minimum, F.lit(0.0)))


def estimate(files: DataFrame, rates: DataFrame) -> DataFrame:
    """Price of each order and target language: files (order_id, tgt_lang, words), rates (tgt_lang, rate, minimum, per_file).

    Rates are a row a language, and go to the files: by language these would
    meet in as many tasks as there are languages.
    """
    lines = files.join(F.broadcast(rates), "tgt_lang").groupBy("order_id", "tgt_lang").agg(F.sum(billable(F.col("words"), F.col("per_file"))).alias("words"), F.max("rate").alias("rate"), F.max("minimum").alias("minimum"))
    return lines.select("order_id", "tgt_lang", "words", line_total(F.col("rate"), F.col("minimum"), F.col("words")).alias("price"))


def quote_stands(price: Column, stored: Column) -> Column:
    return F.abs(price - stored) < 0.005


def agenda(orders: DataFrame, today: Column) -> DataFrame:
    """Open orders by due date (a date): overdue, today, later or undated."""
    due = F.col("due_at")
    bucket = F.when(due.isNull(), "undated").when(due < today, "overdue").when(due == today, "today").otherwise("later")
    return orders.where(F.col("status").isin(*OPEN)).withColumn("bucket", bucket)


#: Most leads that notices have.
MAX_LEADS = 100


def notices_due(jobs: DataFrame, leads: DataFrame, fired: DataFrame, now: Column) -> DataFrame:
    """Notices (job_id, lead_hours) whose time has come: due less the lead, not before the job was made, not sent yet."""
    # A few leads: each job is exploded into its notices.
    hours = [r[0] for r in leads.select("lead_hours").distinct().limit(MAX_LEADS + 1).collect()]
    if len(hours) > MAX_LEADS:
        raise ValueError(f"there are at most {MAX_LEADS} leads")
    at = F.col("due_at") - F.make_dt_interval(hours=F.col("lead_hours"))
    rows = jobs.withColumn("lead_hours", F.explode(F.array(*[F.lit(h) for h in hours]).cast("array<int>"))).withColumn("notice_at", at)
    return rows.where((F.col("notice_at") <= now) & (F.col("notice_at") >= F.col("created_at"))).join(fired, ["job_id", "lead_hours"], "left_anti").select("job_id", "lead_hours", "notice_at")


def payable(words: DataFrame, rates: DataFrame, by: list[str]) -> DataFrame:
    """Words times micros per tier (by, tier, words; tier, micros), in tier order; unpriced tiers pay 0 and are counted."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    rows = words.groupBy(*by, "tier").agg(F.sum("words").alias("words")).join(rates, "tier", "left")
    rows = rows.withColumn("micros_due", (F.col("words") * F.coalesce("micros", F.lit(0))).cast("long")).withColumn("place", place)
    return rows.groupBy(*by).agg(
        F.sum("words").alias("words"), F.sum("micros_due").alias("micros_due"), F.sum(F.when(F.col("micros").isNull(), F.col("words")).otherwise(0)).alias("unpriced_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tier"))), lambda x: x["tier"]), ",").alias("tiers"),
    )


def currency_totals(payables: DataFrame) -> DataFrame:
    """Count, paid, unpaid and total micros by currency; null is a currency of its own."""
    paid = F.when(F.col("paid"), F.col("micros")).otherwise(0)
    return payables.groupBy("currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum(paid).alias("paid"), F.sum(F.col("micros") - paid).alias("unpaid"), F.sum("micros").alias("total"),
        F.count(F.when(F.col("micros").isNull(), 1)).alias("incomplete"),
    )


def vendor_record(assignments: DataFrame, by: str = "vendor_id") -> DataFrame:
    """Answered, accepted, delivered, timed and on-time assignments (status, deadline, delivered_at)."""
    took = F.col("status").isin("accepted", "in_progress", "delivered", "reviewed")
    gave = F.col("status").isin("delivered", "reviewed")
    timed = gave & F.col("deadline").isNotNull() & F.col("delivered_at").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    return assignments.groupBy(by).agg(
        n(took | (F.col("status") == "declined")).alias("answered"), n(took).alias("accepted"), n(gave).alias("delivered"), n(timed).alias("timed"),
        n(timed & (F.col("delivered_at") <= F.col("deadline"))).alias("on_time"),
    )


def exclusion_reasons(pair_known: Column, specialty_known: Column, capacity: Column, in_pool: Column) -> Column:
    """Why a vendor can't take a job, in order; empty if nothing speaks against it."""
    return F.array_compact(F.array(
        F.when(~pair_known, "language_pair"), F.when(~specialty_known, "specialty"), F.when(capacity == "busy", "busy"), F.when(capacity == "away", "away"), F.when(~in_pool, "not_in_client_pool"),
    ))


def illegal_moves(log: DataFrame, moves: DataFrame, by: str, order: list[str], state: str, party: str | None = None) -> DataFrame:
    """Steps of an event log that no move (from_state, to_state, and party where its column is named) allows."""
    w = Window.partitionBy(by).orderBy(*order)
    steps = log.withColumn("from_state", F.lag(state).over(w)).withColumn("to_state", F.col(state)).where("from_state is not null and from_state <> to_state")
    steps = steps.withColumn("party", F.col(party)) if party else steps
    return steps.join(moves, ["from_state", "to_state", *["party"] * bool(party)], "left_anti")


def status_counts(rows: DataFrame, by: DataFrame, statuses: DataFrame, by_col: str, status_col: str) -> DataFrame:
    """Rows by group and status, zero where there is none."""
    counted = rows.groupBy(by_col, status_col).agg(F.count(F.lit(1)).alias("n"))
    # Every group meets every status, of which there are a few: rows are exploded, not joined.
    listed = statuses.select(F.sort_array(F.collect_set(status_col)).alias("s")).first()["s"]
    grid = by.select(by_col).distinct().withColumn(status_col, F.explode(F.array(*[F.lit(x) for x in listed])))
    return grid.join(counted, [by_col, status_col], "left").select(by_col, status_col, F.coalesce("n", F.lit(0)).alias("n"))


def progress(rows: DataFrame, by: str) -> DataFrame:
    """Confirmed and all segments and words (status, words, locked), locked ones apart."""
    done = F.col("status") == "confirmed"
    return rows.where("not locked").groupBy(by).agg(
        F.count(F.when(done, 1)).alias("confirmed"), F.count(F.lit(1)).alias("segments"), F.sum(F.when(done, F.col("words")).otherwise(0)).alias("confirmed_words"), F.sum("words").alias("words"),
    )


def ledger(payments: DataFrame, by: str = "assignment_id") -> DataFrame:
    """The latest payment event (kind, by event id) of each assignment."""
    return payments.groupBy(by).agg(F.max_by("kind", "event_id").alias("kind"), F.max("event_id").alias("event_id"))


def fold_file(rows: DataFrame, key: list[str]) -> DataFrame:
    """A file's segments joined in order with spaces: the target where there is one, else the source."""
    text = F.coalesce("target", "source")
    parts = F.array_sort(F.collect_list(F.struct("ord", text.alias("x"), F.col("target").isNotNull().alias("t"))))
    out = rows.groupBy(*key).agg(parts.alias("p"))
    return out.select(*key, F.array_join(F.transform("p", lambda x: x["x"]), " ").alias("text"), F.size(F.filter("p", lambda x: x["t"])).cast("long").alias("translated"), F.size("p").cast("long").alias("segments"))


def order_list(orders: DataFrame, statuses: tuple[str, ...] = (), client: int | None = None) -> DataFrame:
    """Orders (order_id, client_id, status, created_at) of the statuses and client chosen, newest first."""
    rows = orders.where(F.col("status").isin(*statuses)) if statuses else orders
    return (rows if client is None else rows.where(F.col("client_id") == client)).orderBy(F.col("created_at").desc(), F.col("order_id").desc())


def orders_with_events(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Orders with the number of their events (order_id, id, kind) and the last one's kind."""
    last = events.groupBy("order_id").agg(F.count(F.lit(1)).alias("events"), F.max_by("kind", "id").alias("last_event"))
    return orders.join(last, "order_id", "left").withColumn("events", F.coalesce("events", F.lit(0)))


def ledger_lines(assignments: DataFrame, payments: DataFrame, vendor: int | None = None, since: Column | None = None, until: Column | None = None, status: str | None = None) -> DataFrame:
    """Assignments (assignment_id, vendor_id, at, currency, micros) with ``payment``, the kind of the latest payment event, or unpaid."""
    last = payments.groupBy("assignment_id").agg(F.max_by("kind", "event_id").alias("payment"))
    rows = assignments.join(last, "assignment_id", "left").withColumn("payment", F.coalesce("payment", F.lit("unpaid")))
    chosen = [F.col("vendor_id") == vendor if vendor is not None else None, F.col("at") >= since if since is not None else None, F.col("at") < until if until is not None else None, F.col("payment") == status if status else None]
    for c in chosen:
        rows = rows if c is None else rows.where(c)
    return rows


def payable_lines(lines: DataFrame) -> DataFrame:
    """Per currency and payment the number of assignments and their micros; a null currency comes last."""
    return lines.groupBy("currency", "payment").agg(F.count(F.lit(1)).alias("n"), F.sum("micros").alias("micros")).orderBy(F.col("currency").asc_nulls_last(), "payment")


def days_to_pay(delivered: Column, paid: Column) -> Column:
    """Whole days from delivery to payment, null before it."""
    return F.when(paid >= delivered, F.datediff(paid, delivered))


def file_problem(content_bytes: Column, text: Column, lang: Column) -> Column:
    """Why a file's words aren't counted, or null: too large, binary, or of a language that doesn't space its words."""
    return (
        F.when(content_bytes > 32 << 20, "too_large").when(F.coalesce(text.rlike(r"[\x00-\x08\x0E-\x1F]"), F.lit(True)), "not_text")
        .when(F.split(F.lower(lang), "[-_]")[0].isin("zh", "ja", "th", "lo", "km", "my", "bo"), "unspaced")
    )
