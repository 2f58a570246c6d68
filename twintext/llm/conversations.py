"""Repair of damaged conversations: the cheapest edits that restore the order of roles.

A conversation is well formed if the initials of its roles read
``(s?(ua)+)?``: perhaps a system turn, then turns of user and assistant in
alternation. Windows flag the faults of every turn; the sorted turns of a block
of a conversation are folded by ``aggregate()``, which carries four (cost,
audit) structs, one for each state of that pattern, through ``least``: the
struct order is least cost first, then the ASCII-least audit.

A conversation can be longer than a task should hold. Its turns are dealt in
order (a range partitioning of narrow rows, without texts), folded in blocks of
at most ``BLOCK_TURNS``, and blocks that do not begin their conversation are
folded from each of the four states; a second fold over blocks picks the path.
Comparing block by block is comparing the strings: two audits of a block take
the same number of turns and end in one, so neither is a prefix of the other.
Texts join last, by the key of their turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintext.llm.storage import materialise

#: Turns of a block that is folded at once.
BLOCK_TURNS = 512
#: Characters of transcript handed on at once for a conversation that spans partitions.
CHUNK = 1 << 20
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. The first and last accept.
STATES = ("n", "s", "u", "a")
_STATE = "struct<cost:bigint,audit:string>"
_TURN = ("__conv", "__turn", "__role", "__digest")


def _more(state: Column, cost: Column | int, op: str) -> Column:
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(op)).alias("audit")))


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _inserted(s: Column) -> Column:
    """The states with the turns inserted that may come next."""
    return F.struct(
        s["n"].alias("n"), s["s"].alias("s"),
        F.least(s["u"], _more(s["n"], INSERT, "I"), _more(s["s"], INSERT, "I"), _more(s["a"], INSERT, "I")).alias("u"),
        F.least(s["a"], _more(s["u"], INSERT, "I"), _more(s["n"], 2 * INSERT, "II"), _more(s["s"], 2 * INSERT, "II")).alias("a"),
    )


def _step(states: Column, turn: Column) -> Column:
    late = F.when(turn["late"], TRUNCATED).otherwise(0)

    def edited(s: Column) -> Column:
        def kept(initial: str, *froms: str) -> list[Column]:
            return [F.when(turn["initial"] == initial, _more(s[k], late + KEEP, "K")) for k in froms]

        def reroled(*froms: str) -> list[Column]:
            return [_more(s[k], late + REROLE, "R") for k in froms]

        return F.struct(
            _more(s["n"], DELETE, "D").alias("n"),
            F.least(_more(s["s"], DELETE, "D"), *kept("s", "n")).alias("s"),
            F.least(_more(s["u"], DELETE, "D"), *kept("u", "n", "s", "a"), *reroled("n", "s", "a")).alias("u"),
            F.least(_more(s["a"], DELETE, "D"), *kept("a", "u"), *reroled("u")).alias("a"),
        )

    deleted = F.struct(*[_more(states[k], DELETE, "D").alias(k) for k in STATES])
    return F.when(turn["forced"], deleted).otherwise(_let(_inserted(states), edited))


def _start(state: str, kind: str = _STATE) -> Column:
    empty = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*[(empty if k == state else F.lit(None)).cast(kind).alias(k) for k in STATES])


def _ordered(turns: DataFrame) -> DataFrame:
    """Distinct turns with their place: ``__pid``, ``__ln`` within it and ``__sub``, the block."""
    text, role = F.col("__text"), F.col("__role")
    bare = F.rtrim(text, F.lit(SPACES))
    narrow = turns.select(
        "__conv", "__turn", "__role", F.sha2(text, 256).alias("__digest"), "__n",
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("late"),
    )
    narrow = narrow.groupBy(*_TURN, "blank", "late").agg(F.sum("__n").alias("__n"))
    order = [F.col("__turn").asc_nulls_first(), role, F.col("__digest")]
    dealt = narrow.repartitionByRange(F.col("__conv"), *order).withColumn("__pid", F.spark_partition_id())
    dealt = materialise(dealt, "turns")
    here = Window.partitionBy("__conv", "__pid").orderBy(*order)
    initial = F.substring(role, 1, 1)
    return (
        dealt.withColumn("__ln", F.row_number().over(here)).withColumn("__sub", F.floor((F.col("__ln") - 1) / BLOCK_TURNS).cast("int"))
        .withColumn("initial", initial)
        .withColumn("pair", F.concat(F.lag("initial").over(here), F.col("initial")))
        .withColumn("new_turn", F.col("__turn").isNotNull() & ~F.col("__turn").eqNullSafe(F.lag("__turn").over(here)))
        .withColumn("again", F.row_number().over(Window.partitionBy("__conv", "__pid", "__role", "__digest").orderBy("__ln")) > 1)
    )


def _spanning(ordered: DataFrame) -> DataFrame:
    """Conversations in more than one partition: one for each boundary at most."""
    ends = ordered.groupBy("__pid").agg(F.min("__conv").alias("lo"), F.max("__conv").alias("hi"))
    ends = ends.select("__pid", F.explode(F.array("lo", "hi")).alias("__conv"))
    found = ends.groupBy("__conv").agg(F.min("__pid").alias("__first"), F.max("__pid").alias("__last"))
    return F.broadcast(found.where("__first < __last").select("__conv", "__first"))


def _illegal(pair: Column) -> Column:
    return pair.isNotNull() & ~pair.isin("su", "ua", "au")


def _blocks(ordered: DataFrame) -> DataFrame:
    """A row per block: its sorted turns, its faults, and its fold from each state that it can begin in."""
    spanning = _spanning(ordered)
    # Of equal turns the first one of a partition may have been seen in an earlier one.
    heads = ordered.where("not again and not blank").join(spanning, "__conv", "left_semi").select(*_TURN, "__pid", "__ln")
    seen = heads.withColumn("k", F.row_number().over(Window.partitionBy("__conv", "__role", "__digest").orderBy("__pid"))).where("k > 1")
    place = ["__conv", "__pid", "__ln"]
    flagged = ordered.join(seen.select(*place, F.lit(True).alias("seen")), place, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    twice = F.col("again") | F.col("seen")
    flagged = flagged.withColumn("duplicate", ~F.col("blank") & twice).withColumn("truncated", F.col("late") & ~F.col("blank") & ~twice)
    turn = F.struct(
        F.col("__ln").alias("ln"), "initial", (F.col("blank") | F.col("duplicate")).alias("forced"), F.col("truncated").alias("late"),
        F.col("__turn").alias("turn"), F.col("__role").alias("role"), F.col("__digest").alias("digest"), F.col("__n").alias("n"),
    )
    n, count = F.col("__n"), lambda flag: F.sum(F.when(flag, 1).otherwise(0))
    blocks = flagged.groupBy("__conv", "__pid", "__sub").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("duplicate"), n).otherwise(n - 1)).alias("duplicate"),
        count(F.col("truncated")).alias("truncated"),
        (count(_illegal(F.col("pair"))) + F.sum(n - 1)).alias("illegal"),
        count(F.col("new_turn")).alias("distinct"), F.min("__turn").alias("lo"), F.max("__turn").alias("hi"),
        (F.sum(n - 1) * DELETE).alias("extra"),
    )
    blocks = blocks.join(spanning, "__conv", "left")
    first = (F.col("__sub") == 0) & (F.col("__first").isNull() | (F.col("__first") == F.col("__pid")))
    starts = F.when(first, F.array(_start("n"))).otherwise(F.array(*[_start(k) for k in STATES]))
    return blocks.withColumn("folds", F.transform(starts, lambda z: F.aggregate("turns", z, _step))).withColumn("spans", F.col("__first").isNotNull()).drop("__first")


def _paths(blocks: DataFrame) -> DataFrame:
    """Per conversation: the faults, the cost, and for each block the state it begins in and its piece of the audit."""
    kind = "struct<cost:bigint,audit:array<string>,states:array<int>>"
    empty = F.struct(F.lit(0).cast("bigint").alias("cost"), F.array().cast("array<string>").alias("audit"), F.array().cast("array<int>").alias("states"))
    zero = F.struct(*[(empty if k == "n" else F.lit(None)).cast(kind).alias(k) for k in STATES])

    def joined(path: Column, block: Column, i: int, k: str) -> Column:
        fold = F.get(block["folds"], F.lit(i))[k]
        both = F.struct(
            (path["cost"] + fold["cost"]).alias("cost"), F.concat(path["audit"], F.array(fold["audit"])).alias("audit"),
            F.concat(path["states"], F.array(F.lit(i))).alias("states"),
        )
        return F.when(path.isNotNull() & fold.isNotNull(), both)

    def through(paths: Column, block: Column) -> Column:
        return F.struct(*[F.least(*[joined(paths[s], block, i, k) for i, s in enumerate(STATES)]).alias(k) for k in STATES])

    def ended(path: Column, cost: int, op: str) -> Column:
        return F.when(path.isNotNull(), F.struct((path["cost"] + cost).alias("cost"), F.concat(path["audit"], F.array(F.lit(op))).alias("audit"), path["states"].alias("states")))

    block = F.struct(
        F.col("__pid").alias("pid"), F.col("__sub").alias("sub"), "folds", "lo", "hi",
        F.get("turns", F.lit(0))["initial"].alias("head"), F.element_at("turns", -1)["initial"].alias("tail"),
    )
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "distinct", "extra")]
    paths = blocks.groupBy("__conv").agg(F.array_sort(F.collect_list(block)).alias("blocks"), *sums, F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Neighbours in different partitions have not met yet.
    seams = F.zip_with(F.slice("blocks", F.lit(1), F.size("blocks") - 1), F.slice("blocks", F.lit(2), F.size("blocks") - 1), lambda a, b: F.struct(
        F.when((b["sub"] == 0) & _illegal(F.concat(a["tail"], b["head"])), 1).otherwise(0).alias("illegal"),
        F.when((b["sub"] == 0) & (a["hi"] == b["lo"]), 1).otherwise(0).alias("same"),
    ))
    paths = paths.withColumn("seams", seams).withColumn("paths", F.aggregate("blocks", zero, through))
    p = F.col("paths")
    best = _let(p, lambda p: F.least(ended(p["n"], 0, ""), ended(p["a"], 0, ""), ended(p["u"], INSERT, "I"), ended(p["s"], 2 * INSERT, "II")))
    # A table, so that the lambdas below read what is computed once.
    paths = materialise(paths.withColumn("best", best).drop("paths"), "best-paths")
    total = lambda field: F.aggregate("seams", F.lit(0), lambda acc, x: acc + x[field])
    pieces = F.transform("blocks", lambda b, i: F.struct(
        b["pid"].alias("__pid"), b["sub"].alias("__sub"), F.get(F.col("best.audit"), i).alias("piece"), F.get(F.col("best.states"), i).alias("state"),
        F.when(i == F.size("blocks") - 1, F.element_at("best.audit", -1)).otherwise("").alias("end"),
    ))
    return paths.select(
        "__conv", F.coalesce(F.col("hi") - F.col("lo") + 1 - (F.col("distinct") - total("same")), F.lit(0)).cast("bigint").alias("gaps"),
        "blank", "duplicate", "truncated", (F.col("illegal") + total("illegal")).alias("illegal"), (F.col("best.cost") + F.col("extra")).alias("cost"), pieces.alias("pieces"),
    )


def _edits(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """A row per block with ``edits``: its turns in order, each with its part of the audit (``I*[KRD]``) and the output turns before it."""
    pieces = paths.select("__conv", F.explode("pieces").alias("p")).select("__conv", "p.*")
    both = blocks.select("__conv", "__pid", "__sub", "spans", "turns").join(pieces, ["__conv", "__pid", "__sub"])

    def placed(ops: Column) -> Column:
        edits = F.zip_with("turns", ops, lambda t, op: F.struct(t.alias("turn"), op.alias("op")))
        opening = F.get(F.filter(edits, lambda e: e["op"] != "D"), F.lit(0))
        system = (F.col("state") == STATES.index("n")) & opening["op"].startswith("K") & (opening["turn"]["initial"] == "s")
        shift = F.when((F.col("state") == STATES.index("u")) | system, 1).otherwise(0)
        before = lambda i: F.length(F.replace(F.array_join(F.slice(ops, F.lit(1), i), ""), F.lit("D"), F.lit("")))
        at = lambda n: F.transform(edits, lambda e, i: F.struct(e["turn"].alias("turn"), e["op"].alias("op"), (before(i) + n).alias("at")))
        return _let(shift, at)

    # The end of the conversation belongs to its last turn. What a lambda reads is bound first, or each element would compute it anew.
    ops = F.regexp_extract_all("piece", F.lit("I*[KRD]"), F.lit(0))
    ended = lambda raw: F.transform(raw, lambda op, i: F.when(i == F.size(raw) - 1, F.concat(op, "end")).otherwise(op))
    return both.select("__conv", "__pid", "__sub", "spans", _let(ops, lambda raw: _let(ended(raw), placed)).alias("edits"))


def _hashed(chunked: bool):
    """Streams lines in order and gives the SHA-256 of each conversation's transcript; where ``chunked``, those that span partitions go on as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest, parts, size, seq, spans = None, None, [], 0, 0, False
        out: list[dict] = []

        def flush(last: bool) -> None:
            nonlocal parts, size, seq
            if spans and parts:
                out.append({"conv": group[0], "pid": group[1], "seq": seq, "text": "\n".join(parts), "sha": None})
                seq, parts, size = seq + 1, [], 0
            if last and not spans:
                out.append({"conv": group[0], "pid": group[1], "seq": 0, "text": None, "sha": digest.hexdigest()})

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("conv", "pid", "spans", "line")]
            for conv, pid, span, line in zip(*[c.to_pylist() for c in columns], strict=True):
                if group != (conv, pid):
                    if group is not None:
                        flush(True)
                    group, digest, parts, size, seq, spans, begun = (conv, pid), hashlib.sha256(), [], 0, 0, span and chunked, False
                if spans:
                    parts.append(line)
                    size += len(line)
                    if size >= CHUNK:
                        flush(False)
                else:
                    digest.update(("\n" + line if begun else line).encode())
                    begun = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if group is not None:
            flush(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv", pa.string()), ("pid", pa.int32()), ("seq", pa.int32()), ("text", pa.string()), ("sha", pa.string())])
    return run


class Repair:
    """What a repair found: ``summary`` (a row per conversation), ``turns`` (a row per repaired turn) and their ``digests``."""

    def __init__(self, turns: DataFrame, id_col: str):
        self._id, self._turns = id_col, turns
        self._blocks = materialise(_blocks(_ordered(turns)), "blocks")
        self._paths = materialise(_paths(self._blocks), "paths")
        self._edits = _edits(self._blocks, self._paths)

    def summary(self) -> DataFrame:
        """The id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit`` of each conversation that has turns."""
        spelled = F.array_join(F.transform("edits", lambda e: F.concat(
            F.regexp_extract(e["op"], "^I*[KRD]", 0), F.repeat(F.lit("D"), (e["turn"]["n"] - 1).cast("int")), F.regexp_extract(e["op"], "I*$", 0),
        )), "")
        parts = self._edits.groupBy("__conv").agg(F.array_sort(F.collect_list(F.struct("__pid", "__sub", spelled.alias("audit")))).alias("parts"))
        audits = parts.select("__conv", F.array_join("parts.audit", "").alias("audit"))
        columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        return self._paths.join(audits, "__conv").select(F.col(f"__conv.{self._id}").alias(self._id), *columns, "audit")

    def _placed(self) -> DataFrame:
        rows = self._edits.select("__conv", "__pid", "spans", F.explode("edits").alias("e")).where("e.op <> 'D'")
        rows = rows.select("__conv", F.col("e.turn.turn").alias("__turn"), F.col("e.turn.role").alias("__role"), F.col("e.turn.digest").alias("__digest"), "__pid", "spans", F.col("e.turn.ln").alias("__ln"), F.col("e.op").alias("op"), F.col("e.at").alias("at"))
        # Equal turns are united before they are dealt; the keys of both sides are then unique.
        texts = self._turns.withColumn("__digest", F.sha2("__text", 256)).groupBy(F.struct(*_TURN).alias("__key")).agg(F.first("__text").alias("__text"))
        rows = rows.withColumn("__key", F.struct(*_TURN)).join(texts, "__key")
        placed = rows.select("__conv", "__pid", "spans", "__ln", "__role", "__text", "at", "op", F.posexplode(F.split("op", "")).alias("item", "edit")).where("edit <> 'D' and edit <> ''")
        # Turns inserted after a deleted last turn: the deletion is no output turn.
        nth = F.col("at") + F.col("item") - F.when(F.col("op").startswith("D"), 1).otherwise(0)
        given = F.when(nth % 2 == 0, "user").otherwise("assistant")
        kept = F.col("edit") != "I"
        return placed.select(
            "__conv", "__pid", "spans", "__ln", "item", "edit",
            F.when(F.col("edit") == "K", F.col("__role")).otherwise(given).alias("role"), F.when(kept, F.col("__text")).otherwise("").alias("text"),
        )

    def turns(self) -> DataFrame:
        """The repaired turns: the id, ``part``, ``line`` and ``item`` (their order), ``edit`` (K, R or I), ``role`` and ``text``."""
        return self._placed().select(F.col(f"__conv.{self._id}").alias(self._id), F.col("__pid").alias("part"), F.col("__ln").alias("line"), "item", "edit", "role", "text")

    def digests(self) -> DataFrame:
        """The id and ``repaired_sha256`` of each conversation with repaired turns: SHA-256 of its ``role:text`` lines.

        Lines stream in order through a task for each part of a conversation;
        only those that span parts go through a second one, in chunks.
        """
        schema = "conv string, pid int, seq int, text string, sha string"
        lines = self._placed().select(F.to_json("__conv").alias("conv"), F.col("__pid").alias("pid"), "spans", F.concat("role", F.lit(":"), "text").alias("line"), "__ln", "item")
        lines = lines.repartition("conv", "pid").sortWithinPartitions("conv", "pid", "__ln", "item").select("conv", "pid", "spans", "line")
        first = materialise(lines.mapInArrow(_hashed(True), schema), "transcripts")
        chunks = first.where("sha is null").repartition("conv").sortWithinPartitions("conv", "pid", "seq")
        second = chunks.select("conv", F.lit(0).alias("pid"), F.lit(False).alias("spans"), F.col("text").alias("line")).mapInArrow(_hashed(False), schema)
        found = first.where("sha is not null").unionByName(second)
        kind = self._turns.select("__conv").schema["__conv"].dataType.simpleString()
        return found.select(F.from_json("conv", kind)[self._id].alias(self._id), F.col("sha").alias("repaired_sha256"))


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> Repair:
    """Finds faults of conversations and the cheapest edits that mend them.

    Turns are taken by ``turn`` (nulls first), then role, then the digest of
    the text. The first fault of a turn counts: blank (no character but ASCII
    spaces), duplicate (its role and text came earlier), truncated (its last
    such character is none of ``. ! ?``). Keep costs 0, Rerole (to user or
    assistant) 3, Delete 4 (blank and duplicate turns must go), Insert (an
    empty user or assistant turn) 3; a truncated turn that stays adds 3. Of the
    cheapest edits those with the ASCII-least initials are taken.

    A null role or text is one space; a null id is a conversation of its own.
    Repeated rows are duplicates; ``copies_col`` may hold how often a row
    counts. Other columns are ignored. An audit is one string, so one
    conversation has at most 2^31 edits; nothing else of it is held as a whole.
    """
    canon = turns.select(
        F.struct(F.col(id_col).alias(id_col)).alias("__conv"), F.col(turn_col).alias("__turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("__role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("__text"), (F.col(copies_col) if copies_col else F.lit(1)).cast("bigint").alias("__n"),
    )
    return Repair(canon, id_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of ``conv_id:turn`` modulo 20, and ``copies``: how often each counts.

    0 drops the row, 1 empties its text, 2 takes ``. ! ?`` out of it, 3 repeats
    it, 4 makes its role user. Nulls are one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = conversations.select("conv_id", "turn", F.when(h == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(h == 3, 2).otherwise(1).alias("copies"), h.alias("__h"))
    return rows.where("__h <> 0").drop("__h")
