"""Confirming as one commit: rules, contexts, histories, and versions that a failed or late job leaves as they are."""

import random

import pytest
from pyspark.sql import functions as F

from twintext.functions import tokens as K
from twintext.operators.confirm import TABLES, confirm, reasons, write_changes
from twintext.operators.snapshots import ConflictError, Snapshots
from twintext.operators.units import CONFIRMED
from twintext.stages import discard, materialise, new_path, ranked, scratch

X = lambda v: ("text", v, None, None)
BR = ("ph", None, 1, "br")
SEGMENTS = f"id long, file_id long, ord int, tokens {K.TOKENS}, target {K.TOKENS}, formats {K.FORMATS}, hash string, status string, updated_at string"
VARIANTS = f"uuid string, lang string, rev int, updated_at string, updated_by string, tokens {K.TOKENS}, plain string, hash string, prev_hash string, next_hash string, quality int, usage_count long, last_used_at string, created_at string"


def project(spark, segments, variants=(), units=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return {
        "segments": frame(segments, SEGMENTS), "variants": frame(variants, VARIANTS), "units": frame(units, "uuid string, rev int, updated_at string, created_at string, created_by string, deleted boolean, attrs map<string,string>"),
        "history": frame([], f"uuid string, lang string, rev int, tokens {K.TOKENS}, quality int, changed_at string, changed_by string"), "vectors": frame([(v[0], v[1], [1.0]) for v in variants], "uuid string, lang string, vec array<float>"),
        "log": frame([], "id long, at string, actor string, action string, subject_type string, subject_id string, detail string"),
    }


def segment(n, source, target, status="translated", file=1, at="t0"):
    return (n, file, n, [X(source)], None if target is None else [X(target)], [], f"h-{source}", status, at)


def test_reasons(spark):
    rows = [segment(1, "a", "b"), segment(2, "a", None), segment(3, "a", " "), segment(4, "a", "b", "locked"), segment(5, "a", "b", "confirmed"), segment(6, "a", "b")]
    wanted = spark.createDataFrame([(1, "t0"), (1, "t0"), (2, "t0"), (3, "t0"), (4, "t0"), (5, "t0"), (6, "old"), (9, "t0")], "id long, base_updated_at string")
    got = {r.id: r.reason for r in reasons(spark.createDataFrame(rows, SEGMENTS), wanted).collect()}
    assert got == {1: None, 2: "blank", 3: "blank", 4: "locked", 5: None, 6: "stale", 9: "not_found"}


def test_a_commit_publishes_all_tables(spark):
    rows = [segment(1, "one", "eins", "confirmed"), segment(2, "two", "zwei", "locked"), segment(3, "three", "drei"), segment(4, "four", None), segment(5, "five", "fünf")]
    store = Snapshots(spark, new_path(spark, "store"))
    assert store.version() == 0 and store.commit(project(spark, rows), 0) == 1
    wanted = store.read("segments").where("id in (3, 5)").select("id", F.col("updated_at").alias("base_updated_at"))
    assert confirm(store, wanted, "en", "de", "t1", "me") == 2
    now = {t: store.read(t).collect() for t in TABLES}
    assert {r.id: (r.status, r.updated_at) for r in now["segments"]}[3] == ("confirmed", "t1") and len(now["units"]) == 2
    three = {r.lang: r for r in now["variants"] if r.plain in ("three", "drei")}
    # Sources in the file without locked ones; targets among confirmed ones, those of this commit included.
    assert (three["en"].prev_hash, three["en"].next_hash) == ("h-one", "h-four")
    hashes = {r.plain: r.hash for r in now["variants"]}
    assert three["de"].next_hash == hashes["fünf"] and three["de"].prev_hash is not None and three["de"].quality == CONFIRMED and three["de"].created_at == "t1"
    assert [(r.id, r.subject_id, r.actor) for r in sorted(now["log"])] == [(1, "3", "me"), (2, "5", "me")]
    # The old version is as it was.
    assert store.read("variants", 1).count() == 0 and store.read("segments", 1).where("status = 'confirmed'").count() == 1


def test_a_failed_or_late_commit_changes_nothing(spark):
    store = Snapshots(spark, new_path(spark, "store"))
    store.commit({"a": spark.range(1), "b": spark.range(2)}, 0)
    broken = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        store.commit({"a": spark.range(9), "b": broken}, 1)
    assert store.version() == 1 and store.read("a").count() == 1
    store.commit({"a": spark.range(5)}, 1)
    with pytest.raises(ConflictError):
        store.commit({"a": spark.range(7)}, 1)
    assert store.version() == 2 and store.read("a").count() == 5 and store.read("b").count() == 2


def test_changes_apply_in_order(spark):
    """Revisions, histories and vectors against a plain loop."""
    rng = random.Random(3)
    texts = [[X("a")], [X("a"), BR], [X("b")], [X("b"), BR, ("ph", None, 2, "tab")]]
    plain = lambda tokens: "".join(t[1] or "" for t in tokens)
    kinds = lambda tokens: sorted(t[3] for t in tokens if t[0] == "ph")
    variants, changes = [], []
    for n in range(60):
        if n % 3:
            t = rng.choice(texts)
            variants.append((f"u{n}", "de", rng.randint(1, 4), "t0", "x", t, plain(t), "h", "p", "q", rng.choice([1, 4]), 7, None, "c0"))
        if n % 4:
            for k in range(rng.randint(1, 4)):
                t = rng.choice(texts)
                changes.append((f"u{n}", "de", k + 1, t, plain(t), f"h{k}", f"p{k}", None))
    new, history, stale = write_changes(spark.createDataFrame(variants, VARIANTS), spark.createDataFrame(changes, f"uuid string, lang string, nth long, tokens {K.TOKENS}, plain string, hash string, prev_hash string, next_hash string"), "t1", "me")
    want, past, gone = {v[0]: (v[2], plain(v[5]), v[7], v[10], v[11], v[13], v[3]) for v in variants}, [], set()
    state = {v[0]: (v[2], v[5], v[10]) for v in variants}
    for uuid, _, k, tokens, text, *_ in changes:
        if uuid in state:
            rev, old, quality = state[uuid]
            if kinds(old) != kinds(tokens):
                past.append((uuid, rev, plain(old), quality))
            if plain(old) != text and any(v[0] == uuid for v in variants):
                gone.add(uuid)
        rev, quality = (state[uuid][0], state[uuid][2]) if uuid in state else (0, 0)
        state[uuid] = (rev + 1, tokens, max(quality, CONFIRMED))
        kept = want.get(uuid)
        want[uuid] = (rev + 1, text, f"h{k - 1}", max(quality, CONFIRMED), kept[4] if kept else 0, kept[5] if kept else "t1", "t1")
    assert {r.uuid: (r.rev, r.plain, r.hash, r.quality, r.usage_count, r.created_at, r.updated_at) for r in new.collect()} == want
    assert sorted((r.uuid, r.rev, "".join(t.v or "" for t in r.tokens), r.quality) for r in history.collect()) == sorted(past)
    assert {r.uuid for r in stale.collect()} == gone


def test_ranks_and_scratch_tables(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    count = {}
    want = {(k, i): count.setdefault(k, []).append(i) or len(count[k]) for k, i in sorted(rows, key=lambda r: r[1])}
    assert {(r.k, r.i): r["rank"] for r in ranked(df, ["k"], ["i"]).collect()} == want
    assert {r.i: r["rank"] for r in ranked(df, [], ["i"]).collect()} == {i: i + 1 for i in range(500)}
    with scratch(spark) as outer:
        with scratch(spark) as keep:
            a, b = keep(materialise(df, "a")), materialise(df, "b")
        assert a.count() == 500
        with pytest.raises(Exception, match="(?i)exist|not found"):
            b.collect()
        c = outer(materialise(a.limit(3), "c"))
    assert c.count() == 3
    discard(c)


def test_pairs_and_contexts_move_no_more_text_than_they_need(spark):
    """Neighbouring lines are paired within their document's row, and accepted segments meet their file once."""
    from twintext.operators import confirm
    from twintext.plans.project_queries import _project
    from twintext.plans.queries import line_pairs

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(line_pairs(spark, "/root/testdata/sf0.001"))
    segments = _project(spark, "/root/testdata/sf0.001")["segments"].where("file_id < 20")
    out = confirm._in_context(segments, segments.where("id % 3 = 0 and status <> 'locked'").select("id"))
    assert "Join" not in plan(out)
    assert out.where("tokens is null or target is null").count() == 0 < out.count()


def test_only_the_last_step_moves_texts(spark, monkeypatch):
    """Contexts, units and places are found by hashes and ids; what a key's changes have in common has no text either."""
    from twintext.operators import confirm as module

    kinds, write = {}, module.materialise

    def seen(df, name, **options):
        kinds[name] = dict(df.dtypes)
        return write(df, name, **options)

    monkeypatch.setattr(module, "materialise", seen)
    rows = [segment(1, "one", "eins"), segment(2, "one", "ein"), segment(3, "two", "zwei")]
    store = Snapshots(spark, new_path(spark, "narrow"))
    store.commit(project(spark, rows), 0)
    confirm(store, store.read("segments").select("id", F.col("updated_at").alias("base_updated_at")), "en", "de", "t1", "me")
    assert {r.plain: r.rev for r in store.read("variants").collect()} == {"one": 2, "ein": 2, "two": 1, "zwei": 1}
    assert {r.plain for r in store.read("history").select(K.plain_text(F.col("tokens")).alias("plain")).collect()} == set()
    for name in ("context", "contexts", "places", "changed-keys"):
        assert not {"tokens", "target", "c"} & set(kinds[name]) and kinds[name].get("plain", "binary") == "binary"
