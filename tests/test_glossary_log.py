"""Glossary rulings by the cases of their rules, and sessions replayed against a plain state machine."""

import random

import pytest

from twintext.operators import glossary, glossary_log

DECISIONS = "id long, term_id long, lang string, chosen string, kind string, project string, segment long, decided_at string"
VARIANTS = "term_id long, lang string, variant_id long, plain string, forbidden boolean"


def proposals(spark, decisions, variants=((1, "de", 1, "rechnung", False), (1, "de", 2, "faktura", False))):
    df = spark.createDataFrame([(i, 1, lang, chosen, kind, p, s, f"t{i:03}") for i, (lang, chosen, kind, p, s) in enumerate(decisions, 1)], DECISIONS)
    return [(r.lang, r.chosen, r.preferred, r.segments) for r in glossary.exception_proposals(df, spark.createDataFrame(list(variants), VARIANTS)).collect()]


def exceptions(n, lang="de"):
    return [(lang, "faktura", "segment_exception", "p", i) for i in range(n)]


@pytest.mark.parametrize(
    ("decisions", "want"),
    [
        (exceptions(3), [("de", "faktura", "rechnung", 3)]), (exceptions(2), []), ([*exceptions(2), *exceptions(2)], []),
        # A ruling for any rendering of the term starts again, also in a region of the language.
        ([*exceptions(3), ("de", "rechnung", "override", None, None)], []), ([*exceptions(3), ("de-AT", "rechnung", "choice", None, None), *exceptions(1)], []), ([*exceptions(3), ("fr", "facture", "choice", None, None)], [("de", "faktura", "rechnung", 3)]),
        # Projects count apart, decisions without a segment don't.
        ([("de", "faktura", "segment_exception", p, 1) for p in "abc"], [("de", "faktura", "rechnung", 3)]), ([("de", "faktura", "segment_exception", None, i) for i in range(5)], []),
        # Accepted: it is preferred from then on.
        ([*exceptions(3), ("de", "faktura", "override", None, None), *exceptions(4)], []),
    ],
)
def test_proposals(spark, decisions, want):
    assert proposals(spark, decisions) == want


def test_forbidden_gone_and_deleted_are_not_proposed(spark):
    assert proposals(spark, exceptions(3), [(1, "de", 1, "rechnung", False), (1, "de", 2, "faktura", True)]) == []
    assert proposals(spark, exceptions(3), [(1, "de", 1, "rechnung", False)]) == []


def test_flags(spark):
    found = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.4), ("b", "x", 0.5), ("b", "x", 0.9), ("c", "x", 0.6), ("d", "x", 0.9), ("d2", "z", 0.9), ("gone", "x", 0.1)], "term_key string, rendering_key string, confidence double")
    keys = spark.createDataFrame([(k,) for k in ["a", "b", "c", "d", "d2", "none"]], "term_key string")
    asked = spark.createDataFrame([("d", "other"), ("d2", "z"), ("none", "q")], "term_key string, preferred_key string")
    got = {r.term_key: (r.renderings, list(r.reasons)) for r in glossary.flag_terms(keys, found, asked).collect()}
    assert got == {"a": (2, ["inconsistent"]), "c": (1, ["uncertain"]), "d": (1, ["glossary_mismatch"])}
    assert sorted(r.term_key for r in glossary.flag_terms(keys, None, asked).collect()) == ["a", "b", "c"]


EVENTS = "session_id long, seq long, op string, key string, rendering string, edit string, term_id long, offered array<string>"


def replay(events):
    """States and refusals of one session, event by event."""
    flags, closed, refused = {}, None, []
    for _, seq, op, key, rendering, edit, term, offered in sorted(set(map(repr, events)) and {e[1]: e for e in events}.values(), key=lambda e: e[1]):
        text = (rendering or "").strip().lower()
        if op not in glossary_log.SESSION_OPS:
            refused.append((seq, "unknown"))
        elif closed:
            refused.append((seq, "closed"))
        elif op in ("commit", "discard"):
            closed = op
        elif op == "flag":
            if key in flags:
                refused.append((seq, "flagged twice"))
            else:
                flags[key] = {"offered": offered, "term": term, "state": "flagged", "kind": None, "rendering": None, "rejected": None}
        elif key not in flags:
            refused.append((seq, "no flag"))
        elif op in ("choose", "propose") and not text:
            refused.append((seq, "no rendering"))
        elif op == "propose" and flags[key]["term"] is None:
            refused.append((seq, "no entry"))
        elif op == "propose" and edit not in glossary_log.EDITS:
            refused.append((seq, "unknown edit"))
        else:
            f = flags[key]
            f |= {"state": {"choose": "decided", "propose": "proposed", "skip": "skipped"}.get(op, "flagged"), "kind": None, "rendering": None, "rejected": None}
            if op in ("choose", "propose"):
                others = [o for o in f["offered"] if o.strip().lower() != text]
                kind = ("accepted_suggestion" if len(others) < len(f["offered"]) else "custom") if op == "choose" else {"deprecate": "deprecation"}.get(edit, edit)
                f |= {"kind": kind, "rendering": rendering, "rejected": others}
    status = {"commit": "committed", "discard": "discarded", None: "open"}[closed]
    return {k: (f["state"], f["kind"], f["rendering"], f["rejected"], status) for k, f in flags.items()}, sorted(refused)


def test_sessions_replay_in_any_order(spark):
    rng = random.Random(6)
    events = []
    for session in range(25):
        for seq in range(rng.randint(1, 30)):
            op = rng.choice(["flag", "flag", "choose", "choose", "propose", "skip", "reopen", "rename", *(["commit"] if seq > 12 else []), *(["discard"] if seq > 20 else [])])
            events.append((session, seq, op, rng.choice(["a", "b", "c"]), rng.choice(["X", " x ", "y", "", None]), rng.choice(["override", "deprecate", "other"]), rng.choice([None, 1]), ["x", "Z"]))
    shuffled = events + events[::4]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, EVENTS)
    states = glossary_log.session_states(df)
    got, lost = {}, {}
    for r in states.collect():
        got.setdefault(r.session_id, {})[r.key] = (r.state, r.kind, r.rendering, r.rejected, r.status)
    for r in glossary_log.session_refusals(df).collect():
        lost.setdefault(r.session_id, []).append((r.seq, r.refused))
    written = {(r.session_id, r.key) for r in glossary_log.committed_entries(states).collect()}
    for session in range(25):
        want, refused = replay([e for e in events if e[0] == session])
        assert got.get(session, {}) == want and sorted(lost.get(session, [])) == refused
        assert {k for s, k in written if s == session} == {k for k, v in want.items() if v[4] == "committed" and v[0] in ("decided", "proposed")}
