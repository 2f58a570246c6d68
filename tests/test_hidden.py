"""Hidden tags through edits: the cases of the rule, and what holds for any source and edit."""

import random

import pytest

from twintext.functions import tokens as K
from twintext.functions.hidden import carry, carry_hidden_tags, shown

X = lambda v: ("text", v, None, None)
O = lambda n: ("open", None, n, None)  # noqa: E731, E741
C = lambda n: ("close", None, n, None)
P = lambda n: ("ph", None, n, None)
FORMATS = [
    (1, "other", False, "run", "<w:r><w:sz/>", "</w:r>"), (2, "b", True, "run", "<w:r><w:b/>", "</w:r>"), (3, "other", False, "run", "<w:r><w:up/>", "</w:r>"), (4, "link", True, "inline", "<w:hyperlink>", "</w:hyperlink>"),
    (5, "other", False, "inline", "<w:ins>", "</w:ins>"), (6, "bookmark", False, "block", '<w:bookmarkStart w:id="7"/>', ""), (7, "bookmark", False, "block", '<w:bookmarkEnd w:id="7"/>', ""), (8, "br", True, "in-run", "<w:br/>", ""),
    (9, "other", False, "block", "<w:proofErr/>", ""),
]


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        # The same visible target is the source.
        ([O(1), X("One"), C(1), P(9)], [X("O"), X("ne")], [O(1), X("One"), C(1), P(9)]),
        # The run of most text holds everything; a placeholder before all text leads, one behind trails.
        ([P(9), O(1), X("One two"), C(1), X("x")], [X("Eins")], [O(1), P(9), X("Eins"), C(1)]),
        ([O(1), X("One"), C(1), P(9)], [X("Eins")], [O(1), X("Eins"), P(9), C(1)]),
        # Plain text wins over a shorter run, which keeps its own words where they stand apart.
        ([X("See note "), O(3), X("8"), C(3), X(" below")], [X("Siehe 18 und 8 unten")], [X("Siehe 18 und "), O(3), X("8"), C(3), X(" unten")]),
        ([X("See note "), O(3), X("8"), C(3), X(" below")], [X("Siehe 1,8 unten")], [X("Siehe 1,8 unten"), O(3), C(3)]),
        # A run that came last holds only what ends the text.
        ([X("In the year 2021."), O(3), X("1"), C(3)], [X("Im 1 Jahr 2021.1")], [X("Im 1 Jahr 2021."), O(3), X("1"), C(3)]),
        ([X("In the year 2021."), O(3), X("1"), C(3)], [X("Im 1 Jahr 2021")], [X("Im 1 Jahr "), X("2021"), O(3), C(3)]),
        # A wrapper around all stays, around a part it is empty.
        ([O(5), X("All new"), C(5)], [X("Alles neu")], [O(5), X("Alles neu"), C(5)]),
        ([O(5), X("Some"), C(5), X(" new")], [X("Etwas neu")], [X("Etwas neu"), O(5), C(5)]),
        # A range over text grows; one over nothing stays behind.
        ([X("a "), P(6), X("b"), P(7)], [X("c")], [P(6), X("c"), P(7)]),
        ([X("a "), P(6), P(7)], [X("c")], [X("c"), P(6), P(7)]),
        # Inside a visible pair, and where the target leaves the pair out.
        ([O(4), O(1), X("link"), C(1), C(4), X(" rest of it")], [X("Rest "), O(4), X("Verweis"), C(4)], [X("Rest "), O(4), O(1), X("Verweis"), C(1), C(4)]),
        ([O(4), O(1), X("link"), C(1), C(4), X(" rest of it")], [X("Rest")], [X("Rest"), O(1), C(1)]),
        # Nothing left, and other hidden tags in the target.
        ([O(1), X("One"), C(1)], [], [O(1), C(1)]),
        ([O(1), X("One"), C(1)], [O(3), X("Eins"), C(3), P(9)], [O(1), X("Eins"), C(1)]),
    ],
)
def test_cases(source, target, want):
    join = lambda xs: shown(xs, {})
    assert join(carry(target, source, FORMATS)) == join(want)


def stream(rng, ids, depth=0):
    out = []
    for _ in range(rng.randint(0, 4)):
        kind = rng.random()
        if kind < 0.5 or not ids:
            out.append(X(rng.choice(["8", " ", "one two", "note 8", "x.", "Ünd 1,8"])))
        else:
            n = ids.pop(rng.randrange(len(ids)))
            if FORMATS[n - 1][3] in ("run", "inline"):
                out += [O(n), *stream(rng, ids, depth + 1), C(n)]
            else:
                out.append(P(n))
    return out


def test_what_holds_for_any_source_and_edit():
    rng = random.Random(9)
    table = {f[0]: f for f in FORMATS}
    for _ in range(3000):
        source = stream(rng, list(range(1, 10)))
        target = stream(rng, [n for n in range(1, 10) if rng.random() < 0.6])
        out = carry(target, source, FORMATS)
        assert shown(out, table) == shown(target, table)
        hidden = lambda xs: sorted((x for x in xs if x[0] != "text" and not table[x[2]][2]), key=repr)
        assert hidden(out) == hidden(source)
        stack = []
        for t, _, n, _ in out:
            if t == "open":
                stack.append(n)
            elif t == "close":
                assert stack.pop() == n
        assert not stack
        assert carry(out, source, FORMATS) == out


def test_tags_that_do_not_nest_keep_all_hidden_ones():
    out = carry([O(2), X("a")], [O(1), X("b"), C(1)], FORMATS)
    assert out == [O(2), X("a"), O(1), C(1)]


def test_column(spark):
    row = lambda xs, names: [dict(zip(names, x, strict=True)) for x in xs]
    t, f = ("t", "v", "id", "k"), ("id", "kind", "visible", "placement", "open", "close")
    source = [O(1), X("One"), C(1), O(2), X("b"), C(2)]
    data = [
        (1, row([X("Eins"), O(2), X("b"), C(2)], t), row(source, t), row(FORMATS[:2], f)), (2, None, row(source, t), row(FORMATS, f)),
        (3, row([X("a"), X("b")], t), row([X("ab")], t), row(FORMATS[1:2], f)), (4, row([X("a"), X("c")], t), row([X("ab")], t), []),
    ]
    df = spark.createDataFrame(data, f"id int, target {K.TOKENS}, source {K.TOKENS}, formats {K.FORMATS}")
    got = {r.id: r.x and [tuple(x) for x in r.x] for r in df.select("id", carry_hidden_tags(df.target, df.source, df.formats).alias("x")).collect()}
    assert got == {1: [O(1), X("Eins"), O(2), X("b"), C(2), C(1)], 2: None, 3: [X("ab")], 4: [X("ac")]}
