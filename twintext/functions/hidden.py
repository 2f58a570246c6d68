"""Hidden tags through an edit: a target that a translator made of visible tags alone gets its source's hidden ones.

Source and target are read as trees. The pairs that a translator sees are
containers (and so is the whole); each hidden tag of the source finds its place
in the container of the target that it was in, by what it held there:

- the hidden run that most of a container's own text was in holds all of the
  container's target text;
- another hidden run holds its own words where the target has kept them apart
  from other words, one that came last only where they end the text;
- a hidden pair around all of a container stays around all of it;
- a placeholder before all text, or the start of a range over some, leads, any
  other trails;
- what is left trails, empty; what was in a pair that the target leaves out goes
  to the nearest container around it.

So each hidden tag of the source comes once, whatever the target had.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from twintext.functions import tokens as K

# White space, what joins the digits of a number, and the elements that begin and end ranges.
SPACES = "\t\n\x0b\x0c\r \xa0                　﻿"
NUMBER_JOINERS = ".,:/'’\xa0  -"
_RANGE = re.compile(r'^<w:(bookmark|commentRange|perm)(Start|End)\b[^>]*\bw:id="([^"]*)"')

Token = tuple


@dataclass(eq=False)
class Item:
    """A token of a stream; a pair holds what is between its tags."""

    token: Token
    at: int
    parent: Item | None
    visible: bool = True
    run: bool = False
    end: int = -1
    close: Token | None = None
    inside: list[Item] = field(default_factory=list)

    def around(self) -> Iterator[Item]:
        x = self.parent
        while x:
            yield x
            x = x.parent

    def home(self) -> Item:
        """The visible pair that it is directly in, or the whole."""
        return next(x for x in self.around() if x.visible)

    def walk(self) -> Iterator[Item]:
        for x in self.inside:
            yield x
            yield from x.walk()

    def words(self) -> str:
        return (self.token[1] or "").strip(SPACES) if self.token[0] == "text" else ""


def tree(tokens: list[Token], formats: dict[int, tuple]) -> Item | None:
    """The stream as a tree; null if its tags don't nest. A tag without a format is visible."""
    root = Item(("open", None, None, None), -1, None)
    here = root
    for at, token in enumerate(tokens):
        t, _, n, _ = token
        if t == "close":
            if here is root or here.token[2] != n:
                return None
            here.close, here.end = token, at
            here = here.parent
            continue
        f = formats.get(n) if t != "text" else None
        x = Item(token, at, here, f is None or f[2] is not False, f is not None and f[3] == "run", at)
        here.inside.append(x)
        if t == "open":
            here = x
    root.end = len(tokens)
    return root if here is root else None


def joined(tokens: list[Token]) -> list[Token]:
    out: list[Token] = []
    for token in tokens:
        if token[0] != "text":
            out.append(token)
        elif token[1]:
            before = out.pop()[1] if out and out[-1][0] == "text" else ""
            out.append(("text", before + token[1], None, None))
    return out


def shown(tokens: list[Token], formats: dict[int, tuple]) -> list[Token]:
    """What the translator sees."""
    return joined([x for x in tokens if x[0] == "text" or x[2] not in formats or formats[x[2]][2] is not False])


def _kind(char: str) -> str:
    return unicodedata.category(char)[0] if char else ""


def _apart(text: str, words: str) -> Iterator[int]:
    """Where the words stand apart: no letter goes on beside a letter, no digit beside a digit, nor through a separator."""

    def glued(edge: str, beside: str, beyond: str) -> bool:
        kind = _kind(edge)
        if kind == "N" and beside and beside in NUMBER_JOINERS and _kind(beyond) == "N":
            return True
        return kind in ("L", "N") and _kind(beside) == kind

    at = text.find(words)
    while at >= 0:
        end = at + len(words)
        if not glued(words[0], text[max(at - 1, 0) : at], text[max(at - 2, 0) : max(at - 1, 0)]) and not glued(words[-1], text[end : end + 1], text[end + 1 : end + 2]):
            yield at
        at = text.find(words, at + 1)


def _ending(text: str, words: str) -> Iterator[int]:
    """Where the words end the text but for spaces and punctuation."""
    at = text.rfind(words)
    if at >= 0 and all(c in SPACES or _kind(c) == "P" for c in text[at + len(words) :]):
        kind = _kind(words[0])
        if kind not in ("L", "N") or _kind(text[at - 1 : at] if at else "") != kind:
            yield at


@dataclass
class Plan:
    """What a container of the target gets."""

    lead: list[Token] = field(default_factory=list)
    wraps: list[Item] = field(default_factory=list)
    run: Item | None = None
    others: list[Item] = field(default_factory=list)
    trail: list[Item] = field(default_factory=list)


def _own_text(run: Item) -> str:
    """The text whose innermost run it is."""
    texts = [x for x in run.walk() if x.words() and next(y for y in x.around() if y.run) is run]
    return "".join(x.token[1] for x in texts).strip(SPACES)


def _main_run(container: Item) -> Item | None:
    """The hidden run, or none, that most of the container's own text is in; blank text counts only where there is no other."""
    sums: tuple[dict, dict] = ({}, {})
    for x in container.walk():
        if x.token[0] != "text" or x.home() is not container:
            continue
        run = next((y for y in x.around() if y.run), None)
        if run is None or not run.visible:
            words = x.words()
            table = sums[0] if words else sums[1]
            table[run] = table.get(run, 0) + len(words or x.token[1])
    counts = sums[0] or sums[1]
    best = max(counts, key=counts.get, default=None)
    return best if best is not None and counts[best] else None


def carry(target: list[Token], source: list[Token], formats: list[tuple]) -> list[Token]:
    """The target with the source's hidden tags. Streams whose visible tags don't nest get them all at their end."""
    table = {f[0]: f for f in formats}
    visible = shown(target, table)
    if visible == shown(source, table):
        return list(source)
    root, goal = tree(source, table), tree(visible, table)
    if root is None or goal is None:
        return visible + [x for x in source if x[0] != "text" and x[2] in table and table[x[2]][2] is False]
    pairs = {x.token[2]: x for x in root.walk() if x.visible and x.token[0] == "open"}
    placed: dict[Item, Item] = {root: goal}
    for x in goal.walk():
        if x.token[0] == "open" and x.token[2] in pairs and pairs[x.token[2]] not in placed:
            placed[pairs[x.token[2]]] = x
    origin = {y: x for x, y in placed.items()}
    home = lambda x: next(y for y in x.around() if y in origin)
    was_at = {x.token[2]: x.at for x in root.walk() if x.visible and x.token[0] != "text"}
    spans = {c: [x.at for x in c.walk() if x.words()] for c in placed}
    plans = {c: Plan() for c in placed}
    hidden = [x for x in root.walk() if not x.visible]

    def starts_range(x: Item) -> bool:
        begin = _RANGE.match(table[x.token[2]][4] or "")
        if not begin or begin.group(2) != "Start":
            return False
        for y in hidden:
            end = _RANGE.match(table[y.token[2]][4] or "")
            if end and end.group(2) == "End" and end.group(1, 3) == begin.group(1, 3):
                return y.home() is x.home() and any(x.at < i < y.at for i in (z.at for z in root.walk() if z.words()))
        return False

    def wraps_all(x: Item, c: Item) -> bool:
        tags = [y for y in c.walk() if y.visible and y.token[0] != "text" and y.home() is c]
        within = all(x.at < y.at and y.end < x.end for y in tags)
        goals = [y for y in goal.walk() if y.token[0] != "text" and home(y) is placed[c]]
        return bool(spans[c]) and x.at < spans[c][0] and x.end > spans[c][-1] and within and all(x.at < was_at.get(y.token[2], -1) < x.end for y in goals)

    main = {c: _main_run(c) for c in placed}
    for x in hidden:
        c = next(y for y in x.around() if y in placed)
        plan = plans[c]
        if c is not x.home():
            plan.trail.append(x)
        elif x.token[0] == "ph":
            if spans[c] and x.at < spans[c][0] or starts_range(x):
                plan.lead.append(x.token)
            else:
                plan.trail.append(x)
        elif x.run:
            if main[c] is x:
                plan.run = x
            else:
                plan.others.append(x)
        elif wraps_all(x, c):
            plan.wraps.append(x)
        else:
            plan.trail.append(x)

    claims: dict[Item, list[tuple[int, str, Item]]] = {}
    for c, plan in plans.items():
        texts = [x for x in goal.walk() if x.token[0] == "text" and home(x) is placed[c]]
        free = [x for x in texts if not any(y.run for y in x.around())]
        for run in plan.others:
            words = _own_text(run)
            last = bool(spans[c]) and spans[c][-1] < run.end
            where = [x for x in free if x is texts[-1]] if last else free
            hits = ((x, at) for x in where for at in (_ending if last else _apart)(x.token[1], words)) if words else ()
            clear = lambda x, at: all(at + len(words) <= a or a + len(w) <= at for a, w, _ in claims.get(x, []))  # noqa: B023, E731
            hit = next(((x, at) for x, at in hits if clear(x, at)), None)
            if hit:
                claims.setdefault(hit[0], []).append((hit[1], words, run))
            else:
                plan.trail.append(run)

    def text(x: Item) -> Iterator[Token]:
        at = 0
        for begin, words, run in sorted(claims.get(x, []), key=lambda c: c[0]):
            if begin > at:
                yield ("text", x.token[1][at:begin], None, None)
            yield from (run.token, ("text", words, None, None), run.close)
            at = begin + len(words)
        if at < len(x.token[1]):
            yield ("text", x.token[1][at:], None, None)

    def dressed(x: Item) -> Iterator[Token]:
        plan = plans[origin[x]] if x in origin else Plan()
        around = [*plan.wraps, *([plan.run] if plan.run else [])]
        yield from (w.token for w in around)
        yield from plan.lead
        for y in x.inside:
            if y.token[0] == "text":
                yield from text(y)
            elif y.token[0] == "ph":
                yield y.token
            else:
                yield y.token
                yield from dressed(y)
                yield y.close
        for y in sorted(plan.trail, key=lambda y: y.at):
            yield y.token
            if y.close:
                yield y.close
        yield from (w.close for w in reversed(around))

    return list(dressed(goal))


_FORMAT = ("id", "kind", "visible", "placement", "open", "close")
_TOKEN = ("t", "v", "id", "k")
ROWS, TOKEN_TYPE = K.ROWS, K.TOKEN_TYPE


def _listed(rows, names: tuple[str, ...]) -> list[tuple]:
    # Arrow gives whole numbers with nulls among them as floats.
    return [tuple(int(x[c]) if c == "id" and x[c] is not None else x[c] for c in names) for x in rows]


def carry_hidden_tags(target: Column, source: Column, formats: Column) -> Column:
    """The target with its source's hidden tags; null where one of the three is null. Ids are those of ``formats``.

    Only segments that have hidden tags go to Python.
    """

    @F.arrow_udf(K.TOKENS)
    def carried(targets: pa.Array, sources: pa.Array, tables: pa.Array) -> pa.Array:
        def one(t, s, f) -> list[dict]:
            return [dict(zip(_TOKEN, x, strict=True)) for x in carry(_listed(t, _TOKEN), _listed(s, _TOKEN), _listed(f, _FORMAT))]

        # A few rows at a time are Python objects, not a batch of whole pages.
        parts = []
        for i in range(0, len(targets), ROWS):
            some = zip(*(x.slice(i, ROWS).to_pylist() for x in (targets, sources, tables)), strict=True)
            parts.append(pa.array([None if t is None or s is None or f is None else one(t, s, f) for t, s, f in some], TOKEN_TYPE))
        return pa.concat_arrays(parts) if parts else pa.array([], TOKEN_TYPE)

    some = F.exists(formats, lambda f: ~f["visible"])
    same = K.same_visible(target, source, formats)
    bare = F.when(same, source).otherwise(K.joined(target))
    present = target.isNotNull() & source.isNotNull() & formats.isNotNull()
    return F.when(present & some, carried(F.when(some, target), source, formats)).when(present, bare)
