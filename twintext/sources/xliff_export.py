"""Targets into XLIFF 2 files, inline codes included: edits of slices, so all else stays byte for byte."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintext.functions import tokens as K
from twintext.sources.inline import code_key, code_numbers
from twintext.sources.ooxml import MarkupError, Node, elements, escape, unescape

_FIELDS = ("t", "v", "id", "k")
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def read_codes(xml: str, side: Node) -> tuple[list[tuple], dict[int, tuple[str, str]]]:
    """A side's tokens, numbered as the reader numbers them, and what each code opens and closes with."""
    tokens: list[tuple] = []
    table: dict[int, tuple[str, str]] = {}
    open_codes: dict[tuple, int] = {}

    def text(v: str) -> None:
        if v:
            tokens.append(("text", (tokens.pop()[1] if tokens and tokens[-1][0] == "text" else "") + v, None, None))

    def number(markup: str, close: str) -> int:
        table[len(table) + 1] = (markup, close)
        return len(table)

    def attr(x: Node, name: str) -> str | None:
        m = re.search(rf'\s{name}="([^"]*)"', xml[x.start : x.inner])
        return m and m.group(1)

    def walk(node: Node) -> None:
        at = node.inner
        for c in node.children:
            text(unescape(re.sub(r"<!--.*?-->|<\?.*?\?>", "", xml[at : c.start], flags=re.S)))
            at = c.end
            if c.local in ("pc", "mrk"):
                n = number(xml[c.start : c.inner], xml[c.stop : c.end])
                tokens.append(("open", None, n, None))
                walk(c)
                tokens.append(("close", None, n, None))
            elif c.local == "cp":
                text(chr(int(attr(c, "hex") or "20", 16)))
            elif c.local in ("sc", "sm"):
                n = open_codes[c.local[1], attr(c, "id")] = number(xml[c.start : c.end], "")
                tokens.append(("open", None, n, None))
            elif c.local in ("ec", "em") and (c.local[1], attr(c, "startRef")) in open_codes:
                n = open_codes.pop((c.local[1], attr(c, "startRef")))
                table[n] = (table[n][0], xml[c.start : c.end])
                tokens.append(("close", None, n, None))
            else:
                tokens.append(("ph", None, number(xml[c.start : c.end], ""), None))
        text(unescape(re.sub(r"<!--.*?-->|<\?.*?\?>", "", xml[at : node.stop], flags=re.S)))

    walk(side)
    ended = {n for t, _, n, _ in tokens if t == "close"}
    return [("ph", v, n, k) if t == "open" and n not in ended else (t, v, n, k) for t, v, n, k in tokens], table


def render_codes(tokens: list[tuple], table: dict[int, tuple[str, str]]) -> str:
    """Tokens as inline content; a character that XML can't carry is a ``cp``."""
    out = []
    for t, v, n, _ in tokens:
        if t == "text":
            out.append(_ILLEGAL.sub(lambda m: f'<cp hex="{ord(m.group()):04X}"/>', escape(v or "")))
        elif n not in table:
            raise MarkupError(f"the segment has no code {n}")
        else:
            out.append(table[n][1] if t == "close" else table[n][0])
    return "".join(out)


def _with_state(tag: str, state: str) -> str:
    found = re.search(r"""\sstate\s*=\s*(["'])([^"']*)\1""", tag)
    if found:
        return tag[: found.start(2)] + state + tag[found.end(2) :]
    return re.sub(r"\s*(/?>)$", rf' state="{state}"\1', tag)


def with_targets(content: bytes, targets: dict[int, tuple[list[tuple], str | None]], reviewed: bool = False) -> bytes:
    """A file with the targets (tokens, status) of its segments by place; ones that it has already change nothing."""
    xml = content.decode("utf-8")
    edits: list[tuple[int, int, str]] = []
    place = -1

    def segments(node: Node, locked: bool) -> Iterator[tuple[Node, bool]]:
        for c in node.children:
            if c.local in ("segment", "ignorable") and node.local == "unit":
                yield c, locked
            else:
                yield from segments(c, locked or c.local == "unit" and 'translate="no"' in xml[c.start : c.inner])

    for root in elements(xml):
        for seg, locked in segments(root, False):
            place += 1
            tokens, status = targets.get(place, (None, None))
            source, target = (next((c for c in seg.children if c.local == name), None) for name in ("source", "target"))
            if not tokens or locked or source is None:
                continue
            _, table = read_codes(xml, source)
            arrived, own = ([], {}) if target is None else read_codes(xml, target)
            order = code_numbers(*({n: code_key(x[0]) for n, x in codes.items()} for codes in (own, table)))
            if [(t, v, order.get(n)) for t, v, n, _ in arrived] != [x[:3] for x in tokens]:
                inner = render_codes(tokens, table)
                if target is None:
                    name = source.name.removesuffix("source") + "target"
                    edits.append((source.end, source.end, f"<{name}>{inner}</{name}>"))
                elif target.inner == target.end:
                    edits.append((target.start, target.end, re.sub(r"\s*/>$", ">", xml[target.start : target.end]) + f"{inner}</{target.name}>"))
                else:
                    edits.append((target.inner, target.stop, inner))
            wanted = "initial" if status == "draft" else "final" if reviewed and status == "confirmed" else "translated"
            tag = xml[seg.start : seg.inner]
            now = re.search(r"""\sstate\s*=\s*["']([^"']*)""", tag)
            current = now.group(1) if now else "initial"
            if seg.local == "segment" and not (current == wanted if wanted != "translated" else current != "initial"):
                edits.append((seg.start, seg.inner, _with_state(tag, wanted)))
    out, at = [], 0
    for begin, end, new in sorted(edits):
        out += [xml[at:begin], new]
        at = end
    return "".join([*out, xml[at:]]).encode("utf-8")


def export_xliff(files: DataFrame, targets: DataFrame, reviewed: bool = False) -> DataFrame:
    """Files (path, content) with the targets of their segments written in, and ``error`` for what can't be.

    ``targets`` has path, ord, and ``target`` (a text) or ``target_tokens``
    (with the codes that the reader numbered), and can have ``status``: a draft
    keeps the state initial, with ``reviewed`` a confirmed one becomes final,
    all else translated. An empty target is none, a locked unit stays, and so
    does a file without changes, byte for byte. A file that can't be followed,
    or a target with a code that its segment hasn't, leaves the file as it is.
    """
    tokens = F.col("target_tokens") if "target_tokens" in targets.columns else F.when(F.col("target") != "", F.array(K.token("text", F.col("target"))))
    status = F.col("status") if "status" in targets.columns else F.lit(None).cast("string")
    row = F.struct("ord", tokens.alias("tokens"), status.alias("status"))
    per_file = targets.where(tokens.isNotNull()).groupBy("path").agg(F.collect_list(row).alias("targets"))
    rows = files.select("path", "content").join(per_file, "path", "left")
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                out = {"path": row["path"], "content": row["content"], "error": None}
                if row["targets"]:
                    wanted = {t["ord"]: ([tuple(x[f] for f in _FIELDS) for x in t["tokens"]], t["status"]) for t in row["targets"]}
                    try:
                        out["content"] = with_targets(row["content"], wanted, reviewed)
                    except (MarkupError, UnicodeDecodeError) as x:
                        out["error"] = str(x)
                yield pa.RecordBatch.from_pylist([out], schema)

    return rows.mapInArrow(write, "path string, content binary, error string")
