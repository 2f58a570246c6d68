"""Inline codes of exchange formats as tokens: small helpers for the readers' tasks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

# What the formats' codes stand for.
XLIFF_KINDS = {"xlf:b": "b", "xlf:i": "i", "xlf:u": "u", "xlf:lb": "br", "link": "link", "image": "image"}
TMX_KINDS = {"bold": "b", "italic": "i", "ulined": "u", "underlined": "u", "link": "link", "lb": "br", "image": "image", "strike": "strike", "sup": "sup", "sub": "sub"}
RUN_KINDS = {"b": "b", "i": "i", "u": "u", "strike": "strike"}
OFF = ("0", "false", "none")


@dataclass
class Stream:
    """Tokens (t, v, id, k) and formats (id, kind, visible, placement, open, close) as they are read."""

    tokens: list[tuple] = field(default_factory=list)
    formats: list[tuple] = field(default_factory=list)
    problems: int = 0

    def text(self, value: str | None) -> None:
        if not value:
            return
        if self.tokens and self.tokens[-1][0] == "text":
            value = self.tokens.pop()[1] + value
        self.tokens.append(("text", value, None, None))

    def tag(self, role: str, kind: str, open_: str, close: str = "", visible: bool = True) -> int:
        n = len(self.formats) + 1
        self.formats.append((n, kind, visible, "in-run" if role == "ph" else "inline", open_, close))
        self.tokens.append((role, None, n, kind))
        return n

    def close(self, n: int) -> None:
        self.tokens.append(("close", None, n, None))

    def unclosed(self) -> None:
        """What was opened and never closed is a placeholder."""
        ended = {n for t, _, n, _ in self.tokens if t == "close"}
        for i, (t, v, n, k) in enumerate(self.tokens):
            if t == "open" and n not in ended:
                self.tokens[i] = ("ph", v, n, k)
                self.problems += 1


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def shown(node: ET.Element) -> str:
    """An element's own start tag."""
    return "<" + " ".join([local(node.tag), *[f'{local(k)}="{v}"' for k, v in node.attrib.items()]]) + ">"


def xliff_stream(node: ET.Element) -> Stream:
    """Codes of XLIFF 2: pc, ph, sc with ec, cp; annotations are hidden."""
    out, open_codes = Stream(), {}

    def walk(x: ET.Element) -> None:
        out.text(x.text)
        for c in x:
            name = local(c.tag)
            kind = XLIFF_KINDS.get(c.get("subType", ""), XLIFF_KINDS.get(c.get("type", ""), "other"))
            if name in ("pc", "mrk"):
                n = out.tag("open", kind, shown(c), f"</{name}>", name == "pc")
                walk(c)
                out.close(n)
            elif name == "cp":
                out.text(chr(int(c.get("hex", "20"), 16)))
            elif name in ("sc", "sm"):
                open_codes[name[1], c.get("id")] = out.tag("open", kind, shown(c), "", name == "sc")
            elif name in ("ec", "em") and (name[1], c.get("startRef")) in open_codes:
                out.close(open_codes.pop((name[1], c.get("startRef"))))
            else:
                out.tag("ph", kind, shown(c))
            out.text(c.tail)

    walk(node)
    out.unclosed()
    return out


_CODE = re.compile(r'^<([\w:.-]+)(?:[^>]*?\sid="([^"]*)")?')


def code_key(markup: str) -> tuple[str, str | None]:
    """What makes two codes of a segment's sides the same one: their element and id."""
    m = _CODE.match(markup)
    return (m.group(1).rpartition(":")[2], m.group(2)) if m else ("", None)


def code_numbers(target: dict[int, tuple], source: dict[int, tuple]) -> dict[int, int]:
    """The source's number of each of the target's codes, by element and id; a target with a code of its own keeps its numbers."""
    known: dict[tuple, list[int]] = {}
    for n, key in source.items():
        known.setdefault(key, []).append(n)
    order = {n: known[key].pop(0) for n, key in target.items() if known.get(key)}
    return order if len(order) == len(target) else {n: n for n in target}


def aligned(target: Stream, source: Stream) -> Stream:
    """The target with its codes numbered by ``code_numbers``."""
    order = code_numbers(*({f[0]: code_key(f[4]) for f in x.formats} for x in (target, source)))
    return Stream([(t, v, order.get(n), k) for t, v, n, k in target.tokens], target.formats, target.problems)


def tmx_stream(seg: str) -> Stream:
    """Codes of TMX 1.4: bpt with ept by number, ph, it, hi; their own text is no text of the segment."""
    out, open_codes = Stream(), {}

    def walk(x: ET.Element) -> None:
        out.text(x.text)
        for c in x:
            name, kind = local(c.tag), TMX_KINDS.get(c.get("type", ""), "other")
            code = "".join(c.itertext())
            if name == "bpt":
                open_codes[c.get("i")] = out.tag("open", kind, code)
            elif name == "ept" and c.get("i") in open_codes:
                out.close(open_codes.pop(c.get("i")))
            elif name == "hi":
                n = out.tag("open", kind, "", "")
                walk(c)
                out.close(n)
            else:
                out.tag("ph", kind, code)
                out.problems += name not in ("ph", "it", "ut")
            out.text(c.tail)

    try:
        walk(ET.fromstring(f"<seg>{seg}</seg>"))
    except ET.ParseError:
        out = Stream([("text", seg, None, None)], [], 1)
    out.unclosed()
    return out


def _run_kind(run: ET.Element) -> str | None:
    props = next((x for x in run if local(x.tag) == "rPr"), None)
    for p in props if props is not None else ():
        name, value = local(p.tag), next((v for k, v in p.attrib.items() if local(k) == "val"), "")
        if name in RUN_KINDS and value not in OFF:
            return RUN_KINDS[name]
        if name == "vertAlign" and value in ("superscript", "subscript"):
            return {"superscript": "sup", "subscript": "sub"}[value]
    # Slides write these as attributes.
    for k, v in (props.attrib if props is not None else {}).items():
        if local(k) in RUN_KINDS and v not in OFF:
            return RUN_KINDS[local(k)]
    return None


def paragraph_stream(para: ET.Element) -> Stream:
    """Runs of an OOXML paragraph: formatting as pairs; breaks, notes and pictures as placeholders; marks are hidden."""
    out = Stream()
    marks = {"tab": "tab", "ptab": "tab", "br": "br", "cr": "br", "footnoteReference": "footnote", "endnoteReference": "footnote", "drawing": "image", "pict": "image", "fldChar": "field", "noBreakHyphen": "other"}

    def walk(x: ET.Element) -> None:
        for c in x:
            name = local(c.tag)
            if name == "hyperlink":
                n = out.tag("open", "link", "<w:hyperlink>", "</w:hyperlink>")
                walk(c)
                out.close(n)
            elif name == "r":
                kind = _run_kind(c)
                n = kind and out.tag("open", kind, f"<w:r><w:rPr><w:{kind}/></w:rPr>", "</w:r>")
                walk(c)
                if n:
                    out.close(n)
            elif name == "t":
                out.text(c.text)
            elif name in marks:
                out.tag("ph", marks[name], f"<w:{name}/>")
            elif name in ("proofErr", "bookmarkStart", "bookmarkEnd", "lastRenderedPageBreak"):
                out.tag("ph", "bookmark" if name.startswith("bookmark") else "other", f"<w:{name}/>", "", False)
            elif name in ("ins", "smartTag", "sdt", "sdtContent", "fld"):
                walk(c)

    walk(para)
    return out


def cut(tokens: list[tuple], places: list[int]) -> Iterator[tuple[list[tuple], int]]:
    """Tokens cut at places of their visible text (a placeholder is one character), with where each piece starts.

    Pairs that a cut goes through are closed before it and opened again after
    it; pieces without text are dropped, and ids are numbered anew in each.
    """
    pieces, piece, open_, at, start = [], [], [], 0, 0
    left = sorted(set(places))

    def end(now: int) -> None:
        nonlocal piece, start
        pieces.append(([*piece, *[("close", None, n, None) for n, _ in reversed(open_)]], start))
        piece, start = [("open", None, n, k) for n, k in open_], now

    for t, v, n, k in tokens:
        if t == "text":
            while left and at <= left[0] < at + len(v):
                head, v = v[: left[0] - at], v[left[0] - at :]
                if head:
                    piece.append(("text", head, None, None))
                at = left.pop(0)
                end(at)
            piece.append(("text", v, None, None))
            at += len(v)
            continue
        if t == "ph":
            if left and left[0] == at:
                end(left.pop(0))
            at += 1
        piece.append((t, v, n, k))
        if t == "open":
            open_.append((n, k))
        elif t == "close":
            open_ = [x for x in open_ if x[0] != n]
    pieces.append((piece, start))
    for found, begin in pieces:
        # A pair that holds nothing in this piece goes.
        changed = True
        while changed:
            changed = False
            for i in range(len(found) - 1):
                if found[i][0] == "open" and found[i + 1][0] == "close" and found[i][2] == found[i + 1][2]:
                    found, changed = found[:i] + found[i + 2 :], True
                    break
        if any(x[0] == "text" and x[1].strip() or x[0] == "ph" for x in found):
            order = {n: i for i, n in enumerate(dict.fromkeys(x[2] for x in found if x[2] is not None), 1)}
            yield [(t, v, order.get(n), k) for t, v, n, k in found], begin
