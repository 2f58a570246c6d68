"""Paragraph regions of XML parts: where they are, what they hold, and how they are put back.

Small helpers for the tasks of ``packages``. A part is never rebuilt from a
tree: elements are found with their offsets, a region is the slice between two
of them, and an edit replaces that slice. All else stays as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from twintext.functions.tokens import PLACEHOLDER
from twintext.sources.inline import Stream

_MARKUP = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?:[^<>"']|"[^"]*"|'[^']*')*>""", re.S)
_NAME = re.compile(r"</?([^\s/>]+)")
_MARKER = re.compile(r"<!--region:(p\d+)-->")
_ENTITY = re.compile(r"&(#[xX][0-9A-Fa-f]+|#\d+|amp|lt|gt|quot|apos);")
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: What XML can't carry.
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")

# Elements of documents by what they mean for a translation.
VISIBLE = (
    "br", "cr", "tab", "sym", "footnoteReference", "endnoteReference", "footnoteRef", "endnoteRef", "drawing", "pict", "object", "contentPart", "ruby",
    "instrText", "fldChar", "fldSimple", "fld", "pgNum", "dayShort", "dayLong", "monthShort", "monthLong", "yearShort", "yearLong", "noBreakHyphen",
    "softHyphen", "ptab", "oMath", "oMathPara", "customXml", "dir", "bdo", "subDoc",
)
WRAPPERS = ("ins", "moveTo", "smartTag")
KINDS = {
    "br": "br", "cr": "br", "tab": "tab", "ptab": "tab", "footnoteReference": "footnote", "footnoteRef": "footnote", "endnoteReference": "footnote",
    "endnoteRef": "footnote", "drawing": "image", "pict": "image", "object": "image", "instrText": "field", "fldChar": "field", "fldSimple": "field",
    "fld": "field", "pgNum": "field", "dayShort": "field", "dayLong": "field", "monthShort": "field", "monthLong": "field", "yearShort": "field",
    "yearLong": "field", "bookmarkStart": "bookmark", "bookmarkEnd": "bookmark",
}
SHOWN_PROPS = ("b", "bCs", "i", "iCs", "u", "strike", "dstrike", "caps", "smallCaps", "vertAlign", "rStyle", "highlight", "color", "em", "outline", "shadow", "vanish")
OFF = ("0", "false", "none", "noStrike")


class MarkupError(ValueError):
    """A part whose markup can't be followed."""


@dataclass
class Node:
    """An element: its name, where its tag starts, its content lies and it ends."""

    name: str
    start: int
    inner: int
    stop: int = -1
    end: int = -1
    children: list[Node] = field(default_factory=list)

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]


def elements(xml: str) -> list[Node]:
    """The outermost elements of a part or a slice of one, each with its children."""
    roots: list[Node] = []
    stack: list[Node] = []
    at = 0
    for m in _MARKUP.finditer(xml):
        if (lost := xml.find("<", at, m.start())) >= 0:
            raise MarkupError(f"unterminated tag at {lost}")
        at = m.end()
        tag = m.group()
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag).group(1) if _NAME.match(tag) else ""
        if tag[1] == "/":
            if not stack or stack[-1].name != name:
                raise MarkupError(f"</{name}> at {m.start()} closes {f'<{stack[-1].name}>' if stack else 'nothing'}")
            stack[-1].stop, stack[-1].end = m.start(), at
            stack.pop()
            continue
        node = Node(name, m.start(), at)
        (stack[-1].children if stack else roots).append(node)
        if tag.endswith("/>"):
            node.stop = node.end = at
        else:
            stack.append(node)
    if stack:
        raise MarkupError(f"<{stack[-1].name}> is never closed")
    if (lost := xml.find("<", at)) >= 0:
        raise MarkupError(f"unterminated tag at {lost}")
    return roots


@dataclass
class Region:
    """A paragraph's content, without its properties; ``inside`` are the regions in it."""

    key: str
    begin: int
    end: int
    parent: Region | None
    inside: list[Region] = field(default_factory=list)


def regions(xml: str, paragraph: str) -> list[Region]:
    """The paragraphs of a part in document order."""
    found: list[Region] = []
    todo = [(node, None) for node in reversed(elements(xml))]
    while todo:
        node, parent = todo.pop()
        inside = node.children
        if node.name == paragraph:
            props = node.children[0] if node.children and node.children[0].local == "pPr" and not xml[node.inner : node.children[0].start].strip() else None
            region = Region(f"p{len(found) + 1}", props.end if props else node.inner, node.stop, parent)
            if parent:
                parent.inside.append(region)
            found.append(region)
            parent, inside = region, node.children[1:] if props else node.children
        todo += [(child, parent) for child in reversed(inside)]
    return found


def region_xml(xml: str, region: Region) -> str:
    """A region's own markup: markers stand for the regions in it."""
    out, at = [], region.begin
    for x in region.inside:
        out += [xml[at : x.begin], f"<!--region:{x.key}-->"]
        at = x.end
    return "".join([*out, xml[at : region.end]])


def splice(xml: str, paragraph: str, edits: dict[str, str]) -> str:
    """The part with the markup of some regions replaced; markers in it are the regions that were in it."""
    found = regions(xml, paragraph)
    by_key = {r.key: r for r in found}
    if strange := [k for k in edits if k not in by_key]:
        raise MarkupError(f"no region {strange[0]}")
    # What the edits lie in is put together anew, all else is copied.
    touched = set()
    for key in edits:
        r: Region | None = by_key[key]
        while r and r.key not in touched:
            touched.add(r.key)
            r = r.parent

    def content(r: Region) -> str:
        if r.key in edits:
            return _MARKER.sub(lambda m: content(by_key[m.group(1)]), edits[r.key])
        return xml[r.begin : r.end] if r.key not in touched else pieces(r.begin, r.end, r.inside)

    def pieces(begin: int, end: int, inside: list[Region]) -> str:
        out, at = [], begin
        for r in inside:
            if r.key in touched:
                out += [xml[at : r.begin], content(r)]
                at = r.end
        return "".join([*out, xml[at:end]])

    return pieces(0, len(xml), [r for r in found if r.parent is None])


def unescape(text: str) -> str:
    def char(m: re.Match) -> str:
        body = m.group(1)
        if body[0] != "#":
            return _ENTITIES[body]
        n = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return chr(n) if n < 0x110000 else m.group()

    return _ENTITY.sub(char, text)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _on(xml: str, node: Node) -> bool:
    value = re.search(r'\bval="([^"]*)"', xml[node.start : node.inner])
    return not value or value.group(1) not in OFF


def _run_look(xml: str, props: Node) -> tuple[str, bool]:
    """The kind of a run by its properties, and whether they show."""
    head = xml[props.start : props.inner]
    attrs = {k: v for k, v in re.findall(r'\s(b|i|u|strike|baseline)="([^"]*)"', head) if v not in OFF}
    on = {c.local: c for c in props.children if _on(xml, c)}
    shift = next((m.group(1) for c in props.children if c.local == "vertAlign" and (m := re.search(r'val="(superscript|subscript)"', xml[c.start : c.inner]))), None)
    if "baseline" in attrs:
        shift = "subscript" if attrs["baseline"].startswith("-") else "superscript"
    shown = bool(attrs) or any(p in on for p in SHOWN_PROPS)
    if shift:
        return {"superscript": "sup", "subscript": "sub"}[shift], shown
    for p in ("b", "i", "u", "strike"):
        if p in on or p in attrs:
            return p, shown
    return ("style" if any(c.local == "rStyle" for c in props.children) else "other"), shown


def region_stream(xml: str) -> Stream:
    """Tokens and formats of a region's markup. Formats hold the slices that they stand for, so what is rendered is what was read."""
    out = Stream()

    def tag(role: str, kind: str, visible: bool, placement: str, open_: str, close: str = "") -> int:
        n = len(out.formats) + 1
        out.formats.append((n, kind, visible, placement, open_, close))
        out.tokens.append((role, None, n, kind))
        return n

    def whole(x: Node, visible: bool, placement: str) -> None:
        tag("ph", KINDS.get(x.local, "other"), visible, placement, xml[x.start : x.end])

    def run(x: Node) -> None:
        props = next((c for c in x.children if c.local == "rPr"), None)
        body = [c for c in x.children if c is not props]
        if not any(c.local != "t" or c.inner < c.stop for c in body):
            # It shows nothing, but without it the part would differ each time it is saved.
            tag("ph", "other", False, "block", xml[x.start : x.end])
            return
        bare = props is None or not props.children and "=" not in xml[props.start : props.inner]
        n = None
        if not bare:
            kind, shown = _run_look(xml, props)
            n = tag("open", kind, shown, "run", xml[x.start : x.inner] + xml[props.start : props.end], f"</{x.name}>")
        for c in body:
            if c.local == "t":
                out.text(unescape(xml[c.inner : c.stop]))
            else:
                whole(c, c.local in VISIBLE, "in-run")
        if n:
            out.close(n)

    def pair(x: Node, inner: Node, kind: str, visible: bool) -> None:
        n = tag("open", kind, visible, "inline", xml[x.start : inner.inner], xml[inner.stop : x.end])
        walk(inner.children)
        out.close(n)

    def walk(children: list[Node]) -> None:
        for x in children:
            if x.local == "r":
                run(x)
            elif x.local == "hyperlink":
                pair(x, x, "link", True)
            elif x.local in WRAPPERS:
                pair(x, x, "other", False)
            elif x.local == "sdt":
                inner = next((c for c in x.children if c.local == "sdtContent"), None)
                if inner:
                    pair(x, inner, "other", False)
                else:
                    whole(x, False, "block")
            else:
                whole(x, x.local in VISIBLE, "block")

    walk(elements(xml))
    return out


def _merged(tokens: list[tuple], formats: dict[int, tuple]) -> Iterator[tuple]:
    """Neighbouring texts joined; empty texts, empty runs and the seam of two equal runs go."""
    out: list[tuple] = []
    placement = lambda n: formats[n][3]
    for t, v, n, k in tokens:
        last = out[-1] if out else None
        if t == "text":
            if v and last and last[0] == "text":
                out[-1] = ("text", last[1] + v, None, None)
            elif v:
                out.append((t, v, n, k))
        elif t == "close" and last and last[:1] + last[2:3] == ("open", n) and placement(n) == "run":
            out.pop()
        else:
            out.append((t, v, n, k))
    return iter(out)


def render(tokens: list[tuple], formats: list[tuple], space: str = "w") -> str:
    """Tokens as markup. Content takes the properties of its innermost run, up to the nearest pair that is no run."""
    table = {f[0]: f for f in formats}
    for t, v, n, _ in tokens:
        if t == "text" and _ILLEGAL.search(v or ""):
            raise MarkupError("a character that XML can't carry")
        if t != "text" and n not in table:
            raise MarkupError(f"no format {n}")
        if t != "text" and (t == "ph") != (table[n][3] in ("in-run", "block")):
            raise MarkupError(f"tag {n} is no {t}")
    out: list[str] = []
    stack: list[tuple] = []
    current: tuple | None = None
    pending: list[str] = []
    text_open = f'<{space}:t xml:space="preserve">' if space == "w" else f"<{space}:t>"

    def flush() -> None:
        if pending:
            out.append(f"{text_open}{escape(''.join(pending))}</{space}:t>")
            pending.clear()

    def leave() -> None:
        nonlocal current
        flush()
        if current:
            out.append(current[5])
        current = None

    plain = (0, "other", False, "run", f"<{space}:r>", f"</{space}:r>")

    def enter() -> None:
        """Content needs a run: its own, or a plain one that nothing else shares."""
        nonlocal current
        want = None
        for f in reversed(stack):
            if f[3] == "run":
                want = f
            if f[3] in ("run", "inline"):
                break
        want = want or plain
        if current is None or current[4] != want[4]:
            leave()
            out.append(want[4])
            current = want

    for t, v, n, _ in _merged(tokens, table):
        f = table.get(n)
        if t == "text":
            enter()
            pending.append(v)
            if current is plain:
                leave()
        elif t == "ph" and f[3] == "in-run":
            enter()
            flush()
            out.append(f[4])
            if current is plain:
                leave()
        elif t == "ph":
            leave()
            out.append(f[4])
        elif t == "open":
            stack.append(f)
            if f[3] != "run":
                leave()
                out.append(f[4])
        else:
            if not stack or stack[-1][0] != n:
                raise MarkupError(f"tag {n} is closed out of turn")
            stack.pop()
            if f[3] != "run":
                leave()
                out.append(f[5])
    leave()
    if stack:
        raise MarkupError(f"tag {stack[-1][0]} is never closed")
    return "".join(out)


def fold(pieces: list[tuple[list[tuple], list[tuple]]]) -> tuple[list[tuple], list[tuple]]:
    """A paragraph's segments (tokens, formats) as one: ids anew, a space where neither side has one."""
    tokens: list[tuple] = []
    formats: list[tuple] = []
    for more, table in pieces:
        shift = len(formats)
        order = {f[0]: shift + i for i, f in enumerate(table, 1)}
        formats += [(order[f[0]], *f[1:]) for f in table]
        before = next((v for t, v, *_ in reversed(tokens) if t == "text"), None)
        after = next((v for t, v, *_ in more if t == "text"), None)
        if tokens and before and after and not before[-1].isspace() and not after[0].isspace():
            tokens.append(("text", " ", None, None))
        tokens += [(t, v, order.get(n), k) for t, v, n, k in more]
    return tokens, formats


def readable(stream: Stream) -> str:
    """The text of a stream with one opaque character for each visible placeholder."""
    shown = {f[0] for f in stream.formats if f[2]}
    return "".join(v if t == "text" else PLACEHOLDER if t == "ph" and n in shown else "" for t, v, n, _ in stream.tokens)
