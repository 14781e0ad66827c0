"""Markdown to a tree of nodes, in pure Python.

CommonMark with GFM tables, as far as schemas need it.  Nodes are numbered in
pre-order from the document at 0; offsets are characters here and UTF-8 bytes in
:func:`node_rows`.  Lines keep their place in the source while the prefixes of
quotes and lists are taken off.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

Line = tuple[str, int]  # text, place in the source

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
_RULER = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*?)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|)$")
_QUOTE = re.compile(r" {0,3}>[ \t]?")
#: First characters of what is no paragraph; tables have a bar.
_MARKS = frozenset("#`~*-_+><")
_ALIGN = re.compile(r"\s*:?-+:?\s*$")


@dataclass
class Node:
    kind: str
    start: int
    end: int
    text: str = ""
    children: list[Node] = field(default_factory=list)
    index: int = 0
    parent: Node | None = field(default=None, repr=False)
    plan: object = field(default=None, repr=False, compare=False)  # what a comparison keeps of a schema's node

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children)


def parse(source: str) -> Node:
    lines, at = [], 0
    for line in source.split("\n"):
        lines.append((line, at))
        at += len(line) + 1
    root = Node("document", 0, len(source), source, _blocks(lines, source))
    k, todo = 0, [root]
    while todo:
        node = todo.pop()
        node.index = k
        k += 1
        if node.children:
            for child in node.children:
                child.parent = node
            todo += node.children[::-1]
    return root


def _blank(line: Line) -> bool:
    return not line[0].strip()


def _end(line: Line) -> int:
    return line[1] + len(line[0])


def _indent(text: str) -> int:
    return len(text) - len(text.lstrip(" "))


def _is_table(lines: list[Line], k: int) -> bool:
    if "|" not in lines[k][0] or k + 1 >= len(lines):
        return False
    cells = _cells(lines[k + 1])
    return bool(cells) and "-" in lines[k + 1][0] and all(_ALIGN.match(t) for t, _, _ in cells) and ("|" in lines[k + 1][0])


def _starts(line: str) -> bool:
    """Whether the line ends a paragraph above it."""
    item = _ITEM.match(line)
    return bool(_HEADING.match(line) or _RULER.match(line) or _FENCE.match(line) or _QUOTE.match(line) or (item and item[3] and item[4] and (not item[2][0].isdigit() or item[2][:-1] == "1")))


def _blocks(lines: list[Line], source: str) -> list[Node]:
    out: list[Node] = []
    k = 0
    while k < len(lines):
        text, at = lines[k]
        if _blank(lines[k]):
            k += 1
        elif (first := text.lstrip(" ")[0]) not in _MARKS and not first.isdecimal() and "|" not in text:
            k = _paragraph(lines, k, source, out)
        elif m := _FENCE.match(text):
            k = _fence(lines, k, m, out)
        elif m := _HEADING.match(text):
            out.append(_heading(lines[k], m))
            k += 1
        elif _RULER.match(text):
            out.append(Node("thematic_break", at, _end(lines[k]), text.strip()))
            k += 1
        elif _QUOTE.match(text):
            inner = []
            while k < len(lines) and (m := _QUOTE.match(lines[k][0])):
                inner.append((lines[k][0][m.end() :], lines[k][1] + m.end()))
                k += 1
            out.append(Node("block_quote", at, _end(inner[-1]), source[at : _end(inner[-1])], _blocks(inner, source)))
        elif _ITEM.match(text):
            k = _list(lines, k, source, out)
        elif _is_table(lines, k):
            k = _table(lines, k, source, out)
        elif re.match(r" {0,3}<[A-Za-z/!?]", text):
            while k < len(lines) and not _blank(lines[k]):
                k += 1
            out.append(Node("html_block", at, _end(lines[k - 1]), source[at : _end(lines[k - 1])]))
        else:
            k = _paragraph(lines, k, source, out)
    return out


def _heading(line: Line, m: re.Match) -> Node:
    text, at = line
    mark = m[1]
    place = at + m.start(1)
    node = Node("atx_heading", place, _end(line), text.strip(), [Node(f"atx_h{len(mark)}_marker", place, place + len(mark), mark)])
    body = re.sub(r"[ \t]+#+$|^#+$", "", m[2] or "")
    if body:
        start = at + m.start(2)
        node.children.append(Node("heading_content", place + len(mark), start + len(body), text[m.end(1) : m.start(2)] + body, inline(body, start)))
    return node


def _fence(lines: list[Line], k: int, m: re.Match, out: list[Node]) -> int:
    first, close = k, re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
    at = lines[k][1]
    k += 1
    body: list[Line] = []
    while k < len(lines) and not close.match(lines[k][0]):
        body.append((lines[k][0][min(len(m[1]), _indent(lines[k][0])) :], lines[k][1]))
        k += 1
    closed = k < len(lines)
    if not closed:
        while body and not body[-1][0].strip():
            body.pop()
    node = Node("fenced_code_block", at + len(m[1]), _end(lines[k]) if closed else (_end(body[-1]) if body else _end(lines[first])), "")
    if m[3]:
        start = at + m.start(3)
        node.children.append(Node("info_string", start, start + len(m[3]), m[3], [Node("text", start, start + len(m[3]), m[3])]))
    if body:
        text = "\n".join(t for t, _ in body)
        node.children.append(Node("code_fence_content", body[0][1], _end(body[-1]), text, [Node("text", body[0][1], _end(body[-1]), text)]))
    out.append(node)
    return k + 1 if closed else k


def _paragraph(lines: list[Line], k: int, source: str, out: list[Node]) -> int:
    first = k
    k += 1
    while k < len(lines) and not _blank(lines[k]) and not _starts(lines[k][0]) and not _is_table(lines, k):
        if re.match(r" {0,3}(=+|-+)[ \t]*$", lines[k][0]):
            a, b = lines[first][1], _end(lines[k])
            out.append(Node("setext_heading", a, b, source[a:b]))
            return k + 1
        k += 1
    parts = [(t.strip(" \t"), p + _indent(t)) for t, p in lines[first:k]]
    text = "\n".join(t for t, _ in parts)
    out.append(Node("paragraph", parts[0][1], parts[-1][1] + len(parts[-1][0]), text, inline(text, parts[0][1])))
    return k


def _list(lines: list[Line], k: int, source: str, out: list[Node]) -> int:
    head = _ITEM.match(lines[k][0])
    same = lambda mark: mark[-1] == head[2][-1]  # noqa: E731  the bullet, or the sign after the number
    at, items, loose = lines[k][1], [], False
    while k < len(lines) and (m := _ITEM.match(lines[k][0])) and same(m[2]) and not _RULER.match(lines[k][0]):
        gap = len(m[3]) if m[3] and m[4] else 1
        gap = gap if gap <= 4 else 1
        width = len(m[1]) + len(m[2]) + gap
        place = lines[k][1] + len(m[1])
        node = Node("list_item", place, 0, "", [Node("list_marker", place, place + len(m[2]), m[2])])
        inner: list[Line] = [(m[4] or "", lines[k][1] + (m.start(4) if m[4] is not None else len(lines[k][0])))] if (m[4] or "").strip() else []
        k += 1
        lazy = bool(inner)
        while k < len(lines):
            text, p = lines[k]
            indent = _indent(text)
            if _blank(lines[k]):
                after = next((j for j in range(k, len(lines)) if not _blank(lines[j])), len(lines))
                if after == len(lines) or _indent(lines[after][0]) < width:
                    break
                loose = loose or bool(inner)
                inner += [("", p)]
                lazy = False
                k += 1
            elif indent >= width or (indent >= 2 and _ITEM.match(text.lstrip(" ")) and indent > len(m[1])):
                cut = min(width, indent)
                inner.append((text[cut:], p + cut))
                k += 1
            elif lazy and not _ITEM.match(text) and not _starts(text):
                inner.append((text.lstrip(" "), p + indent))
                k += 1
            else:
                break
        node.children += _blocks(inner, source)
        node.end = node.children[-1].end
        node.text = source[node.start : node.end]
        items.append(node)
        if k == len(lines) or not _blank(lines[k]):
            continue
        after = next((j for j in range(k, len(lines)) if not _blank(lines[j])), len(lines))
        if after > k and after < len(lines) and (m := _ITEM.match(lines[after][0])) and same(m[2]):
            loose = True
            k = after
    out.append(Node("loose_list" if loose else "tight_list", at, items[-1].end, source[at : items[-1].end], items))
    return k


def _cells(line: Line) -> list[tuple[str, int, int]]:
    """(text, start, end) of each trimmed cell; bars inside code do not cut."""
    text, at = line
    cuts, tick, k = [-1], 0, 0
    while k < len(text):
        if text[k] == "\\":
            k += 1
        elif text[k] == "`":
            tick ^= 1
        elif text[k] == "|" and not tick:
            cuts.append(k)
        k += 1
    cuts.append(len(text))
    parts = [(a + 1, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    if parts and not text[parts[0][0] : parts[0][1]].strip():
        parts = parts[1:]
    if parts and not text[parts[-1][0] : parts[-1][1]].strip():
        parts = parts[:-1]
    out = []
    for a, b in parts:
        cell = text[a:b]
        start = a + len(cell) - len(cell.lstrip())
        out.append((cell.strip(), at + start, at + start + len(cell.strip())))
    return out


def _table(lines: list[Line], k: int, source: str, out: list[Node]) -> int:
    at, rows = lines[k][1], []
    for n, kind in enumerate(("table_header_row", "table_delimiter_row")):
        line = lines[k + n]
        cells = [Node("table_column_alignment" if n else "table_cell", a, b, t, [] if n else inline(t, a)) for t, a, b in _cells(line)]
        rows.append(Node(kind, line[1], _end(line), line[0].strip(), cells))
    k += 2
    while k < len(lines) and not _blank(lines[k]) and "|" in lines[k][0]:
        line = lines[k]
        rows.append(Node("table_data_row", line[1], _end(line), line[0].strip(), [Node("table_cell", a, b, t, inline(t, a)) for t, a, b in _cells(line)]))
        k += 1
    out.append(Node("table", at, rows[-1].end, source[at : rows[-1].end], rows))
    return k


_SPAN = re.compile(r"(?P<tick>`+)(?P<code>.+?)(?<!`)(?P=tick)(?!`)|(?P<image>!)?\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?P<url>(?:[^()\s\\{}]|\\.|\{[^}]*\}|\([^()]*\))*)\)|(?P<strong>\*\*|__)(?=\S)(?P<bold>.+?)(?<=\S)(?P=strong)|(?P<em>[*_])(?=\S)(?P<italic>(?:(?!(?P=em)).)+?)(?<=\S)(?P=em)(?!\w)|\\.", re.DOTALL)

#: Without any of these a text is one node.
_INLINE = re.compile(r"[`\[*_\\]")


def inline(text: str, at: int) -> list[Node]:
    """The inline nodes of a text that begins at a place of the source."""
    if text and not _INLINE.search(text):
        return [Node("text", at, at + len(text), text)]
    out: list[Node] = []
    last = 0

    def plain(upto: int) -> None:
        if upto > last:
            out.append(Node("text", at + last, at + upto, text[last:upto]))

    k = 0
    while m := _SPAN.search(text, k):
        k = m.end()
        a, b = m.span()
        if m["code"] is not None:
            node = Node("code_span", at + a, at + b, text[a:b], [Node("text", at + m.start("code"), at + m.end("code"), m["code"])])
        elif m["label"] is not None:
            label = Node("image_description" if m["image"] else "link_text", at + m.start("label"), at + m.end("label"), m["label"], [Node("text", at + m.start("label"), at + m.end("label"), m["label"])] if m["label"] else [])
            target = Node("link_destination", at + m.start("url"), at + m.end("url"), m["url"], [Node("text", at + m.start("url"), at + m.end("url"), m["url"])] if m["url"] else [])
            node = Node("image" if m["image"] else "link", at + a, at + b, text[a:b], [label, target])
        elif m["bold"] is not None:
            node = Node("strong_emphasis", at + a, at + b, text[a:b], inline(m["bold"], at + m.start("bold")))
        elif m["italic"] is not None:
            if m["em"] == "_" and a and (text[a - 1].isalnum()):
                k = a + 1
                continue
            node = Node("emphasis", at + a, at + b, text[a:b], inline(m["italic"], at + m.start("italic")))
        else:
            continue  # an escape stays in the text
        plain(a)
        out.append(node)
        last = b
    plain(len(text))
    return out


def node_rows(source: str) -> list[tuple]:
    """(idx, parent, depth, kind, start, end, text) with byte offsets."""
    out: list[tuple] = []
    if source.isascii():
        place = lambda k: min(k, len(source))
    else:
        upto = [0, *itertools.accumulate(len(ch.encode("utf-8", "surrogatepass")) for ch in source)]
        place = lambda k: upto[min(k, len(source))]
    todo: list[tuple[Node, int | None, int]] = [(parse(source), None, 0)]
    while todo:
        node, parent, depth = todo.pop()
        out.append((node.index, parent, depth, node.kind, place(node.start), place(node.end), node.text))
        todo += [(child, node.index, depth + 1) for child in reversed(node.children)]
    return out


def printed(source: str, text: bool = False) -> str:
    """The tree, a line a node: ``(kind[index]start..end)``."""
    return "\n".join("  " * depth + f"({kind}[{idx}]{a}..{b})" + (f" {body!r}" if text else "") for idx, _, depth, kind, a, b, body in node_rows(source))
