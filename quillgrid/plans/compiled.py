"""Flat schemas as DataFrame expressions.

A schema of headings, paragraphs, flat lists, tables, fences, one-line quotes,
rulers and lone links becomes a predicate that accepts a document and a column for
each capture: no Python on executors, and regular expressions are compiled once.
A document that the predicate does not accept is not thereby invalid: it may be
written in a way that only the full parser reads, or hold errors that want exact
positions.  :mod:`quillgrid.operators.api` sends those to the tree comparison, and a
differential test holds both equal where both apply.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions import grammar
from quillgrid.functions.grammar import Matcher, MatcherError
from quillgrid.functions.markdown import Node
from quillgrid.operators.compare import matcher_at, repeated_item, repeated_paragraph, row_bounds, schema_tree, simple_cell

#: Possessive loops: other loops of groups take a stack frame a line.
BLOCK = r"(?m)^```[^\n`]*\n(?:(?!```)[^\n]*\n)*+```$|^[^\n]+(?:\n[^\n]+)*+"
#: What only the full parser reads, outside of fences.
ODD = r"[`*_\[\]\\<\t\r]|(?m)^ |(?m) $|^(?:~~~|\+ )"
_STARTS = r"(?:#{1,6}(?: |$)|[-*+](?: |$)|\d{1,9}[.)](?: |$)|>|```|~~~|[=-]+$|\|)"
_PLAIN = r"[^`*_\[\]\\<\t\r\n]+"


class Unsupported(Exception):
    """The schema needs the tree comparison."""


@dataclass(frozen=True)
class Compiled:
    accepts: Column
    captures: dict[str, Column]  # by id; arrays for repeated matchers
    repeated: frozenset[str]
    parts: list[tuple[str, Column]]  # columns that the others read, in this order
    json: frozenset[str]  # ids whose column is JSON already


#: Beyond so many items of their own a list is compared as a tree.
MOST_ITEMS = 200


def _all(*parts: Column) -> Column:
    """All of them, as a balanced tree: a long schema makes no deep expression."""
    if len(parts) > 2:
        half = len(parts) // 2
        return _all(*parts[:half]) & _all(*parts[half:])
    return functools.reduce(operator.and_, parts, F.lit(True))


def _any(array: Column, test) -> Column:
    """Whether a test of (element, place) holds somewhere."""
    return F.exists(F.transform(array, test), lambda x: x)


def _length(text: str) -> int:
    return len(text)


@dataclass(frozen=True)
class _Text:
    """A text with at most one matcher in it."""

    prefix: str
    own: Matcher | None
    suffix: str | None

    def hit(self, text: Column) -> Column:
        rest = F.substr(text, F.lit(_length(self.prefix) + 1)) if self.prefix else text
        if self.own.pattern is None:
            return F.when(F.length(rest) > 0, rest)
        return F.when(F.length(rest) > 0, F.regexp_substr(rest, F.lit(f"(?U)^{self.own.pattern}")))

    def accepts(self, text: Column) -> Column:
        if self.own is None:
            return text == F.lit(self.prefix)
        hit = self.hit(text)
        parts = [hit.isNotNull()]
        if self.prefix:
            parts.append(text.startswith(F.lit(self.prefix)))
        if self.suffix is not None:
            parts.append(F.substr(text, F.length(hit) + 1 + _length(self.prefix)) == F.lit(self.suffix))
        return _all(*parts)


def _text(inline: list[Node], repeats: bool = False) -> _Text:
    kinds = [n.kind for n in inline]
    if kinds == ["text"]:
        return _Text(inline[0].text, None, None)
    at = 1 if kinds[:1] == ["text"] else 0
    if kinds[at : at + 1] != ["code_span"] or kinds[at + 1 :] not in ([], ["text"]):
        raise Unsupported("inline formatting")
    try:
        own = matcher_at(inline, at)
    except MatcherError as wrong:
        raise Unsupported(str(wrong)) from None
    if own.repeated and not repeats:
        raise Unsupported("a repeated matcher in a text")
    if own.pattern is not None and not _java_safe(own.pattern):
        raise Unsupported("a pattern that dialects read differently")
    suffix = grammar.split_extras(inline[at + 1].text)[1] if len(inline) > at + 1 else None
    return _Text(inline[0].text if at else "", own, suffix)


def _java_safe(pattern: str) -> bool:
    """Neither nested classes nor named groups nor classes with set operators."""
    inside = False
    for k, ch in enumerate(pattern):
        if ch == "[" and (not k or pattern[k - 1] != "\\"):
            if inside:
                return False
            inside = True
        elif ch == "]" and (not k or pattern[k - 1] != "\\"):
            inside = False
    return "&&" not in pattern and "(?P" not in pattern and r"\p" not in pattern and "$" not in pattern


def _fence(node: Node, b: Column, captures: dict) -> Column:
    part = lambda kind: next((c.text for c in node.children if c.kind == kind), None)
    head = F.regexp_extract(b, r"^```[ \t]*([^\n`]*?)[ \t]*\n", 1)
    body = F.regexp_extract(b, r"(?s)^```[^\n]*\n(?:(.*)\n)?```$", 1)
    checks = [b.rlike(r"^```")]
    lang = part("info_string")
    if lang:
        try:
            own = grammar.curly(lang)
        except MatcherError as wrong:
            raise Unsupported(str(wrong)) from None
        if own:
            if own.pattern is not None and not _java_safe(own.pattern):
                raise Unsupported("a pattern that dialects read differently")
            hit = _Text("", own, None).hit(head)
            checks.append((head == "") | hit.isNotNull())
            if own.id:
                captures[own.id] = F.when(head != "", hit)
        else:
            checks.append((head == "") | (head == F.lit(lang)))
    code = part("code_fence_content")
    name = grammar.curly_id(code) if code else None
    if name:
        captures[name] = body
    else:
        checks.append(body == F.lit(code or ""))
    return _all(*checks)


def _list(node: Node, b: Column, captures: dict, repeated: set, keep=lambda x: x) -> Column:
    if node.kind != "tight_list" or any(len(i.children) != 2 or i.children[1].kind != "paragraph" for i in node.children):
        raise Unsupported("a nested or loose list")
    ordered = node.children[0].children[0].text[0].isdigit()
    mark = r"^\d{1,9}[.)] (?! )" if ordered else r"^[-] (?! )"
    lines = keep(F.split(b, "\n"))
    items = keep(F.transform(lines, lambda x: F.regexp_replace(x, mark, "")))
    uniform = F.forall(lines, lambda x: x.rlike(mark)) & ~F.exists(items, lambda x: x.rlike("^" + _STARTS))
    if ordered:
        uniform = uniform & (F.size(F.array_distinct(F.transform(lines, lambda x: F.regexp_extract(x, r"^\d+([.)])", 1)))) == 1)
    checks, at = [uniform], 0
    plain: list[str] = []  # literal items in a row are compared as one array

    def put_plain() -> None:
        if plain:
            checks.append(F.slice(items, at - len(plain) + 1, len(plain)) == F.array(*(F.lit(x) for x in plain)))
            plain.clear()

    own_items = 0
    for k, item in enumerate(node.children):
        try:
            own = repeated_item(item)
        except MatcherError as wrong:
            raise Unsupported(str(wrong)) from None
        text = _text(item.children[1].children, repeats=True)
        last = k + 1 == len(node.children)
        if own is None and text.own is None:
            plain.append(text.prefix)
            at += 1
            if last:
                put_plain()
                checks.append(F.size(items) == at)
            continue
        put_plain()
        own_items += 1
        if own_items > MOST_ITEMS:
            raise Unsupported("a long list of matchers")
        if own is None:
            one = F.get(items, F.lit(at))
            checks.append(text.accepts(one))
            if text.own and text.own.id:
                captures[text.own.id] = text.hit(one)
                repeated.discard(text.own.id)
            at += 1
            if last:
                checks.append(F.size(items) == at)
            continue
        if not last and (own.variable or own.most is None):
            raise Unsupported("an open repetition before the end of a list")
        if not last and own.most == 0 or text.prefix:
            raise Unsupported("an empty repetition")
        size = F.size(items) - at if last else F.lit(own.most)
        here = F.slice(items, at + 1, F.greatest(size, F.lit(0)))
        if last:
            checks += [size >= max(1, own.least or 0), *([size <= own.most] if own.most is not None else [])]
        checks.append(F.forall(here, lambda x: text.accepts(x)))
        if own.id:
            captures[own.id] = F.transform(here, lambda x: text.hit(x))
            repeated.add(own.id)
        at += own.most or 0
    return _all(b.rlike(mark), *checks)


#: A line of a list below a list, as the compiled plan reads it.
_BELOW = r"^ {4}- (?! )"


def _is_nested(node: Node) -> bool:
    """A list of one item with a list of one item below it."""
    shape = lambda n: n.kind == "tight_list" and len(n.children) == 1 and n.children[0].children[0].text == "-" and [c.kind for c in n.children[0].children[1:]]
    return shape(node) == ["paragraph", "tight_list"] and shape(node.children[0].children[2]) == ["paragraph"]


def _nested(node: Node, b: Column, captures: dict, keep) -> Column:
    """An item taken once and a repeated one below it: the capture is what the item gives
    and then an object of what those below give, as JSON."""
    item = node.children[0]
    below = item.children[2].children[0]
    try:
        own, under = repeated_item(item), repeated_item(below)
    except MatcherError as wrong:
        raise Unsupported(str(wrong)) from None
    if not own or not under or own.most != 1 or (own.least or 0) > 1 or not own.id or not under.id or own.id == under.id:
        raise Unsupported("a nested list")
    head, text = (_text(i.children[1].children, repeats=True) for i in (item, below))
    lines = keep(F.split(b, "\n"))
    first = F.substr(F.get(lines, F.lit(0)), F.lit(3))
    given = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    rest = keep(F.transform(given, lambda x: F.when(x.rlike(_BELOW), F.substr(x, F.lit(7)))))
    checks = [b.rlike(r"^- (?! )"), ~first.rlike("^" + _STARTS), head.accepts(first), F.size(rest) >= max(1, under.least or 0)]
    if under.most is not None:
        checks.append(F.size(rest) <= under.most)
    checks.append(F.forall(rest, lambda x: x.isNotNull() & ~x.rlike("^" + _STARTS) & text.accepts(x)))
    one = F.to_json(F.array(head.hit(first)))
    more = F.to_json(F.struct(F.transform(rest, lambda x: text.hit(x)).alias(under.id)))
    captures[own.id] = F.concat(F.substr(one, F.lit(1), F.length(one) - 1), F.lit(","), more, F.lit("]"))
    return _all(*checks)


def _cells_of(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))


def _table(node: Node, b: Column, captures: dict, repeated: set, keep=lambda x: x) -> Column:
    rows = [r for r in node.children if r.kind != "table_delimiter_row"]
    wide = len(rows[0].children)
    lines = keep(F.split(b, "\n"))
    cells = keep(F.transform(F.filter(lines, lambda x, i: i != 1), _cells_of))
    checks = [
        F.forall(lines, lambda x: x.rlike(r"^\|.*\|$")),
        F.get(lines, F.lit(1)).rlike(r"^\|(?: *:?-+:? *\|)+$"),
        F.size(_cells_of(F.get(lines, F.lit(1)))) == wide,
        F.forall(cells, lambda r: (F.size(r) == wide) & F.forall(r, lambda c: c != "")),
    ]
    loops = [k for k, r in enumerate(rows) if row_bounds(r) is not None]
    if len(loops) > 1:
        raise Unsupported("two repeated rows")
    at = loops[0] if loops else len(rows)
    after = len(rows) - at - 1 if loops else 0
    if any(len(r.children) != wide + (k in loops) for k, r in enumerate(rows)):
        raise Unsupported("rows of unequal width")
    for k, row in enumerate(rows):
        if k in loops:
            low, high = row_bounds(row)
            size = F.size(cells) - at - after
            checks += [size >= max(0, low or 0), *([size <= high] if high is not None else [])]
            here = F.slice(cells, at + 1, F.greatest(size, F.lit(0)))
            for c, cell in enumerate(row.children[:-1]):
                own = simple_cell(cell)
                if own is None or own.pattern is not None and not _java_safe(own.pattern):
                    raise Unsupported("a cell of a repeated row that is no matcher")
                text = _Text("", own, None)
                checks.append(F.forall(here, lambda r: text.accepts(F.get(r, F.lit(c)))))
                if own.id:
                    some = F.transform(here, lambda r: text.hit(F.get(r, F.lit(c))))
                    captures[own.id] = F.when(size > 0, some)
                    repeated.add(own.id)
            continue
        one = F.get(cells, F.lit(k)) if k < at else F.get(cells, F.size(cells) - (len(rows) - k))
        for c, cell in enumerate(row.children):
            text = _text(cell.children)
            if text.suffix is not None:
                text = _Text(text.prefix, text.own, text.suffix.rstrip())
            value = F.get(one, F.lit(c))
            checks.append(text.accepts(value))
            if text.own and text.own.id:
                captures[text.own.id] = text.hit(value)
                repeated.discard(text.own.id)
    if not loops:
        checks.append(F.size(cells) == len(rows))
    return _all(b.startswith("|"), *checks)


def _link(node: Node, b: Column, captures: dict) -> Column:
    link = node.children[0]
    pattern = r"^%s\[([^\[\]`*_\\!\n]+)\]\(([^()\s\\{}]+)\)$" % ("!" if link.kind == "image" else "")
    checks = [b.rlike(pattern)]
    for k, part in enumerate(link.children, 1):
        text = F.regexp_extract(b, pattern, k)
        if not part.text:
            raise Unsupported("an empty link")
        try:
            own = grammar.curly(part.text)
        except MatcherError as wrong:
            raise Unsupported(str(wrong)) from None
        if own is None:
            checks.append(text == F.lit(part.text))
            continue
        if own.pattern is not None and not _java_safe(own.pattern):
            raise Unsupported("a pattern that dialects read differently")
        hit = _Text("", own, None).hit(text)
        checks.append(hit.isNotNull())
        if own.id:
            captures[own.id] = hit
    return _all(*checks)


def _paragraph(b: Column) -> Column:
    """A block that is one paragraph of plain text."""
    return b.isNotNull() & ~b.rlike(r"(?m)^" + _STARTS)


def blocks_of(text: Column) -> Column:
    """The blocks of a text, which :func:`compiled` reads many times: keep them in a column."""
    return F.regexp_extract_all(text, F.lit(BLOCK), 0)


def compiled(schema: str, text: Column, blocks: Column | None = None, part: str | None = None) -> Compiled:
    """The expressions of a schema over a text column; raises :class:`Unsupported`.

    What they read many times (a table's cells, say) is in columns ``part`` with a number,
    where that is given; Spark evaluates an expression anew in each place of it."""
    blocks = blocks_of(text) if blocks is None else blocks
    parts: list[tuple[str, Column]] = []

    def keep(value: Column) -> Column:
        if part is None:
            return value
        parts.append((f"{part}{len(parts)}", value))
        return F.col(parts[-1][0])

    nodes = schema_tree(schema).children
    checks: list[Column] = []
    captures: dict[str, Column] = {}
    repeated: set[str] = set()
    offset: int | Column = 0
    total: int | Column = len(nodes)
    linked: list[int | Column] = []
    deep: list[int | Column] = []  # places of nested lists
    written: set[str] = set()
    for k, node in enumerate(nodes):
        place = F.lit(k) + offset if not isinstance(offset, int) else F.lit(k)
        b = F.get(blocks, place)
        fresh: dict[str, Column] = {}
        before = set(repeated)
        if node.kind == "atx_heading" and len(node.children) == 2:
            level = len(node.children[0].text)
            body = _text(node.children[1].children)
            line = F.substr(b, F.lit(level + 2))
            checks.append(b.rlike(r"^#{%d} (?! )[^\n]*[^#\n]$" % level) & body.accepts(line))
            if body.own and body.own.id:
                fresh[body.own.id] = body.hit(line)
        elif node.kind == "paragraph" and (own := repeated_paragraph(node)):
            if not isinstance(offset, int):
                raise Unsupported("two repeated paragraphs")
            rest = F.slice(blocks, k + 1, F.greatest(F.size(blocks), F.lit(1)))
            stop = F.array_position(F.transform(rest, lambda x: ~_paragraph(x)), F.lit(True))
            run = F.when(stop > 0, stop - 1).otherwise(F.size(rest)).cast("int")
            run = F.least(run, F.lit(own.most)) if own.most is not None else run
            checks.append(run >= max(1, own.least or 0))
            if own.id:
                fresh[own.id] = F.slice(rest, F.lit(1), F.greatest(run, F.lit(0)))
                repeated.add(own.id)
            offset = run - 1
            total = F.lit(len(nodes)) + offset
        elif node.kind == "paragraph" and len(node.children) == 1 and node.children[0].kind in ("link", "image"):
            linked.append(k if isinstance(offset, int) else place)
            checks.append(_link(node, b, fresh))
        elif node.kind == "paragraph":
            body = _text(node.children)
            checks.append(_paragraph(b) & body.accepts(b))
            if body.own and body.own.id:
                fresh[body.own.id] = body.hit(b)
        elif node.kind == "fenced_code_block":
            checks.append(_fence(node, b, fresh))
        elif node.kind == "block_quote" and len(node.children) == 1 and node.children[0].kind == "paragraph":
            body = _text(node.children[0].children)
            line = F.regexp_extract(b, r"^> ?([^\n]*)$", 1)
            checks.append(b.rlike(r"^> ?(?![ >])[^\n]+$") & ~line.rlike("^" + _STARTS) & body.accepts(line))
            if body.own and body.own.id:
                fresh[body.own.id] = body.hit(line)
        elif node.kind == "thematic_break":
            checks.append(b.rlike(r"^---+$"))
        elif _is_nested(node):
            deep.append(k if isinstance(offset, int) else place)
            checks.append(_nested(node, b, fresh, keep))
            written |= set(fresh)
        elif node.kind in ("tight_list", "loose_list"):
            checks.append(_list(node, b, fresh, repeated, keep))
        elif node.kind == "table":
            checks.append(_table(node, b, fresh, repeated, keep))
        else:
            raise Unsupported(node.kind)
        for name, value in fresh.items():
            if name in captures and ((name in before) != (name in repeated) or name in written):
                raise Unsupported("an id of two shapes")
            captures[name] = F.coalesce(value, captures[name]) if name in captures else value
    flat = lambda x, i: F.when(functools.reduce(operator.or_, [i == p for p in deep]), F.regexp_replace(x, r"(?m)^ {4}(?=- )", "")).otherwise(x) if deep else x
    odd = _any(blocks, lambda x, i: ~x.startswith("```") & flat(x, i).rlike(ODD) & ~functools.reduce(operator.or_, [i == p for p in linked], F.lit(False)))
    # two lists in a row may be one loose list
    lists = keep(F.transform(blocks, lambda x: x.rlike(r"^(?:[-*+]|\d{1,9}[.)])(?: |$)")))
    twice = _any(lists, lambda x, i: x & (i > 0) & F.coalesce(F.get(lists, i - 1), F.lit(False)))
    accepts = _all(text.isNotNull(), F.size(blocks) == total, ~odd, ~twice, *checks)
    return Compiled(F.coalesce(accepts, F.lit(False)), captures, frozenset(repeated), parts, frozenset(written))
