"""Text of HTML pages by layout-aware rendering.

A tree builder puts tags into a tree, with the end tags and table parts that
HTML lets authors leave out; visibility rules drop what a browser would not
show; a renderer lays out the rest as text.  Blocks begin on lines of their
own, paragraphs and headings are set off by blank lines, list items get a
marker and the indent of their depth, table cells are padded to their
column's width, and preformatted text keeps its blanks.  Padding is bounded for
a cell and for a line, so the text grows in proportion to the page; longer lines
run over their column.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainscope.llm import words

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never shown.
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist audio video canvas object svg math link meta base".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Blocks with a blank line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure menu dir".split())
#: Blocks that end an open paragraph.
_ENDS_P = BLOCKS - frozenset("body dd dt caption html li legend optgroup option summary table tbody td tfoot th thead tr".split()) | frozenset(["table", "dd", "dt", "li"])
_LISTS, _CELLS, _ROWS = frozenset(("ul", "ol", "menu", "dir")), frozenset(("td", "th")), frozenset(("tbody", "thead", "tfoot"))
_UNSHOWN = frozenset(("template", "noscript", "svg", "math"))
#: What a start tag closes, and the elements that this does not reach beyond.
_IMPLIED = {
    "li": (frozenset(["li"]), _LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (_ROWS | frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])), "thead": (_ROWS | frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (_ROWS | frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])), "body": (frozenset(["head"]), frozenset()),
}
_IMPLIED = {tag: (closed, barrier | _UNSHOWN) for tag, (closed, barrier) in _IMPLIED.items()}
_HEAD = frozenset("html head title meta link style script base noscript template".split())
_SCOPE = frozenset(("table", "td", "th", "caption", "html"))
#: Table parts, those that other content must not be a child of, and what each may be in.
_PARTS = _ROWS | _CELLS | frozenset(("caption", "colgroup", "col", "tr"))
_BARE = _ROWS | frozenset(("table", "tr", "colgroup"))
_WITHIN = {"td": _ROWS | frozenset(("table", "tr")), "th": _ROWS | frozenset(("table", "tr")), "tr": _ROWS | frozenset(["table"]), "col": frozenset(("table", "colgroup"))}
_TABLE, _CAPTION = frozenset(["table"]), frozenset(["caption"])
#: Elements inside which an outer table's parts do not go on: cells and what is not shown.
_WALLS = _CELLS | _UNSHOWN
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = " \t\r\n\f"
_BLANKS = re.compile(r"[ \t\r\n\f]+")
_UNSHOWN_STYLE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Characters that a cell is padded to, and the padding of a line, at most; columns that rowspan holds free.
_WIDE, _LINE_PAD, _COLUMNS = 40, 240, 100
#: Lists, quotes and tables within one another that are laid out; deeper ones are plain blocks.
_DEEP = 200


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def _tag_end(html: str, at: int) -> int:
    """The place of the '>' that ends a tag, quoted ones apart (-1: none)."""
    end = html.find(">", at)
    if end < 0:
        return -1
    inside = html[at:end]
    if '"' not in inside and "'" not in inside:
        return end
    k, n = at, len(html)
    while k < n:
        c = html[k]
        if c == ">":
            return k
        if c in "\"'" and _after_equals(html, at, k):
            close = html.find(c, k + 1)
            if close < 0:
                return end
            k = close
        k += 1
    return end


def _after_equals(html: str, low: int, k: int) -> bool:
    k -= 1
    while k > low and html[k] in " \t\r\n\f":
        k -= 1
    return html[k] == "="


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("start", tag, attributes' text) and ("end", tag, "")."""
    at, n = 0, len(html)
    while at < n:
        cut = html.find("<", at)
        if cut < 0:
            yield "text", "", html[at:]
            return
        if cut > at:
            yield "text", "", html[at:cut]
        if html.startswith("<!--", cut):
            end = html.find("-->", cut + 4)
            if html.startswith(("<!-->", "<!--->"), cut):
                end = html.find(">", cut) - 2
            if end < 0:
                return
            at = end + 3
            continue
        after = html[cut + 1:cut + 2]
        if after in ("!", "?") and after:
            end = html.find(">", cut)
            if end < 0:
                return
            at = end + 1
            continue
        closing = after == "/"
        name = _NAME.match(html, cut + 1 + closing)
        if not name:
            if closing and html.find(">", cut) >= 0 and html[cut + 2:cut + 3]:
                at = html.find(">", cut) + 1
                continue
            yield "text", "", "<"
            at = cut + 1
            continue
        end = _tag_end(html, name.end())
        if end < 0:
            return
        tag = name[0].lower()
        at = end + 1
        if closing:
            yield "end", tag, ""
            continue
        yield "start", tag, html[name.end():end]
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            stop = close.start() if close else n
            if stop > at:
                yield "text", "", html[at:stop]
            at = stop


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"') and len(value) > 1:
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


class _Open:
    """The elements that are open, outermost first, and where those of a tag are."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Ends the elements from the k-th on."""
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()

    def last(self, names: frozenset) -> int:
        """The innermost element of these names (0: none)."""
        return max([self.at[x][-1] for x in names if self.at.get(x)], default=0)

    def close(self, names: frozenset, barrier: frozenset) -> None:
        """Ends the elements of these names that are within the barrier."""
        while (k := self.last(names)) > self.last(barrier):
            self.cut(k)

    def add(self, child: Node | str) -> None:
        """Adds to the innermost element, or before its table if it may not hold the child."""
        node = self.stack[-1]
        if node.tag in _BARE and (table := self.table()) and not (isinstance(child, str) and not child.strip(_SPACE)):
            self.stack[table - 1].children.insert(-1, child)  # the open table is its parent's last child
        else:
            node.children.append(child)

    def table(self) -> int:
        """The table that has no cell open (0: none)."""
        k = self.last(_TABLE)
        return k if k > self.last(_WALLS) else 0

    def part(self, tag: str) -> None:
        """Ends what is open between a table's part and the part or table to hold it."""
        if (k := self.last(_WITHIN.get(tag, _TABLE))) > self.last(_WALLS):
            self.cut(k + 1)


def build(html: str) -> Node:
    """The page's tree, with implied end tags, bodies, table rows and the like.  As in
    HTML, text and elements that are no table parts come to stand before their table."""
    root = Node("html", {})
    opened = _Open(root)
    stack = opened.stack
    for kind, tag, text in tokens(html):
        if kind == "text":
            node = stack[-1]
            if node.tag == "head" and text.strip():
                opened.cut(len(stack) - 1)
                node = stack[-1]
            opened.add(text if node.tag in RAW and node.tag not in ("title", "textarea") or "&" not in text else unescape(text))
            if node.tag in RAW:
                opened.cut(len(stack) - 1)
        elif kind == "start":
            if tag == "html":
                root.attributes = attributes(text) | root.attributes
                continue
            if stack[-1].tag == "head" and tag not in _HEAD:
                opened.cut(len(stack) - 1)
            if tag in _ENDS_P:
                opened.close(frozenset(["p"]), _SCOPE)
            if tag in _IMPLIED:
                opened.close(*_IMPLIED[tag])
            if tag == "body" and opened.at["body"]:
                continue
            if tag in _PARTS:
                opened.part(tag)
            elif tag == "table" and (k := opened.table()) > opened.last(_CAPTION):
                opened.cut(k)  # a table that is in no cell ends the open one
            elif tag == "form" and stack[-1].tag in _BARE and opened.table():
                continue  # holds nothing there
            if tag in _CELLS and stack[-1].tag in ("table", *_ROWS):
                row = Node("tr", {})
                stack[-1].children.append(row)
                opened.push(row)
            node = Node(tag, attributes(text) if text.strip(_SPACE + "/") else {})
            if tag in _PARTS:
                stack[-1].children.append(node)
            else:
                opened.add(node)
            if tag not in VOID:
                opened.push(node)
        else:
            barrier = frozenset() if tag in ("table", "body", "html") or tag in _UNSHOWN else frozenset(["table"]) if tag in (*_ROWS, "tr") else frozenset(["td", "th", "table"]) - {tag}
            k, least = opened.last(frozenset([tag])), opened.last(barrier)
            if k > least:
                opened.cut(k)
            elif not least and tag in ("br", "p"):
                opened.add(Node(tag, {}))
    return root


def visible(node: Node) -> bool:
    """Whether an element is laid out at all."""
    if node.tag in HIDDEN:
        return False
    a = node.attributes
    if not a:
        return True
    if "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _UNSHOWN_STYLE.search(a["style"]))


def seen(node: Node, around: bool) -> bool:
    """Whether an element's own text is seen: visibility is handed down, and an
    element inside a hidden one may be visible again."""
    if "style" in node.attributes and (found := _VISIBILITY.findall(node.attributes["style"])):
        return found[-1].lower() == "visible"
    return around


def _children_of(node: Node) -> list:
    """An element's children; a closed details has its first summary only."""
    if node.tag == "details" and "open" not in node.attributes:
        return [c for c in node.children if not isinstance(c, str) and c.tag == "summary"][:1]
    return node.children


class _Page:
    """Lines of rendered text; blank lines between blocks are asked for, not written."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.want = 0  # blank lines before the next line
        self.blank = True  # the line so far ends with a blank

    def text(self, text: str) -> None:
        text = _BLANKS.sub(" ", text)
        if self.blank:
            text = text.lstrip(" ")
        if text:
            self.now.append(text)
            self.blank = text[-1] == " "

    def exact(self, text: str) -> None:
        self.now.append(text)
        self.blank = False

    def cut(self, blank: int = 0) -> None:
        """Ends the line, and asks for blank lines before the next."""
        line = "".join(self.now).rstrip(" ")
        self.now, self.blank = [], True
        if line:
            if self.lines:
                self.lines += [""] * self.want
            self.lines.append(line)
            self.want = 0
        self.want = max(self.want, blank)

    def broken(self) -> None:
        """A line break: an empty line counts."""
        if self.now:
            self.cut()
        else:
            self.want = max(self.want, 1)


def _table(node: Node, depth: int, shown: bool) -> list[str]:
    """Rows of a table: cells on a grid that rowspan and colspan take part in, padded to their column."""
    groups, captions = [[]], []  # rowspan ends with its group of rows

    def gather(parent: Node, shown: bool) -> None:
        for child in parent.children:
            if isinstance(child, str) or not visible(child):
                continue
            own = seen(child, shown)
            if child.tag == "tr":
                groups[-1].append([(c, seen(c, own)) for c in child.children if not isinstance(c, str) and c.tag in _CELLS and visible(c)])
            elif child.tag in _ROWS:
                groups.append([])
                gather(child, own)
                groups.append([])
            else:
                captions.append((child, own))

    gather(node, shown)
    rows, widths = [], {}  # of each row: (column, span, lines); of each column that a cell begins in
    for group in groups:
        held: dict[int, int] = {}  # columns that a cell above still takes, and for how many rows
        for cells in group:
            row, k, taken = [], 0, dict(held)
            for cell, own in cells:
                while taken.get(k):
                    k += 1
                span, down = _count(cell, "colspan", 1000), _count(cell, "rowspan", 65534)
                lines = _lines(cell, depth + 1, own)
                row.append((k, span, lines))
                widths[k] = max(widths.get(k, 0), min(_WIDE, max(map(len, lines), default=0)) if span == 1 else 0)
                if down > 1:
                    held |= dict.fromkeys(range(k, min(k + span, _COLUMNS)), down)
                k += span
            held = {c: n - 1 for c, n in held.items() if n > 1}
            rows.append(row)
    starts = sorted(widths)
    place = {c: i for i, c in enumerate(starts)}
    for row in rows:  # cells over several columns widen the last of them
        for k, span, lines in row:
            own = starts[place[k]:bisect_left(starts, k + span)]
            if 1 < span and len(own) <= _COLUMNS:
                lack = min(_WIDE, max(map(len, lines), default=0)) - sum(widths[c] for c in own) - 3 * (len(own) - 1)
                widths[own[-1]] += max(lack, 0)
    before = [0]
    for c in starts:
        before.append(before[-1] + widths[c] + 3)
    out = [line for c, own in captions for line in _lines(c, depth + 1, own)]
    for row in rows:
        for i in range(max([0, *(len(lines) for _, _, lines in row)])):
            line, pad, at = "", _LINE_PAD, 0
            for k, span, lines in row:
                gap = min(pad, before[place[k]] - before[at])  # columns that a cell above takes
                line += " " * max(gap - 3, 0) + (" | " if gap >= 3 else "")
                pad -= gap
                at = bisect_left(starts, k + span)
                text = lines[i] if i < len(lines) else ""
                fill = min(pad, max(before[at] - before[place[k]] - 3 - len(text), 0))
                line += text + " " * fill + " | "
                pad -= fill
            out.append(line[:-3].rstrip())
    return out


def _count(cell: Node, name: str, most: int) -> int:
    text = cell.attributes.get(name, "1").strip()
    return min(max(int(text[:9]), 1), most) if text.isdecimal() else 1


def _lines(node: Node, depth: int, shown: bool) -> list[str]:
    page = _Page()
    _children(node, page, depth, node.tag == "pre", shown)
    page.cut()
    return page.lines


def _integer(text: str | None, default: int) -> int:
    text = (text or "").strip()
    return int(text[:10]) if text.removeprefix("-").isdecimal() and text.isascii() else default


def _numbers(node: Node) -> list[int]:
    """A list's first number and the step to the next."""
    if node.tag == "ol" and "reversed" in node.attributes:
        return [_integer(node.attributes.get("start"), sum(not isinstance(c, str) and c.tag == "li" for c in node.children)), -1]
    return [_integer(node.attributes.get("start"), 1), 1]


def _children(node: Node, page: _Page, depth: int, exact: bool, shown: bool) -> None:
    """Lays out an element's children; a list of open elements, not recursion, follows
    those that need no lines of their own, however deep they are."""
    opened = [(node, iter(_children_of(node)), exact, -1, shown)]  # blank lines to ask for at the end, -1: no line ends
    numbers = [_numbers(node)]
    while opened:
        node, rest, exact, blank, shown = opened[-1]
        child = next(rest, None)
        if child is None:
            opened.pop()
            numbers.pop()
            if blank >= 0:
                page.cut(blank)
            continue
        if isinstance(child, str):
            if not shown:
                pass
            elif exact:
                first, *more = child.replace("\r\n", "\n").split("\n")
                page.exact(first) if first else None
                for line in more:
                    page.broken()
                    page.exact(line) if line else None
            else:
                page.text(child)
            continue
        if not visible(child):
            continue
        tag, own = child.tag, seen(child, shown)
        if tag == "br":
            page.broken()
        elif tag == "hr":
            page.cut()
            page.exact("---") if own else None
            page.cut()
        elif tag == "img":
            page.text(child.attributes.get("alt", "")) if own else None
        elif tag == "input":
            page.text(" " + child.attributes.get("value", "") + " ") if own and child.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number") else None
        elif tag == "table" and depth < _DEEP:
            page.cut(1)
            _block(page, _table(child, depth, own), "", "")
            page.cut(1)
        elif tag == "li" and depth < _DEEP:
            page.cut()
            if node.tag == "ol":
                numbers[-1][0] = _integer(child.attributes.get("value"), numbers[-1][0])
            mark = f"{numbers[-1][0]}. " if node.tag == "ol" else "- "
            numbers[-1][0] += numbers[-1][1]
            _block(page, _lines(child, depth + 1, own), mark, " " * len(mark))
        elif tag in ("dd", "blockquote") and depth < _DEEP:
            page.cut(tag == "blockquote")
            indent = "  " if tag == "dd" else "> "
            _block(page, _lines(child, depth + 1, own), indent, indent)
            page.cut(tag == "blockquote")
        elif tag in BLOCKS:
            blank = int(tag in SPACED and not (tag in _LISTS and node.tag == "li"))
            page.cut(blank)
            opened.append((child, iter(_children_of(child)), exact or tag == "pre", blank, own))
            numbers.append(_numbers(child))
        else:
            opened.append((child, iter(_children_of(child)), exact, -1, own))
            numbers.append(_numbers(child))


def _block(page: _Page, lines: list[str], first: str, rest: str) -> None:
    for k, line in enumerate(lines):
        if not line:
            page.want = max(page.want, 1)
            continue
        page.exact((rest if k else first) + line)
        page.cut()


def render(html: str | None) -> str | None:
    """The visible text of a page (null: null; nothing visible: empty)."""
    if html is None:
        return None
    page = build(html)
    return "\n".join(_lines(page, 0, seen(page, True)))


def _rendered(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "_html"):
            texts = [render(x) for x in part.column("_html").to_pylist()]
            new = {"_text": texts, "_chars": [len(x or "") for x in texts], "_lines": [x.count("\n") + 1 if x else 0 for x in texts]}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else part.column(f.name).cast(f.type) for f in schema], schema=schema)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, and text, n_chars and n_lines.

    A null page has a null text, one without visible text an empty one, both 0
    characters and lines.  Broken markup is mended as described; nothing is cut
    off; lists, quotes and tables nested deeper than 200 are plain blocks there.
    Repeated rows have equal texts.  Columns that already have one of the new
    names give way.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = {"_text": "string", "_chars": "long", "_lines": "long"}
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars", "n_lines", "_html", *new)]
    rows = pages.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{html_col}`").alias("_html"))
    kind = rows.select(*[f"`{c}`" for c in names], *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema
    out = rows.mapInArrow(partial(_rendered, schema=to_arrow_schema(kind)), kind)
    return out.select(*[f"`{c}`" for c in names], F.col("_text").alias("text"), F.col("_chars").alias("n_chars"), F.col("_lines").alias("n_lines"))
