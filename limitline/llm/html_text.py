"""Text of web pages as a reader sees it laid out.

A page is read into a tree: end tags that HTML lets authors leave out are implied, unknown
or stray ones ignored. Rendering walks the tree, leaves out what is not shown, puts blocks
on lines of their own, paragraphs and the like apart by an empty line, marks and indents
list items, keeps preformatted text, shows what forms and drawings say, and sets table cells in
aligned columns, also those that span several columns or rows.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes object audio video canvas datalist input "
    "annotation annotation-xml".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside main header footer nav address details summary dialog form hgroup "
    "search menu center li dt dd tr td th thead tbody tfoot caption figcaption legend hr option optgroup".split()
)
#: An element that begins ends an open one of these, unless one of the borders lies between.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th", "caption", "colgroup"), ("tr", "table")),
    "th": (("td", "th", "caption", "colgroup"), ("tr", "table")),
    "tr": (("td", "th", "tr", "caption", "colgroup"), ("tbody", "thead", "tfoot", "table")),
    **{
        x: (("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",))
        for x in ("thead", "tbody", "tfoot")
    },
}
SECTIONS, CELLS = ("thead", "tbody", "tfoot"), ("td", "th")
#: These end an open paragraph; scopes keep it open from outside.
_ENDS_P = SPACED | frozenset(
    "address article aside center details div dialog fieldset figcaption footer form header hgroup hr main menu "
    "nav search section summary li dt dd tr td th thead tbody tfoot caption".split()
)
_SCOPE = frozenset("table td th caption button object template".split())

#: Elements that the tree nests; what is nested deeper is read as inside the deepest. Its text is
#: kept, unless an element deeper still hides it.
MAX_DEPTH = 400
#: Fixed value of HTML: the widest cell.
MOST_COLUMNS = 1000

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    r"|<[!?][^>]*(?:>|\Z)"  # declaration
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"  # end tag
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)"""  # start tag
    r"""|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",  # start tag with a quote left open
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_CLOSERS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in RAW}


class Node:
    """An element; its children are elements and texts.

    ``hidden`` hides all inside, ``shows`` what does not say otherwise itself (None: as around).
    ``start`` is the first number of a list, ``across`` and ``down`` are the columns and rows of
    a cell, ``chosen`` an option's mark, ``many`` that of a list of several options.
    """

    __slots__ = ("name", "hidden", "shows", "start", "across", "down", "chosen", "many", "children")

    def __init__(self, name: str):
        self.name, self.hidden, self.shows = name, False, None
        self.start = self.across = self.down = 1
        self.chosen = self.many = False
        self.children: list[Node | str] = []


def _element(name: str, raw: str) -> Node:
    node = Node(name)
    if not raw or raw.isspace():
        return node
    lower = raw.lower()
    if "hidden" in lower or "style" in lower or name in ("ol", "option", "select") or "span" in lower and name in CELLS:
        for key, *values in _ATTRIBUTE.findall(raw):
            key, value = key.lower(), html.unescape("".join(values)).strip().lower()
            number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else None
            if key == "hidden" or key == "style" and _HIDING.search(value):
                node.hidden = True
            elif key == "aria-hidden" and value == "true":
                node.hidden = True
            elif key == "start" and number is not None:
                node.start = number
            elif key == "colspan" and number:
                node.across = min(max(number, 1), MOST_COLUMNS)
            elif key == "rowspan" and number is not None:
                node.down = number if number > 0 else 65534 if number == 0 else 1
            elif key == "selected":
                node.chosen = True
            elif key == "multiple" or key == "size" and (number or 0) > 1:
                node.many = True
            if key == "style" and (found := _VISIBILITY.findall(value)):
                node.shows = found[-1] == "visible"
    return node


def parse(source: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack = [root]
    # Open elements beyond the tree's depth, and whether each is unseen or inside one that is.
    deep, unseen = [Node("")], [False]
    names_deep: Counter[str] = Counter()
    at = 0

    def cut_deep(upto: int) -> None:
        names_deep.subtract(x.name for x in deep[upto:])
        del deep[upto:], unseen[upto:]

    def text(raw: str) -> None:
        if raw and not unseen[-1]:
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    def close(names: tuple[str, ...], borders) -> None:
        if any(names_deep[x] for x in names):
            for i in range(len(deep) - 1, 0, -1):
                if deep[i].name in names:
                    return cut_deep(i)
                if deep[i].name in borders:
                    return
        elif any(names_deep[x] for x in borders):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return cut_deep(1)
            if stack[i].name in borders:
                return

    end = len(source)
    while at < end:
        begin = source.find("<", at)
        if begin < 0:
            break
        token = _TOKEN.match(source, begin)
        if not token:  # a "<" that begins nothing is text
            text(source[at : begin + 1])
            at = begin + 1
            continue
        text(source[at:begin])
        at = token.end()
        if token[1]:
            name = token[1].lower()
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not names_deep["p"] and not any(x.name == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            elif name not in ("html", "body"):
                close((name,), _SCOPE - {name} if name not in BLOCKS else ("table",) if name != "table" else ())
            continue
        name = (token[2] or token[4] or "").lower()
        if not name:
            continue
        node = _element(name, token[3] or token[5] or "")
        if name in ("html", "body"):
            stack[0].hidden |= node.hidden
            stack[0].shows = stack[0].shows if node.shows is None else node.shows
            close(("head",), ())
            continue
        if name in _ENDS_P:
            close(("p",), _SCOPE)
        if name in BLOCKS and stack[-1].name == "head":
            stack.pop()
        if name in IMPLIED_ENDS:
            ended, borders = IMPLIED_ENDS[name]
            if len(deep) == 1:
                _imply(stack, ended, borders)
            elif any(names_deep[x] for x in ended):
                left = list(deep)
                _imply(left, ended, borders)
                cut_deep(len(left))
        if name in CELLS and _nearest(stack, ("tr", "table", *SECTIONS, *CELLS)) in ("table", *SECTIONS):
            row = Node("tr")
            stack[-1].children.append(row)
            if len(stack) < MAX_DEPTH and len(deep) == 1:
                stack.append(row)
        if name == "form" and stack[-1].name in ("tr", "table", *SECTIONS):
            continue  # between rows or cells a form holds nothing
        if not unseen[-1]:
            stack[-1].children.append(node)
        if name in RAW:
            closer = _CLOSERS[name].search(source, at)
            stop = closer.start() if closer else end
            if name in ("title", "textarea"):
                node.children.append(html.unescape(source[at:stop]))
            at = closer.end() if closer else end
        elif name in VOID:
            continue
        elif len(stack) < MAX_DEPTH and len(deep) == 1:
            stack.append(node)
        else:
            deep.append(node)
            names_deep[name] += 1
            unseen.append(unseen[-1] or node.hidden or node.shows is False or name in UNSEEN)
    text(source[at:])
    return root


def _imply(stack: list[Node], ended: tuple[str, ...], borders: tuple[str, ...]) -> None:
    """Ends the outermost open element of ``ended`` inside the nearest border."""
    cut = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in borders:
            break
        if stack[i].name in ended:
            cut = i
    if cut is not None:
        del stack[cut:]


def _nearest(stack: list[Node], names: tuple[str, ...]) -> str | None:
    return next((x.name for x in reversed(stack) if x.name in names), None)


def width(text: str) -> int:
    """Columns that a text takes: wide East Asian characters two, marks none."""
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text
    )


class _Lines:
    """Lines of rendered text; white space collapses across inline elements."""

    def __init__(self):
        self.lines: list[str] = []
        self._now: list[str] = []
        self._gap = False  # white space waits for a word

    def write(self, text: str) -> None:
        core = _SPACE.sub(" ", text)
        if core.startswith(" "):
            self._gap, core = True, core[1:]
        trailing = core.endswith(" ")
        core = core[:-1] if trailing else core
        if core:
            if self._gap and self._now:
                self._now.append(" ")
            self._now.append(core)
            self._gap = False
        self._gap |= trailing

    def exact(self, text: str) -> None:
        first, *more = text.split("\n")
        self._now.append(first)
        for line in more:
            self.end()
            self._now.append(line)

    def end(self) -> None:
        """Ends the line, also an empty one."""
        self.lines.append("".join(self._now).rstrip())
        self._now, self._gap = [], False

    def block(self) -> None:
        """What follows begins a line."""
        if self._now:
            self.end()
        self._gap = False

    def apart(self) -> None:
        """What follows stands below an empty line."""
        self.block()
        if self.lines and self.lines[-1]:
            self.lines.append("")


def _trimmed(lines: list[str]) -> list[str]:
    while lines and not lines[0]:
        lines = lines[1:]
    while lines and not lines[-1]:
        lines = lines[:-1]
    return lines


def _rendered(node: Node, pre: bool = False, shown: bool = True) -> list[str]:
    out = _Lines()
    _render(node, out, pre, shown)
    out.block()
    return _trimmed(out.lines)


def _found(node: Node, names: tuple[str, ...]) -> list[Node]:
    """The elements of ``names`` inside, in order, without hidden ones and what is in them."""
    out, todo = [], [c for c in reversed(node.children) if isinstance(c, Node)]
    while todo:
        child = todo.pop()
        if child.hidden or child.name in UNSEEN:
            continue
        if child.name in names:
            out.append(child)
        else:
            todo += [c for c in reversed(child.children) if isinstance(c, Node)]
    return out


def _options(select: Node) -> list[Node]:
    """The options that a closed list, or a list of several options, shows."""
    options = _found(select, ("option",))
    return options if select.many else [x for x in options if x.chosen][-1:] or options[:1]


def _render(node: Node, out: _Lines, pre: bool, shown: bool = True) -> None:
    items, number = node.name in ("ul", "ol", "menu"), node.start
    for child in node.children:
        if isinstance(child, str):
            if shown:
                (out.exact if pre else out.write)(child)
            continue
        name = child.name
        if child.hidden or name in UNSEEN or name == "title":
            continue
        now = shown if child.shows is None else child.shows
        if name == "br":
            if now:
                out.end()
        elif name == "hr":
            if now:
                out.apart()
                out.exact("---")
                out.apart()
        elif name == "table":
            _append(out, _table(child, now), apart=True)
        elif name == "li":
            mark = f"{number}. " if items and node.name == "ol" else "- "
            number += 1
            lines = _rendered(child, shown=now)
            if now or lines:
                _append(out, [(mark if i == 0 else " " * len(mark)) + x if x else x for i, x in enumerate(lines or [""])])
        elif name == "dd":
            _append(out, ["  " + x if x else x for x in _rendered(child, shown=now)])
        elif name in ("ul", "ol", "menu"):
            nested = node.name == "li"
            _append(out, _rendered(child, shown=now), apart=not nested)
        elif name == "blockquote":
            _append(out, [("> " + x).rstrip() for x in _rendered(child, shown=now)], apart=True)
        elif name in ("pre", "textarea"):
            first = child.children[0] if child.children else None
            if isinstance(first, str) and first.startswith("\n"):
                child.children[0] = first[1:]
            _append(out, _rendered(child, True, now), apart=name == "pre")
        elif name in ("select", "svg"):
            for part in _options(child) if name == "select" else _found(child, ("text",)):
                out.write(" ")
                _render(part, out, pre, now if part.shows is None else part.shows)
                out.write(" ")
        elif name in BLOCKS:
            (out.apart if name in SPACED else out.block)()
            _render(child, out, pre, now)
            (out.apart if name in SPACED else out.block)()
        else:
            _render(child, out, pre, now)


def _append(out: _Lines, lines: list[str], apart: bool = False) -> None:
    (out.apart if apart else out.block)()
    out.lines += lines
    if apart and lines:
        out.apart()


def _holds(node: Node, names: tuple[str, ...]) -> bool:
    """Whether an element has one of ``names`` inside, other than in a table of its own."""
    todo = [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Node) and child.name != "table":
                if child.name in names:
                    return True
                todo.append(child)
    return False


def _sort_out(
    node: Node, rows: list[list[Node]], foot: list[list[Node]], loose: Node, row: list[Node] | None = None, shows=None
) -> None:
    """Adds the rows of a table, or the cells of ``row``, inside ``node``; all else goes to ``loose``.

    Rows of a foot go to ``foot``. ``shows`` is handed on to cells that do not say themselves.
    """
    for child in node.children:
        if isinstance(child, str):
            loose.children.append(child)
            continue
        if child.hidden or child.name in UNSEEN:
            continue
        now = shows if child.shows is None else child.shows
        if row is not None and child.name in CELLS:
            child.shows = now
            row.append(child)
        elif row is None and child.name == "tr":
            rows.append([])
            _sort_out(child, rows, foot, loose, rows[-1], now)
        elif row is None and child.name in (*SECTIONS, "colgroup"):
            _sort_out(child, foot if child.name == "tfoot" else rows, foot, loose, None, now)
        elif child.name != "table" and _holds(child, ("tr",) if row is None else CELLS):
            around = Node(child.name)
            loose.children.append(around)
            _sort_out(child, rows, foot, around, row, now)
        else:
            loose.children.append(child)


def _placed(rows: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """First and last column of each cell, beside cells of earlier rows that reach down.

    Columns in which no cell starts are not counted.
    """
    busy: dict[int, int] = {}  # the row up to which a column is taken from above
    at: list[list[tuple[int, int, Node]]] = []
    for y, row in enumerate(rows):
        at.append([])
        x = 0
        for cell in row:
            while busy.get(x, 0) > y:
                x += 1
            at[-1].append((x, x + cell.across, cell))
            if cell.down > 1:
                busy.update(dict.fromkeys(range(x, x + cell.across), y + cell.down))
            x += cell.across
    starts = sorted({a for row in at for a, _, _ in row})
    place = {a: i for i, a in enumerate(starts)}
    return [[(place[a], bisect.bisect_left(starts, b) - 1, cell) for a, b, cell in row] for row in at]


def _table(table: Node, shown: bool = True) -> list[str]:
    """Caption, then rows; cells of a column start in the same place, two spaces apart."""
    loose = Node("div")  # what stands in a table but in no cell is shown before it
    found: list[list[Node]] = []
    foot: list[list[Node]] = []
    _sort_out(table, found, foot, loose)
    lines = _rendered(loose, shown=shown)
    rows = [
        [(a, b, _rendered(cell, shown=shown if cell.shows is None else cell.shows) or [""]) for a, b, cell in row]
        for row in _placed(found + foot)
    ]
    cells = sorted((x for row in rows for x in row), key=lambda x: x[1])
    widths = [0] * (1 + max((b for _, b, _ in cells), default=-1))
    for a, b, cell in cells:  # column by column; what spans several widens the last, if at all
        room = sum(widths[a:b]) + 2 * (b - a)
        widths[b] = max(widths[b], max(map(width, cell)) - room)
    starts = [0, *accumulate(w + 2 for w in widths)]
    for row in rows:
        for y in range(max((len(cell) for _, _, cell in row), default=0)):
            line, end = [], 0
            for a, _, cell in row:
                if y < len(cell):
                    line.append(" " * (starts[a] - end) + cell[y])
                    end = starts[a] + width(cell[y])
            lines.append("".join(line).rstrip())
    return lines


def page_text(source: str | None) -> str:
    """All text that a page shows; null gives none."""
    if not source:
        return ""
    source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "�")
    root = parse(source)
    return "" if root.hidden else "\n".join(_rendered(root, shown=root.shows is not False))


def page_title(source: str | None) -> str:
    found = re.search(r"<title\b[^>]*>(.*?)(?:</title|\Z)", source or "", re.I | re.S)
    return " ".join(html.unescape(found[1]).split()) if found else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text of each page; null html gives empty texts.

    Every row gives one row, also repeated ones; an empty table gives none; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("html").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "title": pa.array(map(page_title, sources), pa.string()),
                    "text": pa.array(map(page_text, sources), pa.string()),
                }
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, title string, text string")
