"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

The renderer puts out all visible text in document order: blocks on lines of their own with blank lines
where a browser has margins, list items with bullets or numbers and indented by depth, preformatted text as
it stands, and tables with their cells aligned in columns.
"""

from __future__ import annotations

import html
import re
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, sliced

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)",
    re.S,
)
#: The rest of a tag; a quote opens a value after = only.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\s\"'])))*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Element classes of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head title script style template noscript noembed noframes iframe audio video canvas datalist annotation annotation-xml area base link meta param source track rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
MARGIN = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr listing menu ol p pre table ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend li dd dt optgroup option tbody td tfoot th thead tr".split())
#: A start tag closes the nearest of the first kind unless one of the second stands in between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "a": ({"a"}, BLOCK | {"table", "td", "th"}), "button": ({"button"}, BLOCK),
}
WALLS = frozenset("table td th caption button object template html".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
#: Where a part of a table is put: open elements down to one of these end when it starts.
TABLE_PLACES = {"tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tbody", "thead", "tfoot", "tr"}, "th": {"table", "tbody", "thead", "tfoot", "tr"}, "col": {"table", "colgroup"}}
#: What may stand between the parts of a table; anything else is moved before it.
IN_TABLE = TABLE_PARTS | frozenset("table style script template".split())
CELLS = frozenset("table td th caption template".split())
#: HTML elements that end an unclosed svg or math.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Where HTML stands again inside svg and math.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Parts of svg that are not drawn where they stand.
NOT_DRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker".split())
HEAD_ONLY = frozenset("title meta link base style script".split())
DEEPEST_TABLE = 8
#: Levels of lists and quotes that are indented; deeper ones stand below the last of them.
DEEPEST_INDENT = 20
#: Columns of a row in which a cell may span several, and cells of the grid that one cell may span.
SPAN_COLUMNS, SPAN_CELLS = 2_000, 65_534
#: Blanks that may align a table: so many for each character of it, and so many more. Rows beyond are not aligned.
ALIGN_SHARE, ALIGN_LEAST = 8, 20_000


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        if not self.attrs:
            return {}
        found: dict[str, str] = {}
        for name, a, b, c in _ATTR.findall(self.attrs):
            found.setdefault(name.lower(), html.unescape(a or b or c))
        return found


class Open(list):
    """The open elements from the outermost in, and by tag the places of those that are open, so that finding the
    innermost one takes the same time at any depth."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.places: dict[str, list[int]] = {}

    def append(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self))
        super().append(node)

    def pop(self) -> Node:
        node = super().pop()
        self.places[node.tag].pop()
        return node

    def end(self, place: int) -> None:
        """The element at the place and all inside it end."""
        while len(self) > place:
            self.pop()

    def nearest(self, tags) -> int:
        """Place of the innermost open element of tags; 0 if there is none."""
        places = self.places
        return max((places[t][-1] for t in tags if places.get(t)), default=0)


def build(text: str) -> Node:
    """The tree under html; html, head, body, tbody and tr are implied where they are left out. A tag that the text
    ends in is dropped with all that follows its start."""
    root = Node("html")
    body: Node | None = None
    stack = Open(root)
    nearest = stack.nearest

    def close(tags, walls) -> bool:
        at = nearest(tags)
        if not at or at < nearest(walls):
            return False
        stack.end(at)
        return True

    def in_table() -> bool:
        """Whether the innermost table is open between its cells (elements moved before it may be open as well)."""
        return tables > 0 and stack[nearest(CELLS)].tag == "table"

    def add(node: Node | str) -> None:
        """Under the innermost open element; before its table where a table has no place for it."""
        top = stack[-1].tag
        if top in ("table", "tbody", "thead", "tfoot", "tr", "colgroup") and not (node.isspace() if isinstance(node, str) else node.tag in IN_TABLE):
            at = nearest({"table"})
            if at:
                if top == "colgroup":
                    stack.pop()
                kids = stack[at - 1].kids
                i = len(kids) - 1
                while kids[i] is not stack[at]:
                    i -= 1
                kids.insert(i, node)
                return
        stack[-1].kids.append(node)

    def add_text(plain: str) -> None:
        if drawings:
            at = nearest({"svg", "text", "foreignobject"} | NOT_DRAWN)
            if stack[at].tag in NOT_DRAWN or stack[at].tag == "svg" or (stack[at].tag == "text" and nearest(NOT_DRAWN) > nearest({"svg"})):
                return
        add(plain)

    tables = drawings = 0  # whether there has been any

    def in_body() -> None:
        nonlocal body
        if body is None:
            stack.end(1)
            body = Node("body")
            add(body)
            stack.append(body)
        elif len(stack) == 1:
            stack.append(body)

    at = 0
    size = len(text)
    while at < size:
        m = _TOKEN.search(text, at)
        upto = m.start() if m else size
        if upto > at:
            plain = text[at:upto]
            if not plain.isspace() and stack[-1].tag != "title":
                in_body()
            if body is not None:
                add_text(html.unescape(plain) if "&" in plain else plain)
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            if drawings and (inner := nearest({"svg", "math"} | INTEGRATION)) and stack[inner].tag not in INTEGRATION:
                in_body()
                add_text(m["cdata"])
            else:  # in HTML it is a comment up to the next >
                at = text.index(">", m.start()) + 1
            continue
        if m["tag"] is None:
            continue
        rest = _REST.match(text, at)
        if not rest:
            break
        at = rest.end()
        tag = m["tag"].lower()
        if m["end"]:
            if tag in ("html", "body"):
                continue
            if tag == "head":
                close({"head"}, ())
            elif tag == "br":
                in_body()
                add(Node("br"))
            elif tag == "p":
                if not close({"p"}, WALLS):
                    in_body()
                    add(Node("p"))
            elif tag not in VOID:
                if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                    close({"h1", "h2", "h3", "h4", "h5", "h6"}, WALLS)
                else:
                    close({tag}, () if tag in ("table", "template", "object") else WALLS - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption") else {"table"} - {tag})
            continue
        attrs = rest[1]
        if tag == "html":
            root.attrs = root.attrs or attrs
            continue
        if tag == "head":
            if body is None and len(stack) == 1:
                node = Node("head", attrs)
                add(node)
                stack.append(node)
            continue
        if tag == "body":
            in_body()
            body.attrs = body.attrs or attrs
            continue
        node: Node | None = None
        if body is None and tag in HEAD_ONLY:
            node = Node(tag, attrs)
            add(node)
        else:
            in_body()
            foreign = 0
            if drawings and (foreign := nearest({"svg", "math"} | INTEGRATION)) and stack[foreign].tag in INTEGRATION:
                foreign = 0
            if foreign and tag in BREAKOUT:
                stack.end(foreign)
                foreign = 0
            if foreign:
                if tag == "text" and stack[-1].kids:
                    add(" ")
                node = Node(tag, attrs)
                add(node)
                if attrs.endswith("/"):
                    continue
                if tag not in ("script", "style", "title"):
                    drawings += tag in ("svg", "math")
                    stack.append(node)
                    continue
        if node is None:
            if in_table():
                if tag == "form":
                    continue
                if tag == "table":
                    stack.end(nearest({"table"}))
                elif tag in TABLE_PARTS:
                    stack.end(nearest(TABLE_PLACES.get(tag, {"table"})) + 1)
            tables += tag == "table"
            drawings += tag in ("svg", "math")
            if tag in CLOSES_P:
                close({"p"}, WALLS)
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
            if tag == "tr" and stack[-1].tag == "table":
                add(Node("tbody"))
                stack.append(stack[-1].kids[-1])
            elif tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                if stack[-1].tag == "table":
                    add(Node("tbody"))
                    stack.append(stack[-1].kids[-1])
                add(Node("tr"))
                stack.append(stack[-1].kids[-1])
            node = Node(tag, attrs)
            add(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            inner = text[at : end.start() if end else size]
            node.kids.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else size
        elif tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path", "math")):
            stack.append(node)
    return root


def visible(node: Node) -> bool:
    """Whether the element has a place on the page at all; shown() tells whether its own text is to be seen."""
    if node.tag in HIDDEN:
        return False
    if not node.attrs:
        return node.tag != "dialog"
    a = node.attributes()
    if "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    return not (_style(a).get("display") == "none" or (node.tag == "dialog" and "open" not in a))


def _style(attributes: dict[str, str]) -> dict[str, str]:
    """The declarations of a style attribute without blanks: the last of a name holds, important ones before others."""
    found: dict[str, str] = {}
    fixed = set()
    for part in re.sub(r"\"[^\"]*\"|'[^']*'", "''", attributes.get("style", "").lower()).split(";"):
        name, _, value = re.sub(r"\s", "", part).partition(":")
        important = value.endswith("!important")
        if important or name not in fixed:
            found[name] = value.removesuffix("!important")
        if important:
            fixed.add(name)
    return found


def shown(node: Node, around: bool) -> bool:
    """Visibility goes down to what is inside until an element sets it anew."""
    found = _style(node.attributes()).get("visibility") if "visibility" in node.attrs.lower() else None
    return found == "visible" if found in ("visible", "hidden", "collapse") else around


def unfolded(node: Node) -> list:
    """What is laid out of an element: of closed details the first summary only."""
    if node.tag == "details" and "open" not in node.attributes():
        return next(([k] for k in node.kids if isinstance(k, Node) and k.tag == "summary"), [])
    return node.kids


class Page:
    """Lines of text as they are laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.space = False
        self.indent: list[str] = []
        self.mark: str | None = None

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            if first:
                self._put(first)
            for x in rest:
                self.newline(True)
                if x:
                    self._put(x)
            return
        parts = _SPACE.sub(" ", s)
        if not parts:
            return
        if parts[0] == " ":
            self.space = True
            parts = parts[1:]
        if not parts:
            return
        tail = parts[-1] == " "
        if self.space and self.line:
            self.line.append(" ")
        self._put(parts[:-1] if tail else parts)
        self.space = tail

    def _put(self, s: str) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead = "".join(self.indent[:DEEPEST_INDENT])
            if self.mark is not None:
                lead = lead[: max(0, len(lead) - len(self.mark))] + self.mark
                self.mark = None
            self.line.append(lead)
        self.line.append(s)

    def newline(self, keep: bool = False) -> None:
        self.space = False
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif keep and self.lines and not self.gap:
            self.lines.append("")

    def margin(self) -> None:
        self.newline()
        self.gap = True

    def done(self) -> str:
        self.newline()
        return "\n".join(self.lines)


def _rows(table: Node, seen: bool):
    """Rows of a table in order, with their visibility; not those of tables inside it."""
    stack = [(iter(table.kids), seen)]
    while stack:
        kids, around = stack[-1]
        for kid in kids:
            if isinstance(kid, Node) and visible(kid):
                if kid.tag == "tr":
                    yield kid, shown(kid, around)
                elif kid.tag in ("tbody", "thead", "tfoot", "form"):
                    stack.append((iter(kid.kids), shown(kid, around)))
                    break
        else:
            stack.pop()


def _table(node: Node, page: Page, depth: int, seen: bool) -> None:
    grid: list[list[tuple[str, int]]] = []
    held: dict[int, int] = {}  # columns taken by a cell above, and for how many rows yet
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "caption" and visible(kid):
            page.margin()
            render(kid, page, depth, shown(kid, seen))
            page.newline()
    for row, row_seen in _rows(node, seen):
        cells: list[tuple[str, int]] = []
        column = 0
        below: dict[int, int] = {}
        for cell in row.kids:
            if not (isinstance(cell, Node) and cell.tag in ("td", "th") and visible(cell)):
                continue
            while held.get(column):
                cells.append(("", 1))
                column += 1
            a = cell.attributes()
            number = lambda name, most, a=a: min(most, max(1, int(a[name]))) if a.get(name, "").isdecimal() else 1
            inner = Page()
            render(cell, inner, depth + 1, shown(cell, row_seen))
            wide = number("colspan", 1000) if column < SPAN_COLUMNS else 1
            tall = number("rowspan", SPAN_CELLS // wide)
            cells.append((inner.done(), wide))
            if tall > 1:
                below |= dict.fromkeys(range(column, column + wide), tall)
            column += wide
        held = {c: n - 1 for c, n in (held | below).items() if n > 1}
        if cells:
            grid.append(cells)
    widths: list[int] = []
    for cells in grid:
        column = 0
        for s, wide in cells:
            widths.extend([0] * (column + wide - len(widths)))
            if wide == 1:
                widths[column] = max(widths[column], *map(len, s.split("\n")))
            column += wide
    blanks = ALIGN_LEAST + ALIGN_SHARE * sum(len(s) for cells in grid for s, _ in cells)
    for cells in grid:
        parts = [s.split("\n") for s, _ in cells]
        for i in range(max(map(len, parts))):
            out, column = [], 0
            if blanks > 0:
                for lines, (_, wide) in zip(parts, cells, strict=True):
                    width = sum(widths[column : column + wide]) + 2 * (wide - 1)
                    out.append((lines[i] if i < len(lines) else "").ljust(width))
                    column += wide
            else:
                out = [lines[i] for lines in parts if i < len(lines) and lines[i]]
            line = "  ".join(out).rstrip()
            blanks -= len(line) - sum(len(lines[i]) for lines in parts if i < len(lines))
            if line:
                page.text(line, True)
            page.newline()


def render(top: Node, page: Page, depth: int = 0, seen: bool = True) -> None:
    """Lays out what is inside top, without recursion but for tables (beyond DEEPEST_TABLE as plain blocks)."""
    stack = [(top, iter(unfolded(top)), top.tag in ("pre", "listing", "textarea"), seen, 0)]
    numbers: list = []
    while stack:
        node, kids, pre, seen, pushed = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                if not seen:
                    continue
                page.text(kid[1:] if pre and not page.line and kid[:1] == "\n" and node.kids[0] is kid else kid, pre)
                continue
            tag = kid.tag
            if tag == "br":
                page.newline(True)
                continue
            if not visible(kid):
                continue
            if tag in MARGIN and not (tag in ("ul", "ol", "menu") and len(numbers)):
                page.margin()
            elif tag in BLOCK:
                page.newline()
            if tag == "table" and depth < DEEPEST_TABLE:
                _table(kid, page, depth, shown(kid, seen))
                page.margin()
                continue
            pushed = 0
            if tag in ("ul", "ol", "menu"):
                start = kid.attributes().get("start", "") if tag == "ol" else ""
                numbers.append(count(int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if tag == "ol" else None)
            elif tag == "li":
                mark = f"{next(numbers[-1])}. " if numbers and numbers[-1] is not None else "- "
                page.indent.append(" " * len(mark))
                page.mark, pushed = mark, 1
            elif tag in ("blockquote", "dd"):
                page.indent.append("  ")
                pushed = 1
            elif tag in ("td", "th") and page.line:
                page.space = True
            stack.append((kid, iter(unfolded(kid)), pre or tag in ("pre", "listing", "textarea"), shown(kid, seen), pushed))
            break
        else:
            stack.pop()
            tag = node.tag
            if not stack:
                break
            if pushed:
                page.newline()
                page.indent.pop()
                page.mark = None
            if tag in ("ul", "ol", "menu"):
                numbers.pop()
            if tag in MARGIN and not (tag in ("ul", "ol", "menu") and len(numbers)):
                page.margin()
            elif tag in BLOCK:
                page.newline()


def visible_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page()
    root = build(source)
    if visible(root):
        for kid in root.kids:
            if isinstance(kid, Node) and visible(kid):
                render(kid, page, 0, shown(kid, shown(root, True)))
    return page.done()


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: id, text. A null or empty page has an empty text; anything else is taken as HTML, however
    broken. What counts as hidden is told by tags, attributes and inline styles (display, visibility); rules of
    style sheets are not read. Scripts are not run, yet noscript is left out, as a reader whose browser runs them sees it. Rows repeat if the input's do; other columns are not read. One pass, no shuffle."""
    bounded_batches(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(visible_text, b.column(1).to_pylist())), pa.string())], [id_col, "text"])

    return pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("h")).mapInArrow(run, f"`{id_col}` {id_type}, text string")
