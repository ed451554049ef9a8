"""HTML extraction by layout-aware rendering.

Each page is tokenised, built into a tree with implied start and end tags, and rendered as a browser would show it:
all visible text, a blank line around paragraphs and headings, one line for each plain block, bullets and numbers
with indentation for lists, padded columns for tables, and line breaks kept inside `pre`.

Not visible: comments, `head`, scripts, styles, templates and the like, elements with `hidden`, `display:none` or
`visibility:hidden`, hidden inputs, and definitions, descriptions and annotations in `svg` and `math`. Everything else stays, navigation and advertisements included.

Defined results: null and empty pages render as empty text; broken markup is mended, never refused (unmatched end
tags are ignored, open elements end with their parent, a lone `<` is text); repeated rows are rendered alike; very
deep nesting needs no recursion. An empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from bisect import bisect_right
from html import unescape as _unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element names of the HTML standard by how they are handled.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link base datalist iframe object audio video canvas".split())
#: What svg and math elements hold without showing it.
UNDRAWN = {
    "svg": frozenset("defs metadata desc title symbol clippath mask pattern marker filter lineargradient radialgradient".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
RAW = frozenset("script style textarea title noscript iframe xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside nav header footer main address form details summary figcaption li dt dd caption "
    "center legend option optgroup dialog menu dir".split()
)
#: Which open elements a start tag ends, and the elements beyond which it doesn't look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Start tags that end an open paragraph, and what shields one from them.
ENDS_P = BLOCK - {"html", "body", "option", "optgroup", "caption", "legend"}
SHIELDS = frozenset({"table", "td", "th", "caption", "button", "object", "html", "body"})
#: Cells are padded up to this many characters; a wider one pushes the rest of its row.
WIDEST_COLUMN = 40
#: Beyond these, text is shown without more layout, so that a page takes time and room in proportion to its size: columns of
#: indentation, columns of an aligned table, depth of tables within tables, and steps over row spans in a table.
WIDEST_INDENT, WIDEST_TABLE, DEEPEST_TABLE, SPAN_STEPS = 80, 1000, 12, 1_000_000

_TAG = r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(%s)>|([^<]+)|(<)"""
_TOKEN = re.compile(_TAG % r"""(?:[^>"']|"[^"]*"|'[^']*')*+""", re.S)
#: For the rest of a page once its quotes don't pair up: so a page is read in linear time.
_UNQUOTED = re.compile(_TAG % "[^>]*", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


#: Numeric references with so many digits that they name no character, or one behind many zeros.
_LONG_REFERENCE = re.compile(r"&#([xX]?)0*([0-9a-fA-F]*);?")


def unescape(text: str) -> str:
    """Text with its character references resolved, however long their numbers are."""

    def short(m: re.Match) -> str:
        if len(m[0]) < 12:
            return m[0]
        digits = m[2] if m[1] else re.match("[0-9]*", m[2])[0]
        rest = m[0][m.start(2) - m.start() + len(digits) :]
        return (f"&#{m[1]}{digits or 0};" if len(digits) < 9 else "\ufffd") + rest.removeprefix(";")

    return _unescape(_LONG_REFERENCE.sub(short, text) if "&#" in text else text)


class Node:
    __slots__ = ("name", "children", "seen", "attributes")

    def __init__(self, name: str, attributes: dict[str, str], seen: bool):
        self.name, self.attributes, self.seen = name, attributes, seen
        self.children: list[Node | str] = []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return out


def _visible(name: str, attributes: dict[str, str]) -> bool:
    if name in UNSEEN or "hidden" in attributes:
        return False
    if name == "input" and attributes.get("type", "").lower() == "hidden":
        return False
    return not _HIDING.search(attributes.get("style", ""))


def build_tree(html: str) -> Node:
    """The page's tree, with implied tags put in."""
    root = Node("#root", {}, True)
    stack = [root]
    open_at: dict[str, list[int]] = {}  # at which depths each name is open: nothing is searched for in the stack
    last_close = html.rfind(">")

    def show(text: str) -> None:
        """Put text in; text that isn't blank ends an open head."""
        if stack[-1].name == "head" and text.strip(" \t\n\r\f"):
            pop_to(len(stack) - 1)
        stack[-1].children.append(text)

    def push(name: str, attributes: dict[str, str]) -> None:
        node = Node(name, attributes, _visible(name, attributes))
        stack[-1].children.append(node)
        open_at.setdefault(name, []).append(len(stack))
        stack.append(node)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_at[stack.pop().name].pop()

    def deepest(names: set[str] | frozenset[str]) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    def close(names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """End the outermost of `names` that is open above the nearest of `until`."""
        limit = deepest(until)
        found = [own[k] for x in names if (own := open_at.get(x)) and (k := bisect_right(own, limit)) < len(own)]
        if found:
            pop_to(min(found))

    at, end, token = 0, len(html), _TOKEN
    while at < end:
        if at > last_close:  # nothing but text follows, up to a comment that isn't ended
            hidden = html.find("<!--", at)
            show(html[at:hidden] if hidden >= 0 else html[at:])
            break
        m = token.match(html, at)
        if m[5] is not None and html[at + 1 : at + 3].removeprefix("/")[:1].isalpha():
            token = _UNQUOTED
            m = token.match(html, at)
        at = m.end()
        closing, name, raw, text, lone = m.groups()
        if text is not None or lone is not None:
            show(text if text is not None else lone)
            continue
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name == "br":
                stack[-1].children.append(Node("br", {}, True))
            elif open_at.get(name):
                shield = 0 if name in ("table", "html", "body") else deepest({"table"})
                if open_at[name][-1] > shield:
                    pop_to(open_at[name][-1])
            continue
        attributes = _attributes(raw) if raw.strip(" /\n\t") else {}
        if name in ENDS_P and open_at.get("p"):
            close({"p"}, SHIELDS)
        if name in ENDS:
            close(*ENDS[name])
        elif open_at.get("head") and name not in UNSEEN and name not in ("html", "head"):
            close({"head"}, {"body"})
        if name in ("td", "th") and open_at.get("table"):
            if deepest({"table"}) > deepest({"tr"}):
                push("tr", {})
        foreign = [x for x in UNDRAWN if open_at.get(x)]
        if any(name in UNDRAWN[x] for x in foreign):
            attributes = attributes | {"hidden": ""}
        if foreign and raw.endswith("/"):
            stack[-1].children.append(Node(name, attributes, _visible(name, attributes)))
        elif name in VOID:
            stack[-1].children.append(Node(name, attributes, _visible(name, attributes)))
        elif name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            node = Node(name, attributes, _visible(name, attributes))
            node.children.append(html[at : stop.start() if stop else end])
            stack[-1].children.append(node)
            at = stop.end() if stop else end
        elif not raw.endswith("/") or name not in ("svg", "math"):
            push(name, attributes)
    return root


class Flow:
    """Text of one column: lines, with the breaks that are still to come."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False
        self.indent = ""
        self.bullet = ""

    def _open(self) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = self.indent
            if self.bullet:
                lead = lead[: max(0, len(lead) - len(self.bullet))] + self.bullet
                self.bullet = ""
            self.line.append(lead)
            self.space = False

    def text(self, text: str) -> None:
        words = _BLANKS.sub(" ", text)
        if words[:1] == " " and len(self.line) > 1:
            self.space = True
        core = words.strip(" ")
        if core:
            self._open()
            if self.space:
                self.line.append(" ")
            self.line.append(core)
            self.space = words[-1:] == " "

    def kept(self, text: str) -> None:
        for k, part in enumerate(text.split("\n")):
            if k:
                self._open()
                self.end_line()
            if part:
                self._open()
                self.line.append(part)

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" \t"))
            self.line = []
        self.space = False

    def gap(self) -> None:
        self.end_line()
        self.blank = True

    def block(self, lines: list[str]) -> None:
        for x in lines:
            self._open()
            self.line.append(x)
            self.end_line()

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


def _deeper(indent: str, more: int) -> str:
    return indent + " " * more if len(indent) + more <= WIDEST_INDENT else indent


def _number(text: str, most: int) -> int:
    digits = text.lstrip("0") if text.isdecimal() else ""
    return min(most, int(digits)) if 0 < len(digits) < 10 else most if digits else 1


def _table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, columns, rows) cells as text with padded columns; a table that is too wide has its cells side by side."""
    grid: list[dict[int, list[str]]] = []
    spans: list[list[int]] = []  # [first column, end, row from which it is free again] of cells of earlier rows, by column
    steps = 0
    for number, row in enumerate(rows):
        cells: dict[int, list[str]] = {}
        new: list[list[int]] = []
        spans = [s for s in spans if s[2] > number]
        column = at = 0
        for lines, across, down in row:
            while at < len(spans) and spans[at][0] <= column:
                column = max(column, spans[at][1])
                at += 1
            cells[column] = lines
            if down > 1:
                if new and new[-1][1] == column and new[-1][2] == number + down:
                    new[-1][1] += across
                else:
                    new.append([column, column + across, number + down])
            column += across
        grid.append(cells)
        steps += len(spans) + len(new)
        spans = sorted(spans + new) if steps < SPAN_STEPS else []
    width: dict[int, int] = {}
    for cells in grid:
        for k, lines in cells.items():
            width[k] = max(width.get(k, 0), min(WIDEST_COLUMN, max(map(len, lines), default=0)))
    used = [k for k in sorted(width) if width[k]]
    aligned = sum(width[k] + 2 for k in used) <= WIDEST_TABLE
    out = []
    for cells in grid:
        for i in range(max((len(lines) for lines in cells.values()), default=0)):
            if aligned:
                parts = [(cells.get(k, [])[i : i + 1] or [""])[0].ljust(width[k]) for k in used]
            else:
                parts = [lines[i] for lines in cells.values() if i < len(lines) and lines[i]]
            out.append("  ".join(parts).rstrip())
    return out


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    flow = Flow()
    flows, tables, lists = [flow], [], []
    indents: list[str] = []  # before each open item of a list without one, each definition and each quotation
    keep = drawn = sunk = 0
    todo: list[tuple[Node | str, bool]] = [(build_tree(html), False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            text = unescape(node) if "&" in node else node
            if keep:
                flow.kept(text)
            elif tables and flow is tables[-1][1]:
                if text.strip():
                    flow.text(text)
            else:
                flow.text(text)
            continue
        name = node.name
        if not leaving:
            if not node.seen:
                continue
            if name == "br":
                flow._open()
                flow.end_line()
                continue
            if name == "img" and node.attributes.get("alt"):
                flow.text(node.attributes["alt"])
                continue
            if name == "input":
                flow.text(node.attributes.get("value", ""))
                continue
            if name == "svg":
                drawn += 1
            elif name == "text" and drawn:
                flow.text(" ")
            if name in SPACED and not (name in ("ul", "ol") and lists):
                flow.gap()
            elif name in BLOCK:
                flow.end_line()
            if name in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "")
                lists.append([name, _number(start, 10**9) if start else 1, flow.indent])
            elif name == "li":
                kind = lists[-1] if lists else ["ul", 1, flow.indent]
                mark = "- "
                if kind[0] == "ol":
                    mark = f"{kind[1]}. "
                    kind[1] += 1
                indents.append(flow.indent)
                flow.indent = _deeper(kind[2], len(mark))
                flow.bullet = mark
            elif name in ("dd", "blockquote"):
                indents.append(flow.indent)
                flow.indent = _deeper(flow.indent, 2)
            elif name == "pre":
                keep += 1
            elif name == "table" and len(tables) >= DEEPEST_TABLE:
                sunk += 1
            elif name in ("tr", "td", "th") and sunk:
                flow.end_line()
            elif name == "table":
                tables.append(([], flow, len(lists)))
            elif name == "tr" and tables:
                tables[-1][0].append([])
            elif name in ("td", "th") and tables:
                if not tables[-1][0]:
                    tables[-1][0].append([])
                flow = Flow()
                flows.append(flow)
            todo.append((node, True))
            todo.extend((child, False) for child in reversed(node.children))
            continue
        if name in ("tr", "td", "th") and sunk:
            flow.end_line()
        elif name == "table" and sunk:
            sunk -= 1
            flow.gap()
        elif name in ("td", "th") and tables:
            lines = flow.result()
            flows.pop()
            flow = flows[-1]
            tables[-1][0][-1].append((lines, _number(node.attributes.get("colspan", ""), 1000), _number(node.attributes.get("rowspan", ""), 65534)))
        elif name == "table":
            rows, _, _ = tables.pop()
            flow.end_line()
            flow.block(_table_lines(rows))
            flow.gap()
        elif name in ("ul", "ol", "menu", "dir"):
            flow.indent = lists.pop()[2]
            flow.gap() if name in SPACED and not lists else flow.end_line()
        elif name == "li":
            flow.end_line()
            flow.bullet = ""
            before = indents.pop()
            flow.indent = lists[-1][2] if lists else before
        elif name in ("dd", "blockquote"):
            flow.end_line()
            flow.indent = indents.pop()
            if name in SPACED:
                flow.gap()
        elif name == "svg":
            drawn -= 1
        elif name == "text" and drawn:
            flow.text(" ")
        elif name == "pre":
            keep -= 1
            flow.gap()
        elif name in SPACED:
            flow.gap()
        elif name in BLOCK:
            flow.end_line()
    return "\n".join(flow.result()).strip("\n")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with the rendered `text` in place of the markup."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType())])

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((render(x.as_py()) for x in batch.column(batch.num_columns - 1)), type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], "text"])

    return pages.select(*(f"`{f.name}`" for f in kept), html).mapInArrow(rendered, schema)


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
