"""HTML extraction: a tree builder with implied tags and visibility rules, rendered with its layout.

All visible text comes out: blocks on lines of their own (paragraph-like ones set off by an empty line), list items
with bullets or numbers and hanging indents, pre-formatted text as it stands, and table cells in aligned columns, spanning cells
over the columns that they span. Of a select the chosen option is seen, or else the first; of svg and math their text.

Hidden are the head, scripts, styles, templates and similar elements, anything with the hidden attribute or display:none, closed
dialogs, and all but the summary of closed details. visibility is inherited: what is visible inside something hidden is seen.
display and visibility come from inline styles and from the page's style sheets: rules whose selectors are made of tags,
classes, ids and attributes, alone or as descendants or children, by their specificity and order; rules for media other
than screen, and selectors of another kind, do not count. Nothing recurses, so depth is no limit.

Cells are wrapped at WIDEST characters; a word longer than that leaves its column and does not widen it, which bounds the
output by a multiple of the input.

Edge cases: null or empty html gives empty text; unclosed and stray tags, broken entities and cut-off markup are repaired
as a browser would, a tag cut off at the end of the page is dropped; repeated rows come back as often; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm.common import slices, table

WIDEST = 80
#: Entering a node whose inherited visibility is hidden.
SILENT = 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe object canvas audio video rp noframes noembed desc defs metadata symbol annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
WIDE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure fieldset hr".split())
BLOCK = WIDE | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav optgroup option section summary tbody tfoot thead tr search".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html caption option optgroup tbody tfoot thead tr legend".split())
#: Tag: the open elements that its start ends, and the elements that such a search does not leave.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: End tags do not close elements outside these.
SCOPE = frozenset("table td th caption html".split())
#: Inline elements that blocks inside them outlive: their end tag closes them alone.
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD_ONLY = frozenset("base link meta title script style noscript template head".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*(?:\"|$)|=\s*+'[^']*(?:'|$)|[^>])*+)(>|$)|</[^a-zA-Z][^>]*(?:>|$)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
SPACE = re.compile(r"[ \t\n\f\r]+")
#: Declarations of a style that decide what is seen.
DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
HIDING = re.compile(r"display\s*:\s*none", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
MEDIA = re.compile(r"^@media\b(?:\s+(?:only\s+)?(?:all|screen)\b)?\s*(\S?)", re.I)
SIMPLE = re.compile(r"([a-z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]", re.I)
COMBINED = re.compile(r"\s*>\s*|\s+")


class Node:
    __slots__ = ("attrs", "children", "parent", "shown", "sheet", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.parent, self.shown, self.sheet = tag, attrs, [], None, True, {}


def _compound(text: str) -> tuple | None:
    """tag, classes, ids, attributes of a selector without combinators; None for other kinds."""
    tag, classes, ids, attrs, at = "", [], [], [], 0
    while at < len(text):
        m = SIMPLE.match(text, at)
        if not m or (m[1] and at):
            return None
        tag = m[1].lower() if m[1] and m[1] != "*" else tag
        classes += [m[2]] if m[2] else []
        ids += [m[3]] if m[3] else []
        attrs += [(m[4].lower(), m[5])] if m[4] else []
        at = m.end()
    return (tag, classes, ids, attrs) if text else None


def _blocks(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet; rules inside @media for screens count, other at-rules do not."""
    at, end = 0, len(css)
    inside = 0
    while at < end:
        brace = css.find("{", at)
        close = css.find("}", at)
        if close >= 0 and (brace < 0 or close < brace):  # the end of a media block, or a stray one
            at, inside = close + 1, max(0, inside - 1)
            continue
        if brace < 0:
            return
        head = css[at:brace].strip().rsplit(";", 1)[-1].strip()
        if head.startswith("@"):
            m = MEDIA.match(head)
            if m and not m[1] and m[0].lower() != "@media":
                at, inside = brace + 1, inside + 1
                continue
            depth, at = 1, brace + 1  # skip the whole block
            while depth and at < end:
                depth += {"{": 1, "}": -1}.get(css[at], 0)
                at += 1
            continue
        close = css.find("}", brace)
        close = end if close < 0 else close
        yield head, css[brace + 1 : close]
        at = close + 1


def style_rules(css: str) -> list[tuple[list[tuple], list[bool], tuple[int, int, int], list[tuple[str, str, bool]]]]:
    """(compounds from the last to the first, whether each has to be the next one's parent, specificity, declarations)."""
    out = []
    for selectors, body in _blocks(COMMENT.sub(" ", css)):
        said = [(p.lower(), v.lower(), bool(i)) for p, v, i in DECLARED.findall(body)]
        if not said:
            continue
        for selector in selectors.split(","):
            selector = selector.strip()
            parts = [_compound(x) for x in COMBINED.split(selector)]
            if not selector or None in parts:
                continue
            child = [">" in x for x in COMBINED.findall(selector)]
            weight = (sum(len(p[2]) for p in parts), sum(len(p[1]) + len(p[3]) for p in parts), sum(bool(p[0]) for p in parts))
            out.append((parts[::-1], child[::-1], weight, said))
    return out


def _fits(node: Node, compound: tuple) -> bool:
    tag, classes, ids, attrs = compound
    a = node.attrs
    if tag and tag != node.tag:
        return False
    if classes and not set(classes) <= set(a.get("class", "").split()):
        return False
    return all(a.get("id") == x for x in ids) and all(k in a and (v is None or a[k] == v) for k, v in attrs)


def _selected(node: Node, parts: list[tuple], child: list[bool]) -> bool:
    if not _fits(node, parts[0]):
        return False
    todo = [(node, 1)]
    while todo:  # descendants may fit at several ancestors
        at, k = todo.pop()
        if k == len(parts):
            return True
        up = at.parent
        while up is not None:
            if _fits(up, parts[k]):
                todo.append((up, k + 1))
            if child[k - 1]:
                break
            up = up.parent
    return False


def apply_sheets(root: Node) -> None:
    """Sets sheet (display, visibility) of every node that a rule of the page's style elements selects."""
    sheets, todo, nodes = [], [root], []
    while todo:
        node = todo.pop()
        nodes.append(node)
        if node.tag == "style" and node.attrs.get("media", "all").strip().lower() in ("", "all", "screen"):
            sheets.append("".join(c for c in node.children if isinstance(c, str)))
        kids = [c for c in node.children if isinstance(c, Node)]
        for c in kids:
            c.parent = node
        todo.extend(reversed(kids))
    rules = style_rules("\n".join(sheets)) if sheets else []
    if not rules:
        return
    by: dict[str, list] = {}
    for order, (parts, child, weight, said) in enumerate(rules):
        tag, classes, ids, _ = parts[0]
        by.setdefault(f"#{ids[0]}" if ids else f".{classes[0]}" if classes else tag or "*", []).append((order, parts, child, weight, said))
    for node in nodes:
        names = ["*", node.tag, f"#{node.attrs.get('id', '')}", *(f".{c}" for c in node.attrs.get("class", "").split())]
        best: dict[str, tuple] = {}
        for order, parts, child, weight, said in [r for n in names for r in by.get(n, ())]:
            if _selected(node, parts, child):
                for place, (p, v, important) in enumerate(said):
                    rank = (important, weight, order, place)
                    if p not in best or rank > best[p][0]:
                        best[p] = (rank, v)
        node.sheet = {p: (v, rank[0]) for p, (rank, v) in best.items()}


def build(text: str) -> Node:
    """The tree of a page, with implied start and end tags."""
    root = Node("html", {})
    stack, open_count = [root], {"html": 1}
    at, n = 0, len(text)

    def pop() -> None:
        open_count[stack.pop().tag] -= 1

    def push(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        stack.append(node)
        open_count[tag] = open_count.get(tag, 0) + 1

    def close(tags: set[str] | frozenset[str], limit: set[str] | frozenset[str]) -> None:
        if not any(open_count.get(t) for t in tags):
            return
        cut = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cut = i
            elif stack[i].tag in limit:
                break
        while cut and len(stack) > cut:
            pop()

    def words(part: str) -> None:
        if part:
            if open_count.get("head") and stack[-1].tag == "head" and not part.isspace():
                pop()
            stack[-1].children.append(entities.unescape(part) if "&" in part else part)

    while at < n:
        m = TOKEN.search(text, at)
        if m is None:
            words(text[at:])
            break
        words(text[at : m.start()])
        at = m.end()
        name = m[1]
        if not name or m[3] != ">":
            continue
        tag = name.lower()
        if text[m.start() + 1] == "/":
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body") and open_count.get(tag):
                inline, blocked = tag not in BLOCK and tag not in ("td", "th", "select"), False
                for i in range(len(stack) - 1, 0, -1):
                    own = stack[i].tag
                    if own == tag:
                        if not blocked or hidden(stack[i]):
                            while len(stack) > i:
                                pop()
                        elif tag in FORMAT:
                            open_count[stack.pop(i).tag] -= 1
                        break
                    blocked = blocked or (inline and (own in BLOCK or own in ("td", "th")))
                    if own in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
            continue
        attrs = {}
        if m[2]:
            for k, a, b, c in ATTR.findall(m[2]):
                value = a or b or c
                attrs.setdefault(k.lower(), entities.unescape(value) if "&" in value else value)
        if tag in ("html", "body"):
            close({"head"}, frozenset())
            root.attrs |= {k: v for k, v in attrs.items() if k not in root.attrs}
            continue
        if open_count.get("head") and tag not in HEAD_ONLY and stack[-1].tag == "head":
            pop()
        if tag in ENDS_P and open_count.get("p"):
            close({"p"}, SCOPE)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and open_count.get("table") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr", {})
        if tag in VOID:
            stack[-1].children.append(Node(tag, attrs))
            continue
        push(tag, attrs)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(text, at)
            inner = text[at : end.start() if end else n]
            stack[-1].children.append(entities.unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else n
            pop()
    return root


def _style(node: Node, prop: str) -> str | None:
    """The value of display or visibility that is declared for a node."""
    value, important = node.sheet.get(prop, (None, False))
    if "style" in node.attrs:
        for p, v, loud in DECLARED.findall(node.attrs["style"]):
            if p.lower() == prop and (loud or not important):
                value, important = v.lower(), bool(loud) or important
    return value


def hidden(node: Node) -> bool:
    """Whether a node and all in it are not rendered."""
    a = node.attrs
    if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in a):
        return True
    if not a and not node.sheet:
        return False
    display = _style(node, "display") if "style" in a or node.sheet else None
    return display == "none" if display else "hidden" in a


def seen(node: Node, inherited: bool) -> bool:
    """Whether a node's own text is visible."""
    value = _style(node, "visibility") if "style" in node.attrs or node.sheet else None
    return inherited if value in (None, "inherit", "unset") else value not in ("hidden", "collapse")


def chosen(select: Node) -> list[Node]:
    """Of a select's options those that it shows: the chosen one or the first; of one with several rows, all."""
    options, todo = [], list(reversed(select.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Node):
            if c.tag == "option":
                options.append(c)
            todo.extend(reversed(c.children))
    size = select.attrs.get("size", "")
    if "multiple" in select.attrs or (size.isdigit() and int(size) > 1):
        return options
    return [c for c in options if "selected" in c.attrs][-1:] or options[:1]


class Page:
    """Collects text with collapsed white space, line breaks and indents."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line ends that are due before the next text
        self.space = False
        self.indent = self.marker = ""

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        if self.lines:
            self.gap = max(self.gap, gap)

    def start(self) -> None:
        if not self.line:
            if self.gap > 1:
                self.lines.append("")
            self.gap = 0
            self.line.append(self.marker or self.indent)
            self.marker = ""

    def words(self, text: str) -> None:
        parts = SPACE.split(text)
        if len(parts) == 1 and not parts[0]:
            return
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        body = " ".join(p for p in parts if p)
        if body:
            fresh = not self.line
            self.start()
            self.line.append(f" {body}" if self.space and not fresh else body)
            self.space = False
        if parts[-1] == "":
            self.space = True

    def verbatim(self, text: str) -> None:
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                if not self.line:
                    self.start()
                self.lines.append("".join(self.line).rstrip(" "))
                self.line = []
            if part:
                self.start()
                self.line.append(part)

    def brk(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines and not self.gap:
            self.lines.append("")

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(1000, max(1, int(value))) if value.isdigit() and len(value) < 9 else 1


def wrapped(text: str) -> list[str]:
    """Lines of a cell, cut at spaces where they exceed WIDEST characters."""
    out = []
    for line in text.split("\n"):
        while len(line) > WIDEST:
            at = line.rfind(" ", 1, WIDEST + 1)
            at = at if at > 0 else line.find(" ", WIDEST)
            if at < 0:
                break
            out.append(line[:at].rstrip(" "))
            line = line[at + 1 :]
        out.append(line)
    return out


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table of (text, columns, rows) cells."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}
    for row in rows:
        at, line, new = 0, {}, {}
        for text, cols, deep in row:
            while held.get(at, 0) > 0:
                at += 1
            line[at] = (wrapped(text), cols)
            if deep > 1:
                for c in range(at, at + cols):
                    new[c] = deep
            at += cols
        held = {c: d - 1 for c, d in held.items() if d > 1} | {c: d - 1 for c, d in new.items()}
        grid.append(line)
    used = sorted({at for line in grid for at in line})  # columns where no cell begins take no room
    place = {c: k for k, c in enumerate(used)}
    width = [0] * len(used)
    spans: list[tuple[int, int, int]] = []
    for line in grid:
        for at, (lines, cols) in line.items():
            longest = max((len(x) for x in lines if len(x) <= WIDEST), default=0)
            first, last = place[at], place[at]
            while last + 1 < len(used) and used[last + 1] < at + cols:
                last += 1
            if first == last:
                width[first] = max(width[first], longest)
            else:
                spans.append((last - first, first, longest))
    for more, first, longest in sorted(spans):  # what a spanning cell lacks goes to its last column
        room = sum(width[first : first + more + 1]) + 2 * more
        width[first + more] += max(0, longest - room)
    out = []
    for line in grid:
        cells, k = [], 0
        while k < len(used) and used[k] <= max(line, default=-1):
            if used[k] in line:
                lines, cols = line[used[k]]
                last = k
                while last + 1 < len(used) and used[last + 1] < used[k] + cols:
                    last += 1
                cells.append((sum(width[k : last + 1]) + 2 * (last - k), lines))
                k = last + 1
            else:
                cells.append((width[k], []))
                k += 1
        for r in range(max((len(x) for _, x in cells), default=0)):
            out.append("  ".join((x[r] if r < len(x) else "").ljust(w) for w, x in cells).rstrip(" "))
    return out


def render(root: Node) -> str:
    apply_sheets(root)
    page = Page()
    pages: list[Page] = []
    tables: list[list] = []
    lists: list[list] = []
    pre = 0
    todo: list[tuple] = [(root, True)]
    while todo:
        node, enter = todo.pop()
        if isinstance(node, str):
            if enter != SILENT:
                page.verbatim(node) if pre else page.words(node)
            continue
        tag = node.tag
        if enter:
            if hidden(node):
                continue
            shown = seen(node, enter != SILENT)
            if tag == "br":
                page.brk()
                continue
            if tag == "hr":
                page.block(2)
                continue
            if tag == "img":
                continue
            if tag == "input":
                if shown and node.attrs.get("type", "text").lower() in ("text", "submit", "button", "search", "email", "url", "reset") and node.attrs.get("value"):
                    page.words(node.attrs["value"])
                continue
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag == "select":
                children = chosen(node)
            if tag == "title":  # outside of the head: of a drawing, which shows it only on demand
                continue
            if tag in BLOCK:
                nested = tag in ("ul", "ol", "menu", "dir") and lists
                page.block(1 if nested or tag not in WIDE else 2)
            if tag in ("pre", "textarea", "xmp"):
                pre += 1
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1").strip()
                lists.append([tag, int(start) if start.lstrip("-").isdigit() and len(start) < 9 else 1])
            elif tag == "li":
                own = lists[-1] if lists else ["ul", 1]
                mark = f"{own[1]}. " if own[0] == "ol" else "- "
                own[1] += 1
                page.marker = page.indent + (mark if shown else " " * len(mark))
                todo.append((("indent", page.indent), False))
                page.indent += " " * len(mark)
            elif tag == "dd":
                todo.append((("indent", page.indent), False))
                page.indent += "    "
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th"):
                if tables:
                    if not tables[-1]:
                        tables[-1].append([])
                    pages.append(page)
                    page = Page()
                else:
                    page.words(" ")
            if tag in BLOCK or tag in ("td", "th", "pre", "textarea", "xmp"):
                todo.append((node, False))
            todo.extend((c, True if shown else SILENT) for c in reversed(children))
            continue
        if isinstance(node, tuple):
            continue
        if tag in ("td", "th"):
            if tables and pages:
                tables[-1][-1].append((page.text(), _span(node, "colspan"), _span(node, "rowspan")))
                page = pages.pop()
            continue
        if tag in ("pre", "textarea", "xmp"):
            pre -= 1
        elif tag in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        elif tag == "li" or tag == "dd":
            page.end_line()
            if page.marker:  # an empty item
                page.start()
                page.end_line()
            back = todo.pop()[0]
            page.indent = back[1]
        elif tag == "table" and tables:
            page.end_line()
            for line in aligned([r for r in tables.pop() if r]):
                if line:
                    page.start()
                    page.line.append(line)
                    page.end_line()
        if tag in BLOCK:
            page.block(1 if tag not in WIDE or (tag in ("ul", "ol", "menu", "dir") and lists) else 2)
    while pages:  # cells that no end tag closed
        tail = page.text()
        page = pages.pop()
        page.block(1)
        page.verbatim(tail)
    return page.text()


def html_to_text(html: str | None) -> str:
    return render(build(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_lines, n_chars of every row; no exchange."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [html_to_text(x) for x in batch.column("html").to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_lines", "n_chars"])

    return rows.mapInArrow(run, "page_id long, text string, n_lines long, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
