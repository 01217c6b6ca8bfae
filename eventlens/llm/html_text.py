"""HTML to text as it is laid out: all visible text, with block spacing, lists
and aligned tables.

The standard library's tokenizer feeds a small tree builder that closes elements
the way browsers imply it (a paragraph before a block, a list item before the
next one, cells before rows, ...).  Nothing recurses: a tree is walked with a
stack, and tables are laid out from the innermost outwards, so pages may nest
as deep as they like.

Visible is what is not in an element that is never shown (head, script, ...),
``hidden``, ``display:none`` (inline or by a simple style rule for a tag, class
or id), a closed ``details`` or ``dialog``; ``visibility:hidden`` hides text
until a descendant turns it on again.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("head title style script template noscript noframes iframe object audio video canvas datalist "
            "defs desc metadata annotation annotation-xml".split())
APART = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = APART | set("address article aside body center details dialog dd div dt fieldset figcaption footer form header "
                    "hgroup html legend li main menu nav option optgroup search section summary tr caption".split())
#: Start tag: the open elements it closes, and the elements that stop the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}
P_SCOPE = {"table", "td", "th", "button", "caption", "html", "body"}
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SIMPLE = re.compile(r"[.#]?[A-Za-z][\w-]*")
WHOLE = re.compile(r"\s*([+-]?\d{1,9})(?!\d)", re.ASCII)
SPACE = re.compile(r"[ \t\n\r\f\v ]+")


def _number(value: str | None, default: int) -> int:
    """A leading whole number of up to nine digits, else the default."""
    found = WHOLE.match(value or "")
    return int(found[1]) if found else default


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    """Tree of elements and strings; ``hide``: style selectors that hide."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.count = Counter(html=1)    # open elements by tag
        self.hide: dict[str, str] = {}

    def _close(self, tags: set, stop: set) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                self.count.subtract(n.tag for n in self.open[i:])
                del self.open[i:]
                return
            if tag in stop:
                return

    def parse_marked_section(self, i, report=1):
        """Marked sections mean nothing in HTML: comments, up to the next ">"."""
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.count[tag]:
            return
        if tag in BLOCK:
            self._close({"p"}, P_SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif self.open[-1].tag == "head" and tag not in NEVER | VOID:
            self.count[self.open.pop().tag] -= 1  # content that ends the head
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body") or tag in VOID and tag != "br":
            return
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        stop = set() if tag in ("table", "html") else {"table"} if tag in ("tr", "tbody", "thead", "tfoot", "td", "th") else {"td", "th", "table"}
        self._close({tag}, stop)

    def handle_data(self, data):
        top = self.open[-1]
        if top.tag == "style":
            for selectors, body in RULE.findall(data):
                body = body.replace(" ", "").lower()
                for s in map(str.strip, selectors.split(",")):
                    if SIMPLE.fullmatch(s) and ("display:none" in body or "visibility:hidden" in body):
                        self.hide[s if s[0] in ".#" else s.lower()] = "none" if "display:none" in body else "hidden"
        else:
            if top.tag == "head" and data.strip():
                self.count[self.open.pop().tag] -= 1
            self.open[-1].children.append(data)


def _hiding(node: Node, hide: dict[str, str]) -> str | None:
    """none: not laid out; hidden / visible: its text; None: as its parent."""
    a = node.attrs
    if node.tag in NEVER or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return "none"
    if node.tag == "input":
        return "none"
    style = (a.get("style") or "").replace(" ", "").lower()
    if "display:none" in style:
        return "none"
    ruled = {hide.get(node.tag), hide.get("#" + (a.get("id") or "")), *(hide.get("." + c) for c in (a.get("class") or "").split())} if hide else set()
    if "none" in ruled and "display:" not in style:
        return "none"
    if "visibility:hidden" in style or "visibility:collapse" in style:
        return "hidden"
    if "visibility:visible" in style:
        return "visible"
    return "hidden" if "hidden" in ruled else None


class Page:
    """Lines of text with collapsed white space."""

    def __init__(self):
        self.lines, self.line, self.gap, self.blank = [], [], False, False
        self.prefix, self.marker = "", None

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.split("\n")
            self._put(first)
            for r in rest:
                self.end(force=True)
                self._put(r)
            return
        words = SPACE.sub(" ", data)
        if words == " ":
            self.gap = self.gap or bool(self.line)
            return
        if words[0] == " ":
            self.gap, words = self.gap or bool(self.line), words[1:]
        tail = words[-1:] == " "
        self._put(words[:-1] if tail else words)
        self.gap = tail

    def _put(self, words: str) -> None:
        if words:
            if not self.line:
                if self.blank and self.lines:
                    self.lines.append("")
                self.blank = False
                self.line.append(self.marker if self.marker is not None else self.prefix)
                self.marker = None
            elif self.gap:
                self.line.append(" ")
            self.gap = False
            self.line.append(words)

    def end(self, apart: bool = False, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.gap = False
        self.blank = self.blank or apart

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _cells(node: Node, hide: dict, shown: bool) -> tuple[list[list[Node | str]], list[list[bool]], list[tuple[Node | str, bool]]]:
    """Rows of cells of a table, whether each is shown, and what is in the table
    outside of rows."""
    rows, visible, apart = [], [], []
    todo = [(c, shown) for c in reversed(node.children)]
    while todo:
        child, on = todo.pop()
        if isinstance(child, str):
            if child.strip():
                apart.append((child, on))
            continue
        how = _hiding(child, hide)
        if how == "none":
            continue
        on = on if how is None else how == "visible"
        if child.tag == "tr":
            rows.append([])
            visible.append([])
            for cell in child.children:
                own = None if isinstance(cell, str) else _hiding(cell, hide)
                if own != "none" and not (isinstance(cell, str) and not cell.strip()):
                    rows[-1].append(cell)
                    visible[-1].append(on if own is None else own == "visible")
        elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo.extend((c, on) for c in reversed(child.children))
        else:
            apart.append((child, on))
    return rows, visible, apart


def _lines(part: Node | str, hide: dict, on: bool, done: dict) -> list[str]:
    if isinstance(part, str):
        return [SPACE.sub(" ", part).strip()] if on and part.strip() else []
    text = layout(part, hide, on, done)
    return text.split("\n") if text else []


def _table(node: Node, hide: dict, shown: bool, done: dict) -> list[str]:
    """Aligned rows: columns two spaces apart, a cell as many lines high as its
    blocks are; a cell that spans columns does not widen them, one that spans
    rows keeps its column in the rows below."""
    rows, visible, apart = _cells(node, hide, shown)
    out = [line for part, on in apart for line in _lines(part, hide, on, done)]
    placed: list[list[tuple[int, int, list[str]]]] = []
    width: dict[int, int] = {}
    below: dict[int, int] = {}   # column -> rows that a cell from above still covers
    for row, on in zip(rows, visible):
        at, line, covered = 0, [], {c: n - 1 for c, n in below.items() if n > 1}
        for cell, shows in zip(row, on):
            while at in below:
                at += 1
            attrs = {} if isinstance(cell, str) else cell.attrs
            wide = min(1000, max(1, _number(attrs.get("colspan"), 1)))
            high = min(65534, max(1, _number(attrs.get("rowspan"), 1)))
            text = _lines(cell, hide, shows, done)
            if wide == 1:
                width[at] = max(width.get(at, 0), max(map(len, text), default=0))
            if high > 1:
                covered.update((c, high - 1) for c in range(at, at + wide))
            line.append((at, wide, text))
            at += wide
        below = covered
        placed.append(line)
    left, total = {}, 0
    for c in range(max((at + wide for line in placed for at, wide, _ in line), default=0) + 1):
        left[c], total = total, total + (width[c] + 2 if c in width else 2)
    for line in placed:
        for i in range(max((len(text) for _, _, text in line), default=0)):
            row = ""
            for at, _, text in line:
                if i < len(text) and text[i]:
                    gap = max(left[at] - len(row), 2 if row else 0)
                    row += " " * gap + text[i]
            out.append(row.rstrip())
    return out


def _tables(root: Node, hide: dict) -> list[tuple[Node, bool]]:
    """Tables that are laid out, outer before inner, and whether they are shown."""
    found, todo = [], [(root, True)]
    while todo:
        node, on = todo.pop()
        how = _hiding(node, hide) if node is not root else None
        if how == "none":
            continue
        on = on if how is None else how == "visible"
        if node.tag == "table":
            found.append((node, on))
        todo.extend((c, on) for c in node.children if isinstance(c, Node))
    return found


def layout(root: Node, hide: dict, shown: bool = True, done: dict | None = None) -> str:
    """Text of a subtree; ``done`` holds the lines of the tables in it."""
    page = Page()
    todo: list = [("in", root, shown, False)]
    lists: list = []  # [ordered, next number]
    while todo:
        what, node, on, pre = todo.pop()
        if what == "text":
            if on:
                page.text(node, pre)
            continue
        if what == "out":
            if node.tag in BLOCK:
                page.end(apart=node.tag in APART and not (node.tag in ("ul", "ol") and len(lists) > 1))
            if node.tag in ("ul", "ol", "menu"):
                lists.pop()
            if node.tag == "li":
                page.prefix, page.marker = pre, None
            continue
        how = _hiding(node, hide) if node is not root else None
        if how == "none":
            continue
        on = on if how is None else how == "visible"
        tag = node.tag
        if tag == "br":
            page.end(force=True)
            continue
        if tag in BLOCK:
            page.end(apart=tag in APART and not (tag in ("ul", "ol") and lists))
        if tag == "table":
            for line in (done or {}).get(id(node), ()):
                page.text(line, True)
                page.end(force=not line)
            page.end(apart=True)
            continue
        if tag in ("ul", "ol", "menu"):
            lists.append([tag == "ol", _number(node.attrs.get("start"), 1)])
        pre = pre or tag in ("pre", "textarea")
        if tag == "li":
            before = page.prefix
            if lists and lists[-1][0]:
                lists[-1][1] = _number(node.attrs.get("value"), lists[-1][1])
            ordered, number = lists[-1] if lists else (False, 1)
            mark = f"{number}. " if ordered else "- "
            if lists:
                lists[-1][1] += 1
            page.marker = before + mark
            page.prefix = before + " " * len(mark)
            todo.append(("out", node, on, before))
        else:
            todo.append(("out", node, on, pre))
        closed = tag == "details" and "open" not in node.attrs
        for child in reversed(node.children):
            if isinstance(child, str):
                if not closed:
                    todo.append(("text", child, on, pre))
            elif not closed or child.tag == "summary":
                todo.append(("in", child, on, pre))
    return page.result()


def page_text(html: str | None) -> str:
    """Visible text of one page; null as empty."""
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    done: dict[int, list[str]] = {}
    for table, on in reversed(_tables(builder.root, builder.hide)):
        done[id(table)] = _table(table, builder.hide, on, done)
    return layout(builder.root, builder.hide, True, done)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id and ``text``.

    A null or empty page gives an empty text; text without any tag comes back
    with its white space collapsed; unclosed and unknown tags, marked sections
    and numbers of any length are tolerated.  A page of any length is read whole,
    alone in memory.
    Pages are independent, so there is no shuffle.  Repeated rows and null ids
    are kept; an empty table gives an empty result."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([page_text(h.as_py()) for h in batch.column(1)], pa.string())], names=["id", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
