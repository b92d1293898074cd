"""HTML to Markdown with the standard library's parser: headings, lists, links, tables, code."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# Elements that stand as blocks of their own.
BLOCK = ("p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre", "dl", "figure", "address", "aside", "details", "summary")
# Elements whose content is no text.
PLAIN_DROP = ("script", "style", "noscript")
# Elements that a page's Markdown leaves out.
PAGE_DROP = (
    "head", "title", "meta", "link", "base", "script", "style", "noscript", "svg", "iframe", "form", "header", "footer", "nav",
    "button", "select", "img", "picture", "video", "source",
)
#: Open elements that a start tag ends.
CLOSED_BY = {"li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
# Fixed value: class names of page furniture.
FURNITURE = re.compile(r"breadcrumb|subscribe|newsletter|modal", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    """Lenient tree: end tags close the nearest open element of their name; p and li close themselves."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.open = [self.root]
        self.named: Counter[str] = Counter()  # open elements by name: an end tag that ends none is known at once

    def _close(self) -> str:
        tag = self.open.pop().tag
        self.named[tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open[-1].tag in CLOSED_BY.get(tag, ()):
            self._close()
        if self.open[-1].tag == "p" and (tag in BLOCK or re.fullmatch("h[1-6]", tag)):
            self._close()
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.named[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        while self.named[tag]:
            if self._close() == tag:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _text(node: Node | str) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo.extend(reversed(n.children))
    return "".join(out)


def _squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def _own(node: Node, tags: tuple[str, ...]) -> Iterator[Node]:
    """Elements of these names that belong to `node`: not those of an inner element like itself, nor what they contain."""
    todo = list(reversed(node.children))
    while todo:
        n = todo.pop()
        if isinstance(n, Node):
            if n.tag in tags:
                yield n
            elif n.tag != node.tag:
                todo.extend(reversed(n.children))


#: A step of writing: asks for the Markdown of one child after another, ends with its own.
Written = Generator["Node", str, str]


class _Writer:
    def __init__(self, page: bool):
        self.page = page
        self.drop = PAGE_DROP if page else PLAIN_DROP
        self.tables = 0
        self.marks: list[str] = []  # emphasis that is open: an unclosed tag must not mark its text twice

    def render(self, root: Node) -> str:
        """Markdown of all that is in `root`.  Open elements lie on a list of their own, so depth has no limit."""
        open_, value = [self.inside(root)], None
        while open_:
            try:
                child = open_[-1].send(value)
            except StopIteration as end:
                open_.pop()
                value = end.value
            else:
                open_.append(self.write(child))
                value = None
        return value

    def inside(self, node: Node) -> Written:
        out = []
        for c in node.children:
            out.append(re.sub(r"[ \t\r\n]+", " ", c) if isinstance(c, str) else (yield c))
        return "".join(out)

    def write(self, node: Node) -> Written:
        t, a = node.tag, node.attrs
        if t in self.drop or self.page and (FURNITURE.search(a.get("class") or "") or a.get("aria-hidden") == "true" or "hidden" in a):
            return ""
        if re.fullmatch("h[1-6]", t):
            title = yield from self.inside(node)
            title = _squeeze(title) if self.page else title.strip()
            return f"\n\n{'#' * int(t[1])} {title}\n\n" if title else ""
        if t == "br":
            return "  \n"
        if t == "hr":
            return "\n\n* * *\n\n"
        if t == "pre":
            return f"\n\n```\n{_text(node).strip(chr(10))}\n```\n\n"
        if t == "code":
            return f"`{_text(node)}`"
        if t in ("b", "strong", "i", "em"):
            mark = "**" if t in ("b", "strong") else "_"
            if mark in self.marks or any(isinstance(c, Node) and c.tag in BLOCK for c in node.children):
                return (yield from self.inside(node))
            self.marks.append(mark)
            body = yield from self.inside(node)
            self.marks.pop()
            return f"{body[: len(body) - len(body.lstrip())]}{mark}{body.strip()}{mark}{body[len(body.rstrip()) :]}" if body.strip() else body
        if t == "a":
            body = yield from self.inside(node)
            return f"[{body.strip()}]({a['href']})" if a.get("href") else body
        if t == "img":
            return f"![{a.get('alt') or ''}]({a['src']})" if a.get("src") else ""
        if t in ("ul", "ol"):
            return "\n\n" + "\n".join((yield from self.items(node))) + "\n\n"
        if t == "dl" and self.page:
            terms, defs = ([x for x in (_squeeze(_text(n)) for n in _own(node, ("dt", "dd")) if n.tag == k) if x] for k in ("dt", "dd"))
            if terms and len(terms) == len(defs):
                return "\n\n" + "\n".join(f"- {k}: {v}" for k, v in zip(terms, defs, strict=True)) + "\n\n"
        if t == "table":
            return (yield from self.table(node))
        if t == "blockquote":
            return "\n\n" + "\n".join(f"> {x}" for x in tidy_blank((yield from self.inside(node))).split("\n")) + "\n\n"
        body = yield from self.inside(node)
        return f"\n\n{body.strip(' ')}\n\n" if t in BLOCK or t in ("dt", "dd", "tr") else body

    def items(self, node: Node) -> Written:
        n, out = 0, []
        for c in node.children:
            if isinstance(c, Node) and c.tag == "li":
                n += 1
                mark = f"{n}." if node.tag == "ol" else "-"
                body = tidy_blank((yield from self.inside(c))).replace("\n", "\n    ")
                if body:
                    out.append(f"{mark} {body}")
        return out

    def table(self, node: Node) -> Written:
        """A table of its own rows; one inside a cell is the text of its cells, as a cell is one line."""
        rows, inner = [], self.tables > 0
        self.tables += 1
        for r in _own(node, ("tr",)):
            cells = []
            for c in r.children:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    cells.append(_squeeze((yield from self.inside(c))))
            if cells:
                rows.append(cells)
        self.tables -= 1
        if not rows or inner:
            return " ".join(x for r in rows for x in ("", *r, ""))
        lines = [f"| {' | '.join(x.replace('|', chr(92) + '|') for x in r)} |" for r in rows]
        lines.insert(1, f"| {' | '.join('---' for _ in rows[0])} |")
        return "\n\n" + "\n".join(lines) + "\n\n"


def tidy_blank(md: str) -> str:
    md = "\n".join(x.rstrip(" \t") if not x.endswith("  ") else x.rstrip() for x in md.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() if not x.strip() else x for x in md.split("\n"))).strip()


def html_to_markdown(html: str | None, page: bool = False) -> str:
    """Markdown of an HTML text; `page` also drops navigation, forms and hidden furniture.  Null is empty."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    lines, code = [], False
    for x in tidy_blank(_Writer(page).render(tree.root)).split("\n"):
        code ^= x.startswith("```")
        lines.append(x[1:] if x.startswith(" ") and not x.startswith("    ") and not code else x)
    return "\n".join(lines)


# Lines of a scraped page that say nothing.
NOISE = ("* * *", "-", "Loading...")
#: A line of so many characters, or a heading, is kept once.
REPEATED_CHARS = 25


def tidy(md: str) -> str:
    """Layout noise of a scraped page: empty links, icon rules, placeholders, and repeats of headings or long lines."""
    md = re.sub(r"\[\s*\]\([^)]*\)", "", md)
    seen: set[str] = set()
    kept = []
    for line in (x.rstrip(" \t ").replace(" ", " ") for x in md.split("\n")):
        key = line.strip()
        if key in NOISE:
            continue
        if re.match(r"#{1,6}\s", key) or len(key) >= REPEATED_CHARS:
            if key in seen:
                continue
            seen.add(key)
        kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def with_markdown(pages: DataFrame, html: str = "html", out: str = "markdown", page: bool = True) -> DataFrame:
    """`pages` with the Markdown of its HTML column, by Arrow batches."""
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            md = [html_to_markdown(x, page) for x in batch[html].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in names), pa.array([tidy(x) if page else x for x in md], pa.string())], names=[*names, out])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())]))
