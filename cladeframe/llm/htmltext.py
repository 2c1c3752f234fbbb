"""Visible text of HTML pages as a browser would lay it out.

A tree builder with implied tags and a visibility test make a tree; rendering walks it and keeps block spacing, lists and
aligned table cells.  Of SVG the ``text`` and ``foreignObject`` elements show their text, of MathML all but annotations.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from cladeframe.llm.common import map_slices, without

#: Elements below this depth are opened and closed like others, but what they hold is added to the one at it; the text stays.
DEPTH = 200
#: Table columns are padded up to this width; a longer cell sticks out.
COLUMN = 60
#: How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp".split())
UNSEEN = RAW | frozenset("head title meta link base object video audio canvas datalist".split())
#: What may stand in a head without ending it.
HEAD = RAW - {"iframe", "noembed", "xmp"} | frozenset("head title meta link base basefont bgsound".split())
#: Where HTML begins again inside SVG and MathML, their parts that show nothing, and tags of HTML that end them.
POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
FOREIGN_UNSEEN = frozenset("desc metadata defs symbol marker pattern clippath mask filter lineargradient radialgradient annotation annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre figure fieldset table hr".split())
BLOCKS = SPACED | frozenset("html body main section article aside header footer nav address div center form li dt dd details summary figcaption legend hgroup search option optgroup dialog".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: A start tag ends these open elements, looking up no further than the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "caption": ({"caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: What begins and ends on a line of its own.
APART = BLOCKS | SECTIONS | frozenset("tr td th caption".split())
CLOSE_P = BLOCKS - {"html", "body", "option", "optgroup"}
P_SCOPE = frozenset("td th table button caption object".split())
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
#: One declaration of a style, as semicolons may stand in strings and parentheses.
DECLARATION = re.compile(r"(?:[^;\"'(]++|\"[^\"]*+\"?|'[^']*+'?|\([^)]*+\)?)++")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
NESTED = re.compile(r"<(/?)template(?=[\s/>])", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
UNQUOTED = re.compile(r"=\s*+[^\s\"'>]++\Z")
BLANK = " \t\n\r\f"
BLANKS = re.compile("[ \t\n\r\f]+")
BREAK = "\0"


def declared(style: str) -> dict[str, str]:
    """Values of the properties that a style declares, in lower case; the last one counts, important ones before others."""
    out: dict[str, tuple[bool, str]] = {}
    for d in DECLARATION.findall(COMMENT.sub("", html.unescape(style))):
        name, colon, value = d.partition(":")
        if colon:
            value, mark, rest = value.strip(BLANK).lower().partition("!")
            important = mark != "" and rest.strip(BLANK) == "important"
            name = name.strip(BLANK).lower()
            if important or not out.get(name, (False, ""))[0]:
                out[name] = important, value.strip(BLANK)
    return {k: v for k, (_, v) in out.items()}


class Node:
    __slots__ = ("tag", "kids", "number", "span", "rows", "unseen", "shows", "closed", "space")

    def __init__(self, tag: str, attributes: str = "", space: str = "", shows: bool = True):
        """``space`` is "math", "svg", "text" (inside an SVG text) or, for HTML, empty; ``shows`` whether the parent's own text does."""
        self.tag, self.kids, self.number, self.span, self.rows, self.space, self.shows = tag, [], None, 1, 1, space, shows
        self.unseen = tag in UNSEEN or space != "" and tag in FOREIGN_UNSEEN
        open_, css = False, {}
        if attributes and not attributes.isspace():
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden":
                    self.unseen = True
                elif name == "style":
                    css |= declared(value)
                elif space and name in ("display", "visibility"):
                    css.setdefault(name, value.strip(BLANK).lower())
                elif name == "open":
                    open_ = True
                elif name in ("start", "value") and re.fullmatch(r"-?\d{1,9}", value):
                    self.number = int(value)
                elif name == "colspan" and re.fullmatch(r"\d{1,4}", value):
                    self.span = max(1, min(int(value), 1000))
                elif name == "rowspan" and re.fullmatch(r"\d{1,5}", value):
                    self.rows = min(int(value), 65534)
        self.closed = tag == "details" and not open_  # becomes None when its summary has come
        self.unseen |= css.get("display") == "none" or tag == "dialog" and not open_
        if css.get("visibility") in ("hidden", "collapse", "visible"):
            self.shows = css["visibility"] == "visible"


def tree(page: str) -> Node:
    """The tree of a page; never fails, however broken the markup is."""
    root = Node("html")
    open_ = [root]
    places: dict[str, list[int]] = {}  # of the open elements but the root, by tag
    at, end = 0, len(page)
    begun = False  # something that ends or begins the head has come

    def last(tags) -> int:
        return max([places[t][-1] for t in tags if places.get(t)], default=0)

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(open_))
        open_.append(node)

    def drop(i: int) -> None:
        apart = i >= DEPTH and any(n.tag in APART for n in open_[i:])
        for n in open_[i:]:
            places[n.tag].pop()
        del open_[i:]
        if apart:
            open_[-1].kids.append(Node("div"))

    def close(tags, scope) -> None:
        while (i := last(tags)) and i >= last(scope):
            drop(i)
            if len(tags) <= 2:
                break  # else an outer one of the kinds may be open too (a section around a row)

    def foreign() -> bool:
        return open_[-1].space != "" and open_[-1].tag not in POINTS

    def add(text: str) -> None:
        nonlocal begun
        if text.strip(BLANK):
            begun = True
            if open_[-1].tag == "head":
                drop(len(open_) - 1)
        top = open_[-1]
        if top.space == "svg" and top.tag not in POINTS or not top.shows or top.closed is not False:
            return  # not in an SVG text, or hidden, or in a closed element beside its summary
        if not (text.isspace() and (top.tag in SECTIONS or top.tag in ("table", "tr"))):
            top.kids.append(text)

    def put(node: Node, opens: bool) -> None:
        """Add to the innermost element.  Below DEPTH an element that opens shares its list, or holds a lost one if unseen."""
        if open_[-1].closed is not False:  # of closed details only the first summary is seen
            node.unseen |= node.tag != "summary" or open_[-1].closed is None
            if node.tag == "summary":
                open_[-1].closed = None
        if opens and len(open_) >= DEPTH:
            if node.tag in APART:
                open_[-1].kids.append(Node("div"))
            if not node.unseen:
                node.kids = open_[-1].kids
        else:
            open_[-1].kids.append(node)
        if opens:
            push(node)

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if foreign() and page.startswith("<![CDATA[", m.start()):
                stop = page.find("]]>", m.start() + 9)
                add(page[m.start() + 9 : stop if stop >= 0 else end])
                at = stop + 3 if stop >= 0 else end
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[-1].tag == "head" and tag in ("br", "body", "html"):
                drop(len(open_) - 1)
            if tag == "br":
                open_[-1].kids.append(Node("br"))
                continue
            i = last((tag,))
            if i and (tag in SECTIONS or tag in ("table", "tr", "td", "th", "body") or i > last(("td", "th", "table"))):
                drop(i)
            continue
        if foreign():
            if tag not in BREAKOUT:
                top = open_[-1]
                space = tag if tag in ("svg", "math") else "text" if top.space == "svg" and tag == "text" else top.space
                put(Node(tag, m[3], space, top.shows), not (m[3].endswith("/") and not UNQUOTED.search(m[3])))
                continue
            i = len(open_) - 1
            while open_[i].space != "" and open_[i].tag not in POINTS:
                i -= 1
            drop(i + 1)
        if tag == "html" or tag == "body" and places.get("body") or tag == "head" and begun:
            continue
        begun = True
        if open_[-1].tag == "head" and tag not in HEAD:
            drop(len(open_) - 1)
        if tag in ("svg", "math"):
            put(Node(tag, m[3], tag, open_[-1].shows), not (m[3].endswith("/") and not UNQUOTED.search(m[3])))
            continue
        if tag in CLOSE_P:
            close({"p"}, P_SCOPE)
        if tag in ENDS:
            close(*ENDS[tag])
        elif tag == "table" and (open_[-1].tag in SECTIONS or open_[-1].tag in ("table", "tr")):
            close({"table"}, {"td", "th"})
        if tag in ("td", "th"):
            if not places.get("table"):
                continue
            if open_[-1].tag not in ("tr",):
                put(Node("tr", shows=open_[-1].shows), True)
        elif tag in SECTIONS or tag in ("tr", "caption"):
            if open_[-1].tag != "table" and open_[-1].tag not in SECTIONS:
                continue
        node = Node(tag, m[3], shows=open_[-1].shows)
        raw = tag in RAW or tag in ("title", "textarea")
        put(node, not raw and tag not in VOID)
        if raw:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if tag == "template":  # templates stand in templates
                inside = 1
                for stop in NESTED.finditer(page, at):
                    inside += -1 if stop[1] else 1
                    if not inside:
                        break
                else:
                    stop = None
            if tag == "textarea" and node.shows:
                node.kids.append(html.unescape(page[at : stop.start() if stop else end]))
            after = page.find(">", stop.end() - (tag != "template")) if stop else -1
            at = after + 1 if after >= 0 else end
    return root


class Flow:
    """Lines of one block; ``None`` is a gap, which joins with gaps beside it."""

    def __init__(self) -> None:
        self.lines: list[str | None] = []
        self.run: list[str] = []

    def flush(self) -> None:
        if self.run:
            text = "".join(self.run)
            self.run.clear()
            if BREAK in text or not (text == "" or text.isspace() and "\xa0" not in text):
                parts = text.split(BREAK)
                if not parts[-1].strip(" \t\n\r\f"):
                    parts.pop()
                self.lines += [BLANKS.sub(" ", p).strip(" ") for p in parts]

    def gap(self) -> None:
        self.flush()
        if self.lines and self.lines[-1] is not None:
            self.lines.append(None)

    def result(self) -> list[str]:
        self.flush()
        while self.lines and self.lines[-1] is None:
            self.lines.pop()
        return ["" if x is None else x for x in self.lines]


def flow(node: Node) -> list[str]:
    out = Flow()
    walk(node, out, False)
    return out.result()


def walk(node: Node, out: Flow, tight: bool) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            out.run.append(kid)
            continue
        tag = kid.tag
        if kid.unseen:
            continue
        if tag == "br":
            out.run.append(BREAK)
        elif tag not in APART and not (kid.space and tag in ("text", "foreignobject")):
            walk(kid, out, tight)
        else:
            between = out.gap if tag in SPACED and not (tight and tag in ("ul", "ol", "menu")) else out.flush
            between()
            if tag in ("ul", "ol", "menu"):
                items(kid, out)
            elif tag == "table":
                out.lines += cells(kid)
            elif tag == "pre":
                out.lines += preformatted(kid).removeprefix("\n").rstrip("\n").split("\n")
            elif tag == "blockquote":
                out.lines += ["> " + x if x else ">" for x in flow(kid)]
            elif tag == "dd":
                out.lines += ["    " + x if x else x for x in flow(kid)]
            elif tag == "li":
                out.lines += bulleted(kid, "- ")
            elif tag == "hr":
                out.lines += ["---"] if kid.shows else []
            else:
                walk(kid, out, tight and tag not in SPACED)
            between()


def bulleted(item: Node, mark: str) -> list[str]:
    inner = Flow()
    walk(item, inner, True)
    if not item.shows:
        return inner.result()
    lines = inner.result() or [""]
    return [(mark + lines[0]).rstrip(" ")] + [" " * len(mark) + x if x else x for x in lines[1:]]


def items(node: Node, out: Flow) -> None:
    number = node.number if node.number is not None else 1
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "li":
            if kid.unseen:
                continue
            out.flush()
            number = kid.number if kid.number is not None and node.tag == "ol" else number
            out.lines += bulleted(kid, f"{number}. " if node.tag == "ol" else "- ")
            number += 1
        else:
            holder = Node("div")
            holder.kids = [kid]
            walk(holder, out, True)
    out.flush()


def preformatted(node: Node) -> str:
    parts = []
    for kid in node.kids:
        parts.append(kid if isinstance(kid, str) else "" if kid.unseen else "\n" if kid.tag == "br" else preformatted(kid))
    return "".join(parts)


def cells(table: Node) -> list[str]:
    """Content outside cells, as browsers move it, caption, then rows; a cell of several lines makes its row as high.

    A cell that spans rows stands in the first of them and keeps its columns free in the others, as far as its section goes.
    """
    rows, caption, stray = [], [], Node("div")
    busy: list[int] = []  # rows for which each column is still taken

    def visit(node: Node) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                stray.kids.append(kid)
            elif kid.tag == "caption" and not kid.unseen:
                caption.extend(flow(kid))
            elif kid.tag in SECTIONS and not kid.unseen:
                busy.clear()
                visit(kid)
                busy.clear()
            elif kid.tag == "tr" and not kid.unseen:
                rows.append([])
                for cell in kid.kids:
                    if isinstance(cell, Node) and cell.tag in ("td", "th"):
                        if cell.unseen:
                            rows[-1].append([])
                            continue
                        at = len(rows[-1])
                        while at < len(busy) and busy[at]:
                            rows[-1].append([])
                            at += 1
                        rows[-1] += [flow(cell), *[[]] * (cell.span - 1)]
                        if cell.rows != 1:
                            busy.extend([0] * (at + cell.span - len(busy)))
                            for i in range(at, at + cell.span):
                                busy[i] = cell.rows or 1 << 30  # 0 means all rows of the section
                    else:
                        stray.kids.append(cell)
                busy[:] = [max(0, n - 1) for n in busy]
            else:
                stray.kids.append(kid)

    visit(table)
    width: list[int] = []
    for line in rows:
        for i, cell in enumerate(line):
            if i == len(width):
                width.append(0)
            width[i] = max([width[i], *(w for w in map(columns, cell) if w <= COLUMN)])
    out = flow(stray) + caption
    for line in rows:
        for k in range(max([len(c) for c in line], default=0)):
            out.append("  ".join(padded(c[k] if k < len(c) else "", w) for c, w in zip(line, width)).rstrip(" "))
    return out


def columns(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def padded(text: str, width: int) -> str:
    return text + " " * (width - columns(text))


def render(page: str | None) -> str:
    """Visible text; empty for null, empty or invisible pages."""
    return "\n".join(flow(tree(page.replace(BREAK, "�").replace("\r\n", "\n")))).strip("\n") if page else ""


def extract(pages: DataFrame, markup: str = "html") -> DataFrame:
    """All columns but the markup, and ``text``; an input column of that name gives way.

    Null, empty and invisible pages have an empty text; each row is rendered by itself, so repeated rows come out as often.
    Hidden are what ``hidden`` (also until found) or a style attribute hides, dialogs that aren't open and, of details that aren't, all
    but the summary; style sheets aren't read.  A visible part of an element with hidden visibility is shown.
    """
    pages = without(pages, ["text"] if markup != "text" else [])
    rest = [f for f in pages.schema.fields if f.name != markup]
    schema = T.StructType([*rest, T.StructField("text", T.StringType())])
    return map_slices(pages, markup, schema, lambda: lambda part: {"text": pa.array([render(p) for p in part.column(markup).to_pylist()], pa.string())})
