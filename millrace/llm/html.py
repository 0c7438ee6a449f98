"""HTML to text with layout, and HTML to ordered sequences of text and media.

A tolerant tokenizer feeds a tree builder that keeps a stack of open elements: tags that HTML
lets authors leave out are implied, and stray end tags are ignored. Rendering follows the
stack as it opens and closes, so no tree is kept and nesting of any depth is a loop.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_of, quoted, tidy

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
#: What a tag holds up to its end, with quoted values whole; and up to the next ">" whatever the quotes.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LENIENT = re.compile(r"([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Fixed values of HTML: elements without content, with raw text, without rendering, with blocks of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist audio video canvas object".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
#: What is drawn within svg as text, each on a line of its own, and what of svg is never drawn by itself.
SVG_TEXT = frozenset("text foreignobject".split())
SVG_UNSEEN = frozenset("clippath defs desc marker mask metadata pattern symbol".split())
#: All that a head can hold; any other tag, or text, ends it and belongs to the body.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements with content of another language, in which "/>" makes an element empty; in these elements of that language, HTML goes on.
FOREIGN = frozenset("svg math".split())
INTEGRATION = frozenset("foreignobject desc mi mo mn ms mtext".split())
#: Tags that end foreign content where they stand in it.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: An opening tag ends these open elements, looked for up to the nearest of the second set.
_CELL = frozenset(("table",))
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "tr": (frozenset(("tr",)), _CELL),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption")), _CELL),
    "thead": (frozenset(("thead", "tbody", "tfoot", "caption")), _CELL),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "caption")), _CELL),
    "body": (frozenset(("head",)), frozenset()),
}
#: A block's opening tag ends an open paragraph, unless one of these stands between them.
SCOPE = frozenset("button table td th caption".split())


def _empty(rest: str) -> bool:
    """Whether a tag's "/>" closes it, and is no part of an unquoted value."""
    if not rest.endswith("/"):
        return False
    start = max(rest.rfind(c) for c in " \t\n\r\f\"'>") + 1
    return "=" not in rest[start:] and not rest[:start].rstrip().endswith("=")


def tokens(source: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("open", name, attributes) and ("close", name, {}); a raw element's text as it stands.

    An empty foreign element gives both tags, and so does foreign content that an HTML tag
    ends. What is no tag is text. A quote that is never closed would hold the rest of the page:
    from there on, tags end at the next ">" whatever their quotes. Every character is looked at
    a bounded number of times.
    """
    at = text_from = 0
    last, lenient = source.rfind(">"), False
    foreign: list[str] = []  # open svg and math, and the elements in them where HTML goes on
    while True:
        start = source.find("<", at)
        if start == -1 or start >= last and not source.startswith("<!--", start):
            yield "text", html.unescape(source[text_from:]), {}
            return
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            end = len(source) if end == -1 else end + 3
        elif source[start + 1 : start + 2] in ("!", "?"):
            end = source.find(">", start) + 1
        elif m := _NAME.match(source, start):
            tag = None if lenient else _REST.match(source, m.end())
            if not tag:
                lenient, tag = True, _LENIENT.match(source, m.end())
            end = tag.end()
        else:
            at = start + 1
            continue
        if start > text_from:
            yield "text", html.unescape(source[text_from:start]), {}
        at = text_from = end
        if source[start + 1] in "!?":
            continue
        ends, name, rest = bool(m[1]), m[2].lower(), tag[1]
        if foreign and (name == "p" if ends else name in BREAKOUT):
            while foreign and foreign[-1] in FOREIGN:
                yield "close", foreign.pop(), {}
        if ends:
            if name in foreign:
                del foreign[len(foreign) - 1 - foreign[::-1].index(name) :]
            yield "close", name, {}
            continue
        yield "open", name, {a.lower(): html.unescape(x or y or z) for a, x, y, z in _ATTRIBUTE.findall(rest)} if rest.strip(" /\n\t") else {}
        inside = bool(foreign) and foreign[-1] in FOREIGN
        if inside or name in FOREIGN:
            if _empty(rest):
                yield "close", name, {}
                continue
            if name in FOREIGN or name in INTEGRATION:
                foreign.append(name)
        if name in RAW:
            found = re.compile(rf"</(?:{name}{'|svg|math' if inside else ''})(?=[\s/>])", re.I).search(source, at)
            stop = found.start() if found else len(source)
            yield "text", html.unescape(source[at:stop]) if name in ("textarea", "title") else source[at:stop], {}
            at = text_from = stop


def _shown(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is laid out at all. aria-hidden is for readers of another kind: its text is on the page."""
    return not (name in UNSEEN or "hidden" in attributes or _NO_DISPLAY.search(attributes.get("style", "")) or name == "input" or name == "dialog" and "open" not in attributes)


class _Open:
    """The stack of open elements, and where in it each name stands."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # name, laid out, visible
        self.at: dict[str, list[int]] = defaultdict(list)
        self.hidden = 0

    def push(self, name: str, shown: bool, visible: bool) -> None:
        self.at[name].append(len(self.stack))
        self.stack.append((name, shown, visible))
        self.hidden += not shown

    def pop(self) -> tuple[str, bool, bool]:
        name, shown, visible = self.stack.pop()
        self.at[name].pop()
        self.hidden -= not shown
        return name, shown, visible

    def last(self, names: frozenset[str]) -> int:
        """Place of the innermost open element of these names, -1 if there is none."""
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    @property
    def visible(self) -> bool:
        return not self.stack or self.stack[-1][2]


_TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
_WALLS = frozenset("td th table".split())
_PASSES = frozenset("table tr tbody thead tfoot td th body html".split())


def parsed(source: str, shown: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """What a page shows, with implied tags: ("text", text, {}, True), ("open", name, attributes, seen) and ("close", name, {}, True).

    Nothing in an element that isn't laid out is given, and of the element itself only its
    opening tag, with seen False; elements named in shown always are. Text of an invisible
    element is left out but for that of visible ones in it. Elements without content aren't closed.
    """
    open_ = _Open()

    def pop_to(i: int) -> Iterator[tuple[str, str, dict[str, str], bool]]:
        while len(open_.stack) > i:
            name, laid_out, _ = open_.pop()
            if laid_out and not open_.hidden:
                yield "close", name, {}, True

    for kind, name, attributes in tokens(source):
        stack = open_.stack
        if kind != "close" and stack and stack[-1][0] == "head" and (name not in IN_HEAD if kind == "open" else name.strip(" \t\n\r\f")):
            yield from pop_to(len(stack) - 1)
        if kind == "text":
            if open_.hidden or not open_.visible or stack and stack[-1][0] in _TABLE_PARTS and not name.strip():
                continue
            if open_.at["svg"] and open_.at["svg"][-1] > open_.last(SVG_TEXT):
                continue  # characters beside the text elements of a drawing aren't drawn
            yield "text", name, {}, True
        elif kind == "open":
            ends, limit = CLOSES.get(name, (frozenset(), frozenset()))
            if (i := open_.last(ends)) > open_.last(limit):
                yield from pop_to(i)
            if name in BLOCKS and name not in ("html", "body") and open_.at["p"] and (i := open_.at["p"][-1]) > open_.last(SCOPE):
                yield from pop_to(i)
            if name in ("td", "th") and not open_.at["table"]:
                name = "span"  # a cell outside a table is plain text
            laid_out = name in shown or _shown(name, attributes) and not (name in SVG_UNSEEN and open_.at["svg"])
            said = _VISIBILITY.search(attributes.get("style", ""))
            visible = said[1].lower() == "visible" if said else open_.visible
            if not open_.hidden:
                yield "open", name, attributes, laid_out and (visible or name not in VOID)
            if name not in VOID:
                open_.push(name, laid_out, visible)
        else:
            if name == "p" and not open_.at["p"] and not open_.hidden:
                yield "open", "p", {}, True
                yield "close", "p", {}, True
            if open_.at[name] and (name in _PASSES or open_.at[name][-1] > open_.last(_WALLS)):
                yield from pop_to(open_.at[name][-1])
    yield from pop_to(0)


@dataclass
class _Flow:
    """Lines of one column of text: the page's, or a table cell's."""

    lines: deque[str] = field(default_factory=deque)
    now: list[str] = field(default_factory=list)
    gap: int = 0  # line ends owed before the next text
    space: bool = False
    size: int = 0  # characters of lines and their ends
    wide: int = 0  # of the longest line

    def text(self, s: str, lead: str) -> None:
        if not s:
            return
        if not self.now:
            if self.lines:
                self.lines.extend([""] * (self.gap - 1))
                self.size += max(0, self.gap - 1)
            self.gap = 0
            self.now.append(lead)
        self.now.append(s)

    def end(self, gap: int) -> None:
        if self.now:
            line = "".join(self.now).rstrip()
            self.lines.append(line)
            self.size, self.wide = self.size + len(line) + 1, max(self.wide, len(line))
            self.now = []
        self.gap, self.space = max(self.gap, gap), False

    def put(self, own: _Flow, indent: str) -> None:
        """Another flow's lines, after an ended line. The fewer are moved to the more, so tables in tables cost no more than their lines."""
        if not own.lines:
            return
        if indent:
            own.lines = deque((indent + x).rstrip() for x in own.lines)
        gap = [""] * (self.gap - 1) if self.lines else []
        if len(self.lines) < len(own.lines):
            own.lines.extendleft(reversed([*self.lines, *gap]))
            self.lines = own.lines
        else:
            self.lines.extend(gap)
            self.lines.extend(own.lines)
        self.size, self.wide = self.size + len(gap) + own.size + len(indent) * len(own.lines), max(self.wide, own.wide + len(indent))
        self.gap = 1

    def br(self) -> None:
        """Ends the line; after an ended one, an empty line."""
        if self.now:
            self.end(1)
        else:
            self.gap += 1


def _number(attributes: dict[str, str], name: str, most: int) -> int:
    value = attributes.get(name, "").strip()
    return min(max(1, int(value)), most) if re.fullmatch(r"[0-9]{1,9}", value) else 1


@dataclass
class _Table:
    """Cells by row: column, columns spanned, flow. Columns that cells of earlier rows still span are passed over."""

    rows: list[list[tuple[int, int, _Flow]]] = field(default_factory=list)
    busy: list[tuple[int, int, int]] = field(default_factory=list)  # column, columns and rows left, by column
    held: list[tuple[int, int, int]] = field(default_factory=list)  # the same of this row's cells, for the next row
    next: int = 0
    passed: int = 0
    span: tuple[int, int] = (1, 1)

    def row(self) -> None:
        if self.rows:
            self.busy = sorted((c, n, left - 1) for c, n, left in [*self.busy, *self.held] if left > 1)
        self.rows.append([])
        self.next = self.passed = 0
        self.held = []

    def cell(self, flow: _Flow) -> None:
        if not self.rows:
            self.row()
        wide, high = self.span
        while self.passed < len(self.busy) and self.busy[self.passed][0] < self.next + wide:
            self.next = max(self.next, sum(self.busy[self.passed][:2]))
            self.passed += 1
        self.rows[-1].append((self.next, wide, flow))
        self.next += wide
        if high > 1:
            self.held.append((self.rows[-1][-1][0], wide, high))

    def laid_out(self, room: _Room) -> _Flow:
        """Cells of a column start at the same place, two spaces after the widest of the one before.

        Cells wider than WRAP are broken at their spaces. If there isn't room for the spaces
        that this takes, or for laying out another table, cells follow one another instead,
        two spaces apart or each on its own line.
        """
        cells = [cell for r in self.rows for _, _, cell in r]
        alone = len(cells) == 1 and cells[0].wide <= WRAP
        out = _Flow()
        if alone or not room.lay_out(sum(cell.size for cell in cells)):
            for cell in cells:
                out.put(cell, "")
            return out
        rows = [[(c, n, [x for line in cell.lines for x in _broken(line)]) for c, n, cell in r] for r in self.rows]
        wide: dict[int, int] = {}
        for r in rows:
            for c, n, cell in r:
                if n == 1:
                    wide[c] = max([wide.get(c, 0), *map(len, cell)])
        for r in rows:
            for c, n, cell in r:
                if n > 1:
                    short = max(map(len, cell), default=0) - sum(wide.get(k, 0) for k in range(c, c + n)) - 2 * (n - 1)
                    if short > 0:
                        wide[c + n - 1] = wide.get(c + n - 1, 0) + short
        starts, at = {}, 0
        for c in range(max(wide, default=-1) + 1):
            starts[c] = at
            at += wide.get(c, 0) + 2
        for aligned in (True, False):
            lines, spaces = [], 0
            for r in rows:
                for k in range(max((len(cell) for _, _, cell in r), default=0)):
                    line: list[str] = []
                    long = 0
                    for c, _, cell in r:
                        if k < len(cell) and cell[k]:
                            gap = max(0, starts.get(c, 0) - long) if aligned else 2 if long else 0
                            spaces += gap
                            if spaces > room.spaces and aligned:
                                break
                            line.append(" " * gap + cell[k])
                            long += gap + len(cell[k])
                    lines.append("".join(line).rstrip())
            if spaces <= room.spaces:
                room.spaces -= spaces
                break
        return _Flow(deque(lines), size=sum(map(len, lines)) + len(lines), wide=max(map(len, lines), default=0))


#: Characters of a cell's line, where its words allow it.
WRAP = 200
#: A page renders to no more than so many spaces for alignment and indents, and tables within tables are laid out over no more characters, for each of its own characters and beside as many of a small page.
SPACES, LAID_OUT, SMALL = 20, 50, 1000


class _Room:
    """What is left of a page's spaces and of its tables' characters."""

    def __init__(self, page: int):
        self.spaces, self.characters = SPACES * (page + SMALL), LAID_OUT * (page + SMALL)

    def lay_out(self, characters: int) -> bool:
        self.characters -= characters
        return self.characters >= 0

    def indent(self, levels: int, lines: int = 1) -> str:
        fits = 2 * levels * lines <= self.spaces
        self.spaces -= 2 * levels * lines if fits else 0
        return "  " * levels if fits else ""


def _broken(line: str) -> list[str]:
    out = []
    while len(line) > WRAP:
        at = line.rfind(" ", 1, WRAP + 1)
        at = at if at > 0 else line.find(" ", WRAP)
        if at < 0:
            break
        out.append(line[:at].rstrip())
        line = line[at:].lstrip(" ")
    return [*out, line]


def _items(source: str) -> list[int]:
    """How many items each reversed list has, in the order in which these lists begin."""
    counts: list[int] = []
    lists: list[int | None] = []
    for kind, name, attributes, seen in parsed(source):
        if kind == "open" and seen and name in ("ul", "ol", "menu", "dir"):
            lists.append(len(counts) if name == "ol" and "reversed" in attributes else None)
            if lists[-1] is not None:
                counts.append(0)
        elif kind == "open" and seen and name == "li" and lists and lists[-1] is not None:
            counts[lists[-1]] += 1
        elif kind == "close" and name in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
    return counts


def _integer(value: str | None, other: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*[-+]?[0-9]{1,9}\s*", value) else other


def render(source: str) -> str:
    """All visible text: blocks on lines of their own, paragraphs and the like set apart by an empty line, list items marked and indented, table cells aligned."""
    flows, tables, lists = [_Flow()], [], []  # type: ignore[var-annotated]
    pre = 0
    mark = ""
    room = _Room(len(source))
    backwards = iter(_items(source) if "reversed" in source.lower() else [])

    def lead() -> str:
        nonlocal mark
        out = room.indent(max(0, len(lists) - 1)) + mark if mark else room.indent(len(lists))
        mark = ""
        return out

    def close(name: str) -> None:
        nonlocal pre, mark
        flow = flows[-1]
        if name == "pre":
            pre -= 1
        if name in ("td", "th") and len(flows) > 1 and tables:
            flow.end(1)
            flows.pop()
            tables[-1].cell(flow)
            return
        if name in ("td", "th"):
            flow.end(1)
        if name in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        if name == "li":
            mark = ""
        if name == "table" and tables:
            table = tables.pop()
            flow = flows[-1]
            flow.end(2)
            own = table.laid_out(room)
            flow.put(own, room.indent(len(lists), len(own.lines)))
        if name in BLOCKS or name == "text":
            flow.end(2 if name in SPACED and not (name in ("ul", "ol") and lists) else 1)

    for kind, name, attributes, seen in parsed(source):
        if kind == "text":
            flow = flows[-1]
            if pre:
                for n, part in enumerate(name.replace("\r\n", "\n").split("\n")):
                    if n:
                        if not flow.now:
                            flow.text(" ", "")
                        flow.end(1)
                    flow.text(part, lead() if not flow.now else "")
                continue
            collapsed = _SPACE.sub(" ", name)
            body = collapsed.strip(" ")
            if not body:
                flow.space |= bool(flow.now) and bool(collapsed)
                continue
            if flow.now and (flow.space or collapsed[0] == " "):
                flow.text(" ", "")
            flow.text(body, "" if flow.now else lead())
            flow.space = collapsed[-1] == " "
        elif kind == "open":
            if name == "br":
                flows[-1].br()
            if name == "img" and seen and attributes.get("alt"):
                flow = flows[-1]
                if flow.now and flow.space:
                    flow.text(" ", "")
                flow.text(_SPACE.sub(" ", attributes["alt"]), "" if flow.now else lead())
                flow.space = False
            if name in VOID:
                if name == "hr":
                    flows[-1].end(2)
                continue
            if not seen:
                continue
            if name in BLOCKS or name == "text":
                flows[-1].end(2 if name in SPACED and not (name in ("ul", "ol") and lists) else 1)
            if name in ("ul", "ol", "menu", "dir"):
                back = name == "ol" and "reversed" in attributes
                first = next(backwards, 1) if back else 1  # taken even where the list says where it starts
                lists.append([name, _integer(attributes.get("start"), first), -1 if back else 1])
            elif name == "li":
                if lists and lists[-1][0] == "ol":
                    number = _integer(attributes.get("value"), lists[-1][1])
                    mark = f"{number}. "
                    lists[-1][1] = number + lists[-1][2]
                else:
                    mark = "- "
            elif name == "pre":
                pre += 1
            elif name == "table":
                tables.append(_Table())
            elif name == "tr" and tables:
                tables[-1].row()
            elif name in ("td", "th") and tables:
                tables[-1].span = (_number(attributes, "colspan", 1000), _number(attributes, "rowspan", 65534))
                flows.append(_Flow())
        else:
            close(name)
    flows[0].end(1)
    return "\n".join(flows[0].lines)


#: Characters of rendered pages that leave a task together, more only where one page has more.
TOGETHER = 4_000_000


def render_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text (the page's visible text) of every row.

    Null HTML gives null text, empty HTML an empty one; repeated rows and null ids give a row
    each; an empty table gives none. Ids must be whole numbers. Pages of any length count
    whole, in time that follows their length. No text is cut: cells wider than WRAP are broken
    at spaces, and where alignment and indents would take more than SPACES times a page's
    length, or tables within tables more than LAID_OUT times, what follows isn't aligned or
    indented any more. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str | None] = []
            first = size = 0
            for i, x in enumerate(b.column(1)):  # one page at a time
                out.append(None if not x.is_valid else render(x.as_py()))
                size += len(out[-1] or "")
                if size >= TOGETHER or i == len(b) - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(out)), pa.array(out, pa.string())], names=["page_id", "text"])
                    out, first, size = [], i + 1, 0

    return pages.select(id_of(pages, id_col).alias("page_id"), quoted(html_col).cast("string").alias("html")).mapInArrow(tidy(run), "page_id long, text string")


#: An item of a sequence: text, or a medium by what its source says.
ITEM = T.StructType([T.StructField("position", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType())])


def interleaved(source: str) -> list[dict]:
    """Text and media references in order; a figure's caption goes with each of its own media instead of the text.

    A figure within another one has its own media and caption. A caption outside a figure, or
    of a figure without media, is text.
    """
    out: list[dict] = []
    words: list[str] = []
    figures: list[tuple[list[int], list[str]]] = []  # media and caption of each open figure
    captions: list[int] = []  # figures whose captions are open

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(words)).strip(" ")
        words.clear()
        if text:
            out.append({"position": len(out), "kind": "text", "text": text, "ref": None, "caption": None})

    def say(part: str) -> None:
        (figures[captions[-1]][1] if captions else words).append(part)

    for kind, name, attributes, seen in parsed(source, frozenset(("audio", "video"))):
        if kind == "text":
            say(name)
        elif kind == "open":
            if name in ("img", "video", "audio", "source") and attributes.get("src"):
                flush()
                if figures:
                    figures[-1][0].append(len(out))
                out.append({"position": len(out), "kind": "image" if name == "img" else "media", "text": None, "ref": attributes["src"], "caption": attributes.get("alt")})
            elif not seen:
                continue
            elif name == "figure":
                figures.append(([], []))
            elif name == "figcaption":
                if figures:
                    captions.append(len(figures) - 1)
            elif name in BLOCKS or name in ("br", "td", "th"):
                say(" ")
        elif name == "figcaption":
            if captions:
                captions.pop()
        elif name == "figure" and figures:
            media, said = figures.pop()
            captions = [c for c in captions if c < len(figures)]
            said = _SPACE.sub(" ", "".join(said)).strip(" ")
            if said and not media:
                say(f" {said} ")
            for i in media if said else []:
                out[i]["caption"] = said
        elif name in BLOCKS or name in ("td", "th"):
            say(" ")
    flush()
    return out
