"""Visible text of web pages, laid out as blocks, lists and aligned tables.

A tokenizer cuts the page into tags and text. A tree builder keeps the stack of
open elements and supplies the tags that authors leave out: it closes what a new
tag can't stand in, and closes what a closing tag leaves open. Visibility is an
element's own (kind, attributes, inline style, and the rules of the page's style
sheets that apply to a screen, the last of the most specific first) or its
parent's. A renderer follows the elements as they open and
close, so the tree itself is never held: inline text is joined and its white
space collapsed, blocks stand on lines of their own, with an empty line where
they have a margin, list items get their marks and indents, preformatted text
stays as it is, and a table's cells are aligned once the table ends.

All is iterative; depth of nesting costs no stack.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import by_bytes, in_arrow, renamed, whole_texts

# Names of HTML elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist annotation annotation-xml mphantom area base link meta param source track col colgroup".split())
#: Hidden inside svg, where only the text of these is drawn.
UNDRAWN, DRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc".split()), frozenset(["text", "foreignobject"])
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary ul xmp listing plaintext option optgroup".split())
MARGIN = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre ul dir menu xmp listing plaintext".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
KEPT_SPACE = frozenset("pre xmp listing plaintext textarea".split())
ENDS_P = BLOCK - frozenset("body html li dd dt option optgroup".split()) | frozenset(["table"])
# what a new tag closes, and what keeps the search for it inside
CLOSES = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "caption": ("caption colgroup", "table"),
    "rt": ("rt rp", "ruby"),
    "rp": ("rt rp", "ruby"),
    "body": ("head", "html"),
} | {h: ("h1 h2 h3 h4 h5 h6", "div section article td th li blockquote body html") for h in ("h1", "h2", "h3", "h4", "h5", "h6")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: A closing tag doesn't look past these for what it closes.
WALLS = frozenset("td th caption table html body template".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())

# possessive throughout: a tag or quote that never ends takes the rest of the page, in one scan
LISTED = re.compile(r"<(/?)(li|ol|ul|menu|dir)(?=[\s/>])", re.IGNORECASE)
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+|["'])*+)(>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
#: What the parser takes whole where a style sheet can't start, and style sheets.
SHEET = re.compile(r"<!--.*?(?:-->|\Z)|<(script|noscript|template|textarea|title|xmp|iframe)(?=[\s/>]).*?(?:</\1|\Z)|<style(?=[\s/>])([^>]*+)>(.*?)(?:</style|\Z)", re.DOTALL | re.IGNORECASE)
CSS_TOKEN = re.compile(r""""(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?|[{};]""", re.DOTALL)
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?\s*(?=;|\Z)", re.IGNORECASE)
DISPLAYS = frozenset("none block inline inline-block flex inline-flex grid inline-grid table inline-table list-item contents flow-root flow run-in ruby initial unset revert revert-layer table-row table-cell table-caption table-row-group table-header-group table-footer-group table-column table-column-group -webkit-box -webkit-flex -ms-flexbox".split())
VISIBLE = {"visible": True, "initial": True, "hidden": False, "collapse": False, "inherit": None, "unset": None, "revert": None}
COMPOUND = re.compile(r"""(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:"[^"]*"|'[^']*'|[\w-]+)\s*)?\])*)\Z""")
MARK = re.compile(r"""([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*)?\]""")
STEP = re.compile(r"""(?:\[[^\]]*\]|[^\s>\[])+|>""")
#: The screen that conditions of style sheets are asked for, in pixels.
SCREEN = 1280
#: Character references of more digits than any character has.
DIGITS = re.compile(r"&#(?:[0-9]{10,}|[xX][0-9a-fA-F]{10,})")


def unescaped(s: str) -> str:
    """Text with its character references read, however many digits they have."""
    return unescape(DIGITS.sub(_clamped, s)) if "&" in s else s


def _clamped(m: re.Match) -> str:
    x = "x" if m[0][2] in "xX" else ""
    digits = m[0][2 + len(x) :].lstrip("0") or "0"
    return f"&#{x}{digits}" if len(digits) < 10 else "&#x110000" if x else "&#1114112"


def number(s: str, least: int, most: int, otherwise: int) -> int:
    """A whole number of an attribute inside bounds, however many digits it has."""
    m = re.match(r"[ \t\n\r\f]*+([+-]?)0*+([0-9]++)", s) or re.match(r"[ \t\n\r\f]*+([+-]?)(0)", s)
    if m is None:
        return otherwise
    value = int(m[2]) if len(m[2]) <= 9 else 10**9
    return max(least, min(most, -value if m[1] == "-" else value))


class Flow:
    """Lines of one container: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indents: list[str] = []
        self.mark = ""
        self.space = False  # collapsed white space waits for text after it
        self.gap = 0  # empty lines due before the next line

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        if not words:
            return
        if words == " ":
            self.space = self.space or bool(self.parts)
            return
        if self.parts and (self.space or words[0] == " "):
            self.parts.append(" ")
        self.space = words[-1] == " "
        self.parts.append(words.strip(" "))

    def plain(self, s: str) -> None:
        """Text whose white space stays."""
        first, *rest = s.replace("\r\n", "\n").split("\n")
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = False
        self.parts.append(first)
        for line in rest:
            self.end(True)
            self.parts.append(line)

    def end(self, always: bool = False) -> None:
        """End the line, if there is anything on it or always."""
        self.space = False
        line = "".join(self.parts).rstrip()
        self.parts = []
        if line or self.mark and always is None:
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append("".join(self.indents) + self.mark + line)
            if self.mark:
                self.indents[-1:] = [" " * (len(self.indents[-1]) + len(self.mark))] if self.indents else []
                self.mark = ""
        elif always and self.lines and not self.gap:
            self.lines.append("")

    def block(self, margin: bool) -> None:
        self.end()
        if margin and self.lines and not self.mark:
            self.gap = 1

    def whole(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Grid:
    """A table's cells."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []  # lines, columns and rows of each cell
        self.caption: list[str] = []

    def placed(self) -> list[list[tuple[int, list[str], int]]]:
        """Rows of (column, lines, columns): a cell stands right of those that reach down from rows above."""
        out = []
        reach: list[tuple[int, int, int]] = []  # columns from and to, and rows still covered
        for row in self.rows:
            at, cells, busy, k = 0, [], sorted(reach), 0
            for cell, span, down in row:
                while k < len(busy) and busy[k][0] < at + span:
                    at = max(at, busy[k][1])
                    k += 1
                cells.append((at, cell, span))
                if down > 1:
                    reach.append((at, at + span, down))
                at += span
            reach = [(a, b, n - 1) for a, b, n in reach if n > 1]
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        """Rows with their cells aligned at the left, two spaces between columns."""
        widths: dict[int, int] = {}
        rows = self.placed()
        for row in rows:
            for at, cell, span in row:
                if span == 1 and cell:
                    widths[at] = max(widths.get(at, 0), max(map(len, cell)))
        columns = sorted(widths)
        starts, end = {}, 0  # where each column's text starts; columns of no width take no place
        for c in columns:
            starts[c] = end
            end += widths[c] + 2
        out = list(self.caption)
        for row in rows:
            for k in range(max((len(c) for _, c, _ in row), default=0)):
                line = ""
                for at, cell, _ in row:
                    if k < len(cell) and cell[k]:
                        own = bisect_left(columns, at)
                        to = starts[columns[own]] if own < len(columns) else end
                        line = line.ljust(to) if len(line) + 2 <= to or not line else line + "  "
                        line += cell[k]
                out.append(line.rstrip())
        return out


def on_screen(query: str) -> bool:
    """Whether a list of media queries holds for a wide screen; what isn't known doesn't hold."""

    def feature(f: str) -> bool | None:
        name, _, value = (x.strip() for x in f.partition(":"))
        if name in ("min-width", "max-width") and (m := re.fullmatch(r"(\d*\.?\d+)(px|em|rem)", value)):
            width = float(m[1]) * (1 if m[2] == "px" else 16)
            return width <= SCREEN if name == "min-width" else width >= SCREEN
        if name in ("orientation", "hover", "any-hover", "pointer", "any-pointer", "prefers-color-scheme", "prefers-reduced-motion"):
            return value in ("", "landscape", "hover", "fine", "light", "no-preference")
        return None

    for q in re.sub(r"/\*.*?\*/", " ", query.lower(), flags=re.DOTALL).split(","):
        m = re.fullmatch(r"\s*(?:(not|only)\s+)?([a-z-]+)?((?:\s*(?:and\s*)?\([^()]*\))*)\s*", q)
        if m is None:
            continue
        asked = [feature(f) for f in re.findall(r"\(([^()]*)\)", m[3])]
        if None not in asked and (m[2] in (None, "all", "screen") and all(asked)) != (m[1] == "not"):
            return True
    return False


def declared(body: str) -> dict[str, tuple[bool, bool | None]]:
    """(important, shown) of display and visibility; shown is None where the parent's holds."""
    out: dict[str, tuple[bool, bool | None]] = {}
    for name, value, important in DECLARED.findall(body):
        name, value, important = name.lower(), value.lower(), bool(important)
        if name == "display":
            if value not in DISPLAYS and value != "inherit":
                continue
            shown = value != "none"
        elif value in VISIBLE:
            shown = VISIBLE[value]
        else:
            continue
        if important or not out.get(name, (False,))[0]:
            out[name] = (important, shown)
    return out


def rules_of(sheet: str) -> Iterator[tuple[str, dict]]:
    """(selectors, declared) of a style sheet's rules that apply to a screen, in their order."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", sheet, flags=re.DOTALL)
    held: list[tuple[bool, str | None, list[str]]] = [(True, None, [])]  # applies, selectors, declarations
    at = 0
    for m in [*CSS_TOKEN.finditer(sheet), None]:
        token = m[0] if m else "}"
        if token not in "{};":
            continue
        before, at = sheet[at : m.start() if m else len(sheet)], m.end() if m else len(sheet)
        applies, selectors, body = held[-1]
        if token == "{":
            head = before.strip()
            if head.startswith("@"):
                kind, _, condition = head[1:].partition(" ")
                if "(" in kind:
                    kind, _, condition = head[1:].partition("(")
                    condition = "(" + condition
                kind = kind.lower()
                applies = applies and selectors is None and (kind == "layer" or kind == "media" and on_screen(condition) or kind == "supports" and not condition.strip().lower().startswith("not"))
                held.append((applies, None, []))
            else:
                held.append((applies and selectors is None, head, []))
        elif token == ";":
            body.append(before)
        else:
            if selectors is not None and applies and (found := declared(";".join([*body, before]))):
                yield selectors, found
            if len(held) > 1:
                held.pop()


class Rules:
    """The rules for display and visibility of a page's style sheets, by what their compounds ask for."""

    def __init__(self, page: str):
        self.declared: list[tuple[tuple, dict]] = []  # specificity and order, what is declared
        self.last: list[int] = []
        self.by: dict[tuple[str, str], list[tuple]] = {}
        for m in SHEET.finditer(page):
            if m[3] is None or not re.search("display|visibility", m[3], re.IGNORECASE):
                continue
            media = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(m[2])}.get("media", "")
            if media and not on_screen(unescaped(media)):
                continue
            for selectors, found in rules_of(m[3]):
                for selector in selectors.split(","):
                    self.add(selector, found)

    def add(self, selector: str, found: dict) -> None:
        steps, child, compounds = STEP.findall(selector), False, []
        for step in steps:
            if step == ">":
                child = True
                continue
            m = COMPOUND.match(step)
            if m is None:
                return  # siblings and pseudo classes
            marks = MARK.findall(m[2])
            element = "" if m[1] in (None, "*") else m[1].lower()
            compounds.append((child, element, frozenset(n for c, n, *_ in marks if c == "."), frozenset(n for c, n, *_ in marks if c == "#"), tuple((a.lower(), (x or y or z) if "=" in m[2] and (x or y or z) else None) for _, _, a, x, y, z in marks if a)))
            child = False
        if compounds and len(compounds) > 1 and not compounds[1][0] and compounds[0][1] in ("html", "body") and not any(compounds[0][2:]):
            compounds = compounds[1:]  # the page may leave them out
        if not compounds or child:
            return
        r = len(self.declared)
        weight = (sum(len(c[3]) for c in compounds), sum(len(c[2]) + len(c[4]) for c in compounds), sum(bool(c[1]) for c in compounds))
        self.declared.append(((weight, r), found))
        self.last.append(len(compounds) - 1)
        for k, (direct, element, classes, ids, attributes) in enumerate(compounds):
            key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", element)
            self.by.setdefault(key, []).append((r, k, direct, element, classes, ids, attributes))

    def match(self, name: str, attributes: dict[str, str], above: tuple[frozenset, frozenset]) -> frozenset:
        """(rule, compound) that end at an element; above: those of its parent, and of it and all its ancestors."""
        classes, own = frozenset(attributes.get("class", "").split()), attributes.get("id", "")
        found = []
        for key in (("", ""), ("", name), ("#", own), *((".", c) for c in classes)):
            for r, k, direct, element, needs, ids, asked in self.by.get(key, ()):
                if (not element or element == name) and needs <= classes and (not ids or ids == {own}) and (not k or (r, k - 1) in above[0 if direct else 1]) and all(a in attributes and (v is None or attributes[a] == v) for a, v in asked):
                    found.append((r, k))
        return frozenset(found)


class Page:
    """Builds the elements of one page and renders them."""

    def __init__(self, page: str) -> None:
        self.rules = Rules(page) if re.search("<style", page, re.IGNORECASE) else None
        if self.rules and not self.rules.declared:
            self.rules = None
        self.open: list[tuple[str, bool, bool, bool, tuple]] = []  # name, displayed, visible, text is drawn, rules matched
        self.at = 0  # behind the tag
        self.options: list[int] = []  # of the open selects: options until the one shown, or -1 for all
        self.flows = [Flow()]
        self.grids: list[Grid] = []
        self.lists: list[list] = []  # [next number or None, step]
        self.kept = 0  # open elements that keep white space
        self.count: dict[str, int] = {}  # open elements by name
        self.depths: dict[str, list[int]] = {}  # and where they are among the open ones
        self.closed: list[int] = []  # depths of details elements that show their summary only
        self.page = page
        self.counted: dict[int, int] | None = None

    def visible(self) -> bool:
        return not self.open or all(self.open[-1][1:4])

    def state(self, name: str, attributes: dict[str, str]) -> tuple[bool, bool, bool, tuple]:
        """(displayed, visible, text is drawn, rules matched) of a new element."""
        _, displayed, visible, drawn, above = self.open[-1] if self.open else ("", True, True, True, (frozenset(), frozenset()))
        best: dict[str, tuple] = {}
        if self.rules:
            own = self.rules.match(name, attributes, above)
            above = (own, above[1] if own <= above[1] else above[1] | own)
            for r, k in own:
                if k == self.rules.last[r]:
                    order, found = self.rules.declared[r]
                    for what, (important, shown) in found.items():
                        best[what] = max(best.get(what, ()), (important, False, order, shown))
        if "style" in attributes:
            for what, (important, shown) in declared(re.sub(r"/\*.*?\*/", " ", attributes["style"])).items():
                best[what] = max(best.get(what, ()), (important, True, (), shown))
        if "visibility" in best and best["visibility"][3] is not None:
            visible = best["visibility"][3]
        if "display" in best:
            displayed = displayed and best["display"][3]
        elif "hidden" in attributes or name == "dialog" and "open" not in attributes:
            displayed = False
        if name in HIDDEN or self.in_closed() and name != "summary" or self.count.get("svg", 0) and name in UNDRAWN:
            displayed = False
        if name in ("svg", "select"):
            drawn = False
        elif name in DRAWN and self.count.get("svg", 0):
            drawn = True
        elif name == "option" and self.count.get("select", 0) and self.options:
            drawn = self.options[-1] <= 0
            if self.options[-1] >= 0:
                self.options[-1] = self.options[-1] - 1 if self.options[-1] else 1 << 60
        return displayed, visible, drawn, above

    def chosen(self, attributes: dict[str, str]) -> int:
        """How many options of the select that starts here stand before the one it shows; -1 if it shows all."""
        if "multiple" in attributes or number(attributes.get("size", ""), 0, 2, 0) > 1:
            return -1
        stop = re.compile(r"</?select(?=[\s/>])", re.IGNORECASE).search(self.page, self.at)
        first, last, n = None, None, 0
        for m in TOKEN.finditer(self.page, self.at, stop.start() if stop else len(self.page)):
            if m[2] and not m[1] and m[2].lower() == "option":
                asked = {a.lower() for a, *_ in ATTRIBUTE.findall(m[3])}
                if "selected" in asked:
                    last = n
                if first is None and "disabled" not in asked:
                    first = n
                n += 1
        return last if last is not None else first or 0

    def items(self) -> int:
        """How many items the list that starts here has, up to its end and without those of lists in it."""
        if self.counted is None:
            self.counted, stack = {}, []
            for m in LISTED.finditer(self.page):
                if m[2].lower() == "li":
                    if stack and not m[1]:
                        stack[-1][1] += 1
                elif not m[1]:
                    stack.append([m.start(), 0])
                elif stack:
                    at, n = stack.pop()
                    self.counted[at] = n
            self.counted.update(stack)
        return self.counted.get(self.page.rfind("<", 0, self.at), 0)

    def in_closed(self) -> bool:
        return bool(self.closed) and self.closed[-1] == len(self.open)

    def pop(self) -> None:
        if self.in_closed():
            self.closed.pop()
        name, displayed, visible, drawn, _ = self.open.pop()
        self.count[name] -= 1
        self.depths[name].pop()
        if name == "select" and self.options:
            self.options.pop()
        if name in KEPT_SPACE:
            self.kept -= 1
        if not displayed:
            return
        flow = self.flows[-1]
        if name == "text" and self.count.get("svg", 0):
            flow.block(False)
        elif name == "option" and not drawn:
            return
        elif name in TABLE:
            if name in ("td", "th", "caption") and len(self.flows) > 1:
                lines = self.flows.pop().whole()
                if name == "caption":
                    self.grids[-1].caption = lines
                else:
                    self.grids[-1].rows[-1][-1] = (lines, *self.grids[-1].rows[-1][-1][1:])
            elif name == "table" and self.grids:
                lines = self.grids.pop().lines()
                flow.block(True)
                for line in lines:
                    flow.parts = [line]
                    flow.end()
                flow.block(True)
        elif name in BLOCK:
            if name == "li":
                flow.end(None if visible else False)
                flow.mark = ""
                flow.indents and flow.indents.pop()
            elif name in ("blockquote", "dd"):
                flow.end()
                flow.indents and flow.indents.pop()
            if name in ("ul", "ol", "menu", "dir") and self.lists:
                self.lists.pop()
            flow.block(name in MARGIN and not (name in ("ul", "ol", "menu", "dir") and self.lists))

    def close_down_to(self, names: frozenset, wall: frozenset) -> None:
        """Close the outermost open element of names that stands inside the nearest wall, and all in it."""
        # only the open elements of these names are looked at, so that deep nesting of others costs nothing
        stop = max((self.depths[n][-1] for n in wall if n not in names and self.depths.get(n)), default=-1)
        firsts = ((self.depths[n], bisect_left(self.depths[n], stop + 1)) for n in names if self.depths.get(n))
        to = min((d[k] for d, k in firsts if k < len(d)), default=-1)
        while to >= 0 and len(self.open) > to:
            self.pop()

    def some_open(self, names: frozenset) -> bool:
        return any(self.count.get(n, 0) for n in names)

    def start(self, name: str, raw: str) -> None:
        if name == "html":
            return
        if name == "body" and self.count.get("body", 0):
            return
        if self.count.get("head", 0) and name not in IN_HEAD and name != "head":
            self.close_down_to(frozenset(["head"]), frozenset())
        if name in ENDS_P and self.count.get("p", 0):
            self.close_down_to(frozenset(["p"]), WALLS | frozenset(["button", "object"]))
        if name in CLOSES:
            names, wall = CLOSES[name]
            if self.some_open(names):
                self.close_down_to(names, wall)
        if name in ("select", "input", "textarea") and self.count.get("select", 0):
            self.close_down_to(frozenset(["select"]), WALLS)
            if name == "select":
                return
        # a cell needs a row, a row needs a table
        if name in ("td", "th") and not (self.open and self.open[-1][0] == "tr"):
            if not self.count.get("table", 0):
                name = "div"
            else:
                self.start("tr", "")
        if name in ("tr", "thead", "tbody", "tfoot", "caption") and not self.count.get("table", 0):
            name = "div"
        attributes = {a.lower(): unescaped(b or c or d) for a, b, c, d in ATTRIBUTE.findall(raw)} if raw else {}
        displayed, visible, drawn, above = self.state(name, attributes)
        if name in VOID:
            if displayed and visible and drawn:
                flow = self.flows[-1]
                if name == "br":
                    flow.end(True)
                elif name == "hr":
                    flow.block(True)
            return
        self.depths.setdefault(name, []).append(len(self.open))
        self.open.append((name, displayed, visible, drawn, above))
        if name == "select":
            self.options.append(self.chosen(attributes))
        self.count[name] = self.count.get(name, 0) + 1
        if name in KEPT_SPACE:
            self.kept += 1
        if name == "details" and "open" not in attributes:
            self.closed.append(len(self.open))
        if displayed:
            self.opened(name, attributes)

    def opened(self, name: str, attributes: dict[str, str]) -> None:
        flow = self.flows[-1]
        if name == "text" and self.count.get("svg", 0):
            flow.block(False)
        elif name == "option" and not self.open[-1][3]:
            return
        elif name in TABLE:
            if name == "table":
                flow.block(True)
                self.grids.append(Grid())
            elif name == "tr":
                self.grids[-1].rows.append([])
            elif name in ("td", "th"):
                if not self.grids[-1].rows:
                    self.grids[-1].rows.append([])
                self.grids[-1].rows[-1].append(([], number(attributes.get("colspan", ""), 1, 1000, 1), number(attributes.get("rowspan", ""), 0, 65534, 1) or 65534))
                self.flows.append(Flow())
            elif name == "caption":
                self.flows.append(Flow())
        elif name in BLOCK:
            flow.block(name in MARGIN and not (name in ("ul", "ol", "menu", "dir") and self.lists))
            if name in ("ul", "ol", "menu", "dir"):
                back = "reversed" in attributes
                first = number(attributes["start"], -(10**9), 10**9, 1) if "start" in attributes else self.items() if back and name == "ol" else 1
                self.lists.append([first if name == "ol" else None, -1 if back else 1])
            elif name == "li":
                own = self.lists[-1] if self.lists else [None, 1]
                if own[0] is not None and "value" in attributes:
                    own[0] = number(attributes["value"], -(10**9), 10**9, own[0])
                flow.mark = "" if not self.visible() else "- " if own[0] is None else f"{own[0]}. "
                if own[0] is not None:
                    own[0] += own[1]
                flow.indents.append("")
            elif name in ("blockquote", "dd"):
                flow.indents.append("  ")

    def end(self, name: str) -> None:
        if name == "p" and not self.count.get("p", 0):
            self.start("p", "")
        if name in ("html", "body") or not self.count.get(name, 0):
            return
        wall = WALLS - {name} if name in TABLE else WALLS
        if name in ("tr", "thead", "tbody", "tfoot", "table"):
            wall = frozenset(["table"]) - {name}
        to = self.depths[name][-1]
        if to > max((self.depths[n][-1] for n in wall if n != name and self.depths.get(n)), default=-1):
            while len(self.open) > to:
                self.pop()

    def words(self, s: str) -> None:
        if self.in_closed():
            return
        if not self.visible():
            if not (self.count.get("head", 0) and self.open[-1][0] == "head" and s.strip()):
                return
            self.close_down_to(frozenset(["head"]), frozenset())
        if self.open and self.open[-1][0] in ("table", "thead", "tbody", "tfoot", "tr"):
            if not s.strip():
                return
            # text that stands in no cell is set before the table
        s = unescaped(s)
        s = s.replace("\xa0", " ") if not self.kept else s
        if self.kept:
            self.flows[-1].plain(s)
        else:
            self.flows[-1].text(s)

    def render(self) -> str:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            m = TOKEN.search(page, at)
            if m is None:
                self.words(page[at:])
                break
            if m.start() > at:
                self.words(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if not m[4]:
                break  # the page ends inside a tag
            if m[1]:
                self.end(name)
                continue
            self.at = at
            self.start(name, m[3].rstrip("/").strip())
            if m[3].endswith("/") and (name in ("svg", "math") or self.count.get("svg", 0) or self.count.get("math", 0)) and self.open and self.open[-1][0] == name:
                self.end(name)  # such elements may be empty by their own tag
                continue
            if name in RAW and self.open and self.open[-1][0] == name:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                self.words(page[at : stop.start() if stop else n])
                at = stop.end() if stop else n
                self.end(name)
        while self.open:
            self.pop()
        return "\n".join(self.flows[0].whole())


def render(page: str) -> str:
    """The visible text of a page; an empty page has none."""
    return Page(page.replace("\x00", "")).render() if page else ""


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "html"):
        texts = [render(p) for p in whole_texts(batch, "html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars) for every row of pages (page_id, html).

    A null or empty page has the empty text. Pages are rendered alone, so null
    or repeated ids and rows are as any other. Pages of any length are rendered whole; columns other than
    those named are ignored, whatever their names. An empty table gives no rows.
    """
    rows = renamed(pages, "page_id", "html").select(F.col("page_id").cast("long").alias("page_id"), "html")
    return in_arrow(rows, _rendered, "page_id long, text string, n_chars long")
