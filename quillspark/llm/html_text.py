"""HTML extraction by layout-aware rendering: all visible text, with block spacing, lists and aligned table cells.

A page is built into a tree in which implied tags are closed and opened (paragraphs before blocks, list items, table rows
and cells, the end of the head), and the tree is rendered with rules for visibility: what scripts, heads, templates,
closed details and fallbacks hold isn't shown, nor what the hidden attribute, an inline style, or a simple rule of the page's own
style sheet hides. Both passes are loops; open elements are found by their tag, style rules by what they select, and tables are
held as their cells, so time and memory grow with a page's length, not with its depth or the width that it claims. Tables wider
than WIDEST aren't aligned, and indents stop growing after DEEPEST levels; both keep all their text.

Defined results: null and empty pages give empty text; very long pages are read whole; broken markup is text or closed at the
end; of equally specific style rules the last holds; repeated rows each get their row; input columns named like a result give
way to it; empty tables give an empty result.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, lean, with_results

# Elements of HTML by their part in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript datalist iframe canvas video audio object defs desc metadata area base link meta param source track col colgroup rp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption tr td th thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu dir hr".split())
CLOSES_P = BLOCK - frozenset("body html td th tr thead tbody tfoot caption option optgroup legend".split())
#: Start tags that end an open element, and what keeps them from looking further out.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
_SCOPE = frozenset("table td th caption button object template html".split())
#: Characters to a line of an aligned table, and levels of indents, at most.
WIDEST, DEEPEST = 1000, 32
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"^([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?$", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    """The tree of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag
        self.sheets: list[str] = []
        self._push(self.root)

    def _push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.open))
        self.open.append(element)

    def _cut(self, at: int) -> None:
        """Closes the open elements from a place on."""
        for e in self.open[at:]:
            self.places[e.tag].pop()
        del self.open[at:]

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of tags, 0 without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Closes the outermost open element of tags inside the innermost one of stop."""
        edge, found = self._last(stop), []
        for t in tags:
            p = self.places.get(t, [])
            if (i := bisect.bisect_right(p, edge)) < len(p):
                found.append(p[i])
        if found:
            self._cut(min(found))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.places.get(tag):
            found = self.open[self.places[tag][0]]
            found.attrs = {k: v or "" for k, v in attrs} | found.attrs
            return
        if self.open[-1].tag == "head" and tag not in HEAD:
            self._cut(len(self.open) - 1)
        if tag in CLOSES_P:
            self._close({"p"}, _SCOPE)
        if tag in ENDS:
            self._close(*ENDS[tag])
            if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
                self.handle_starttag("tr", [])
        if tag[0] == "h" and tag[1:].isdigit() and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:].isdigit():
            self._cut(len(self.open) - 1)
        new = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(new)
        if tag not in VOID:
            self._push(new)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Element("br", {}))
            return
        if tag == "p" and not self.places.get("p"):
            self.open[-1].children.append(Element("p", {}))
            return
        stop = {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else set() if tag in ("table", "html", "body") else {"td", "th", "caption"}
        at = self._last({tag})
        if at and at >= self._last(stop):
            self._cut(at)

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.tag == "style":
            self.sheets.append(data)
        if top.tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


class Writer:
    """Lines of text: runs collapse white space, blocks start lines, spaced blocks stand off by an empty line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.space = False
        self.indent: list[str] = []
        self.marker: str | None = None

    def text(self, data: str) -> None:
        flat = _SPACE.sub(" ", data)
        if flat == " " or not flat:
            self.space = self.space or bool(flat)
            return
        if flat[0] == " " or self.space:
            flat = " " + flat.lstrip(" ") if self.parts else flat.lstrip(" ")
        self.space = flat[-1] == " "
        self.parts.append(flat.rstrip(" "))

    def flush(self) -> None:
        if self.parts:
            self.line("".join(self.parts))
        self.parts, self.space = [], False

    def line(self, text: str) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        lead = "".join(self.indent[:DEEPEST])
        if self.marker is not None:
            lead = "".join(self.indent[:-1][:DEEPEST]) + self.marker
            self.marker = None
        self.lines.append((lead + text).rstrip())
        self.gap = 0

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def result(self) -> str:
        self.flush()
        return "\n".join(self.lines)


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


def _span(value: str, most: int, least: int = 1) -> int:
    return min(max(int(value), least), most) if value.isascii() and value.isdigit() and len(value) < 8 else 1


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, list[str]]]]:
    """(column, lines) of the cells (text, columns, rows; 0 for all that follow) of each row. Columns that cells of earlier
    rows reach into are held as ranges."""
    out = []
    held: list[tuple[int, int, int]] = []  # (first column, end, row from which they are free)
    for r, row in enumerate(rows):
        held = [h for h in held if h[2] > r]
        cells, new, at, i = [], [], 0, 0
        for text, across, tall in row:
            while i < len(held) and held[i][0] <= at:
                at, i = max(at, held[i][1]), i + 1
            cells.append((at, text.split("\n")))
            until = len(rows) if tall == 0 else min(len(rows), r + tall)
            if until > r + 1:
                new.append((at, at + across, until))
            at += across
        out.append(cells)
        if new:
            merged: list[tuple[int, int, int]] = []
            for h in sorted([*held, *new]):
                if merged and merged[-1][1] >= h[0] and merged[-1][2] == h[2]:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], h[1]), h[2])
                else:
                    merged.append(h)
            held = merged
    return out


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """The lines of a table: columns padded to their widest line, two spaces apart; spanned places stay empty."""
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for row in placed:
        for column, lines in row:
            widths[column] = max(widths.get(column, 0), *map(_width, lines))
    begin, at = {}, 0
    for column in sorted(c for c, w in widths.items() if w):
        begin[column] = at
        at += widths[column] + 2
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            shown = [(c, lines[k]) for c, lines in row if k < len(lines) and lines[k]]
            if at > WIDEST + 2:
                out.append("  ".join(text for _, text in shown))
                continue
            parts, end = [], 0
            for c, text in shown:
                parts += [" " * (begin[c] - end), text]
                end = begin[c] + _width(text)
            out.append("".join(parts).rstrip())
    return [x for x in out if x]


def _sheet_rules(sheets: list[str]) -> dict[tuple[str, str, str], tuple[int, int, str]]:
    """(weight, order, effect) of the simple selectors (sign, name, tag) whose rules hide or show."""
    out, order = {}, 0
    for m in _RULE.finditer(re.sub(r"/\*.*?\*/", "", "\n".join(sheets), flags=re.S)):
        if effect := _effect(m[2]):
            for s in m[1].split(","):
                if (p := _SIMPLE.match(s.strip())) and s.strip():
                    sign, tag = p[2] or "", (p[1] or "").lower()
                    order += 1
                    out[sign, p[3] or "", tag] = ({"": 0, ".": 2, "#": 4}[sign] + bool(tag), order, effect)
    return out


def _sheet_effect(rules: dict[tuple[str, str, str], tuple[int, int, str]], tag: str, attrs: dict[str, str]) -> str:
    """The effect of the most specific rule that selects an element; of several the last."""
    asked = [("", "", tag)]
    for sign, names in ((".", attrs.get("class", "").split()), ("#", [attrs["id"]] if attrs.get("id") else [])):
        asked += [(sign, n, t) for n in names for t in ("", tag)]
    found = [rules[a] for a in asked if a in rules]
    return max(found)[2] if found else ""


def _effect(style: str) -> str:
    flat = re.sub(r"\s+", "", style.lower()).replace("!important", "")
    if re.search(r"(?:^|;)display:none(?:;|$)", flat):
        return "none"
    found = re.findall(r"(?:^|;)visibility:(hidden|collapse|visible)(?=;|$)", flat)
    return found[-1].replace("collapse", "hidden") if found else ""


def _endless(html: str) -> str:
    """html with markup that nothing closes written as the text that the parser takes it for. The parser looks for its end
    from every place where such markup begins."""
    for opening, ends in (("<!--", ("-->", "--!>")), ("<", (">",))):
        cut = max(map(html.rfind, ends)) + 1
        html = html[:cut] + html[cut:].replace(opening, "&lt;" + opening[1:])
    return html


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    tree = Builder()
    tree.feed(_endless(html))
    tree.close()
    rules = _sheet_rules(tree.sheets)
    top = Writer()
    writers, tables, lists = [top], [], []
    work: list[tuple[str, object, bool, bool]] = [("in", tree.root, True, False)]
    while work:
        what, node, shown, pre = work.pop()
        w = writers[-1]
        if isinstance(node, str):
            if shown and pre:
                for k, part in enumerate(node.split("\n")):
                    if k:
                        w.line("".join(w.parts)) if w.parts else w.line("")
                        w.parts, w.space = [], False
                    if part:
                        w.parts.append(part.expandtabs(8))
            elif shown:
                w.text(node)
            continue
        tag = node.tag  # type: ignore[attr-defined]
        if what == "in":
            attrs = node.attrs  # type: ignore[attr-defined]
            effect = _effect(attrs.get("style", ""))
            if rules and not effect:
                effect = _sheet_effect(rules, tag, attrs)
            if tag in HIDDEN or "hidden" in attrs or effect == "none" or tag == "dialog" and "open" not in attrs:
                continue
            shown = effect == "visible" or shown and effect != "hidden"
            if tag == "br":
                if shown:
                    w.flush() if w.parts else (w.line("") if w.lines and w.lines[-1] else None)
                continue
            if tag in ("hr", "wbr", "img", "embed"):
                if tag == "hr":
                    w.block(1)
                continue
            if tag == "input":
                if shown and attrs.get("type", "").lower() in ("submit", "button", "reset"):
                    w.text(f" {attrs.get('value', '')} ")
                continue
            if tag == "table":
                w.block(1)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and tables[-1]:
                writers.append(Writer())
            elif tag in BLOCK:
                w.block(int(tag in SPACED and not (tag in ("ul", "ol") and lists)))
                if tag in ("ul", "ol", "menu", "dir"):
                    start = attrs.get("start", "")
                    lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                elif tag == "li":
                    mark = "- "
                    if lists and lists[-1][0] == "ol":
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    w.indent.append(" " * len(mark))
                    w.marker = mark
                elif tag in ("dd", "blockquote"):
                    w.indent.append("    ")
            work.append(("out", node, shown, pre))
            children = node.children  # type: ignore[attr-defined]
            if tag == "details" and "open" not in attrs:
                children = [c for c in children if isinstance(c, Element) and c.tag == "summary"][:1]
            inner = pre or tag in ("pre", "textarea", "listing")
            if inner and not pre and children and isinstance(children[0], str):
                children = [children[0].removeprefix("\n"), *children[1:]]
            if tag in ("table", "thead", "tbody", "tfoot", "tr"):
                children = [c for c in children if not isinstance(c, str) or c.strip()]
            work.extend(("in", c, shown, inner) for c in reversed(children))
        elif tag == "table":
            rows = tables.pop()
            w.flush()
            for line in _table([r for r in rows if r]):
                w.line(line)
            w.block(1)
        elif tag in ("td", "th") and len(writers) > 1 and tables and tables[-1]:
            writers.pop()
            attrs = node.attrs  # type: ignore[attr-defined]
            tables[-1][-1].append((w.result(), _span(attrs.get("colspan", ""), 1000), _span(attrs.get("rowspan", ""), 65534, 0)))
        elif tag in BLOCK:
            w.block(int(tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1)))
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            elif tag in ("li", "dd", "blockquote") and w.indent:
                w.indent.pop()
                w.marker = None
    return top.result().strip("\n")


def visible_text(html: Column | str) -> Column:
    """The visible text of each page."""

    @F.arrow_udf("string")
    @lean
    def shown(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([render(h) for _, run in by_bytes(column, 1 << 20) for h in run], pa.string())

    return shown(html)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages plus text and n_chars, its code points."""
    text = F.transform(F.array(visible_text(F.col(html))), lambda t: F.struct(t.alias("text"), F.length(t).cast("long").alias("n_chars")))[0]
    return with_results(pages, text, ["text", "n_chars"])
