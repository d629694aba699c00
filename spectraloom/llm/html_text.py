"""Text of web pages by layout-aware rendering.

A tokenizer, which only goes forward, feeds a tree builder that closes and opens what HTML lets authors leave out (paragraphs, list
items, table parts, options), ignores end tags without a start and never looks past a cell or table for one. What stands in a tag,
comment or quote that the page never closes is no text, as in browsers. Visibility: elements that browsers don't show, ``hidden``,
closed ``details`` and ``dialog``, inline styles, and the page's own style sheets: rules whose selectors are made of tags, classes and
ids of one element, by importance, specificity and order; of ``@media`` those for a screen of 1280 x 800 pixels, of ``@supports`` all
but negated ones. Selectors that look at other elements or states don't hide anything. ``visibility`` is inherited and can be undone, ``display: none`` can't. The renderer keeps block spacing (margins as one
blank line), list marks and indents, preformatted text, and tables as aligned columns with spans. It works with a stack of its
own, so that deeply nested pages are no problem; indents and nested tables stop at a depth of 24, and cells wider than 60 characters
don't widen their column.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_NAME = re.compile(r"[^\s/>]+")
_ATTR = re.compile(r"[\s/]*(=?[^\s/>=]*)")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_SELECTOR = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)\Z")
_FEATURE = re.compile(r"\(\s*([a-z-]+)\s*(?::\s*([^)]*?)\s*)?\)")
_LENGTH = re.compile(r"([\d.]+)(px|em|rem)?\Z")
#: The screen that media queries are asked about.
_SCREEN = {"width": 1280.0, "height": 800.0}
_DISPLAYS = ("block", "inline", "flex", "grid", "table", "list-item", "contents", "flow-root", "ruby", "initial", "unset", "inherit")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
_NEVER = frozenset("head title script style template noscript iframe noembed noframes object embed audio video canvas svg math datalist param source track area map rp meta link base colgroup col".split())
_MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre fieldset figure form".split())
_BLOCK = _MARGIN | frozenset("html body address article aside center dd details dialog dir div dt figcaption footer header hgroup hr legend li main nav option optgroup search section summary tr caption thead tbody tfoot td th".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tag -> open elements that it ends, and the elements that shield those.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "caption": ({"caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
_WALL = frozenset("td th caption table template button object marquee applet html".split())
_DEEPEST, _WIDEST = 24, 60


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def parse(source: str) -> Node:
    """The tree: children are nodes and strings."""
    root = Node("html")
    open_ = [root]
    at, n = 0, len(source)
    where: dict[str, list[int]] = {}  # places of the open elements by tag: nothing is looked for that isn't there

    def push(node: Node) -> None:
        open_[-1].children.append(node)
        where.setdefault(node.tag, []).append(len(open_))
        open_.append(node)

    def cut(k: int) -> None:
        for x in open_[k:]:
            where[x.tag].pop()
        del open_[k:]

    def top(tags) -> int:
        few, many = (tags, where) if len(tags) <= len(where) else (where, tags)
        return max((where[t][-1] for t in few if t in many and where[t]), default=0)

    def close_to(tags, walls) -> None:
        if (k := top(tags)) and k >= top(walls):
            cut(k)

    def text(s: str) -> None:
        if s:
            open_[-1].children.append(html.unescape(s))

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:])
            break
        after = source[lt + 1 : lt + 3]
        if after[:1] in ("!", "?") or after[:1] == "/" and after[1:] and not after[1].isalpha():
            text(source[at:lt])
            if source.startswith("<!--", lt):
                quick = next((x for x in ("<!-->", "<!--->") if source.startswith(x, lt)), None)
                end = _COMMENT_END.search(source, lt + 4)
                at = lt + len(quick) if quick else end.end() if end else n
            else:
                at = source.find(">", lt) + 1 or n
            continue
        closing = after[:1] == "/"
        if not after[closing : closing + 1].isascii() or not after[closing : closing + 1].isalpha():
            text(source[at : lt + 1])
            at = lt + 1
            continue
        text(source[at:lt])
        name = _NAME.match(source, lt + 1 + closing)
        tag = name[0].lower()
        attrs, at, bare = _attrs(source, name.end())
        if at is None:
            break
        if closing:
            if tag == "p" and not where.get("p"):
                open_[-1].children.append(Node("p"))
            elif tag == "br":
                open_[-1].children.append(Node("br"))
            elif tag in _HEADINGS:
                close_to(_HEADINGS, _WALL)
            else:
                own = {"td", "th", "caption", "tr", "thead", "tbody", "tfoot"}
                # an inline element's end doesn't reach out of a block
                close_to({tag}, {"table"} if tag in own else frozenset(("template",)) if tag == "table" else (_WALL if tag in _BLOCK or tag in _WALL else _WALL | _BLOCK) - {tag})
            continue
        if tag in ("html", "body"):
            root.attrs.update((k, v) for k, v in attrs.items() if k not in root.attrs)
            continue
        if tag in _ENDS_P:
            close_to({"p"}, _WALL)
        if tag in _HEADINGS and open_[-1].tag in _HEADINGS:
            cut(len(open_) - 1)
        if tag in _IMPLIED:
            close_to(*_IMPLIED[tag])
        if tag == "tr" and open_[-1].tag == "table":
            push(Node("tbody"))
        elif tag in ("td", "th"):
            if open_[-1].tag == "table":
                push(Node("tbody"))
            if open_[-1].tag in ("tbody", "thead", "tfoot"):
                push(Node("tr"))
        elif tag in ("thead", "tbody", "tfoot"):
            close_to({"tr"}, {"table"})
        node = Node(tag, attrs)
        if tag not in _RAW and tag != "plaintext" and tag not in _VOID and not (bare and tag in ("svg", "math")):
            push(node)
            continue
        open_[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = _attrs(source, end.end())[1] if end else n
            if at is None:
                break
        elif tag == "plaintext":
            node.children.append(source[at:])
            break
    return root


def _attrs(source: str, at: int) -> tuple[dict[str, str], int | None, bool]:
    """Attributes from `at` on, the place after the tag's end (None: it has none), and whether the tag ends in a slash."""
    out: dict[str, str] = {}
    while True:
        m = _ATTR.match(source, at)
        name, at = m[1].lower(), m.end()
        if at >= len(source):
            return out, None, False
        if not name:
            return out, at + 1, source[at - 1] == "/"
        value = ""
        if (eq := _EQUALS.match(source, at)) is not None:
            at = eq.end()
            if (quote := source[at : at + 1]) in ("'", '"') and quote:
                end = source.find(quote, at + 1)
                if end < 0:
                    return out, None, False
                value, at = source[at + 1 : end], end + 1
            else:
                bare = _BARE.match(source, at)
                value, at = bare[0], bare.end()
        if name not in out:
            out[name] = html.unescape(value)


# ---------------------------------------------------------------- visibility


def _declared(style: str) -> dict[str, tuple[bool, object]]:
    """Property -> (important, what it says): none: display is none; seen: visibility; zero: no font size; pre: white space kept."""
    out: dict[str, tuple[bool, object]] = {}
    for said in style.lower().split(";"):
        name, colon, value = said.partition(":")
        if not colon:
            continue
        value, bang, _ = _SPACE.sub("", value).partition("!important")
        name, what = name.strip(), None
        if name == "display" and value != "revert":
            what = ("none", value == "none") if value == "none" or value.startswith(_DISPLAYS) else None
        elif name == "visibility" and value in ("visible", "hidden", "collapse", "initial"):
            what = "seen", value in ("visible", "initial")
        elif name == "font-size" and value and not (value[-1] == "%" or value.endswith("em") and not value.endswith("rem")):
            what = "zero", value in ("0", "0px", "0pt", "0rem")
        elif name == "font-size" and value in ("0%", "0em"):
            what = "zero", True
        elif name == "white-space":
            what = "pre", value.startswith("pre")
        if what and (bang or not out.get(what[0], (False,))[0]):
            out[what[0]] = bool(bang), what[1]
    return out


def _on_screen(query: str) -> bool:
    """Whether a list of media queries has one that holds for the screen."""

    def holds(q: str) -> bool:
        words = re.sub(r"\([^)]*\)", " ", q).replace(" and ", " ").split()
        ok = not any(w not in ("all", "screen", "only", "not", "and") for w in words)
        for f in _FEATURE.finditer(q):
            name, value = f[1], f[2]
            side = name.partition("-")[2] if name[:4] in ("min-", "max-") else name
            if side in _SCREEN:
                size = _LENGTH.match(value or "")
                if value is None or size is None:
                    ok &= value is None
                    continue
                x = float(size[1]) * (1 if size[2] in ("px", None) else 16)
                ok &= _SCREEN[side] >= x if name[:4] == "min-" else _SCREEN[side] <= x if name[:4] == "max-" else _SCREEN[side] == x
            else:
                ok &= (name, value) in (("orientation", "landscape"), ("hover", "hover"), ("pointer", "fine"), ("prefers-color-scheme", "light")) or (name in ("color", "hover", "pointer") and value is None)
        if q.count("(") > len(_FEATURE.findall(q)):
            ok = False
        return ok != ("not" in words)

    try:
        return any(holds(q.strip()) for q in query.lower().split(",")) or not query.strip()
    except ValueError:
        return False


class Sheet:
    """Rules on visibility by the id, class or tag that an element needs to have."""

    def __init__(self):
        self.by: dict[tuple[str, str], list[tuple]] = {}
        self.n = 0

    def read(self, css: str) -> None:
        """Rules of a sheet, blocks inside of blocks included; what isn't closed ends with the sheet."""
        css = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", css, flags=re.S)
        skip, heads = 0, []  # blocks that don't apply, and for each open block whether it is one
        at = 0
        for m in re.finditer(r"[{};]", css):
            head, at_ = css[at : m.start()], m.end()
            if m[0] == "{":
                kind, _, rest = head.strip().partition(" ") if head.strip().startswith("@") else ("", "", head)
                kind, paren, more = kind.lower().partition("(")
                rest = paren + more + " " + rest
                applies = not kind or (kind == "@media" and _on_screen(rest)) or (kind == "@supports" and not rest.strip().lower().startswith("not")) or kind == "@layer"
                heads.append((applies, None if kind else rest, at_))
                skip += not applies
                at = at_
            elif m[0] == "}":
                if heads:
                    applies, selectors, start = heads.pop()
                    skip -= not applies
                    if selectors is not None and not skip:
                        self.add(selectors, css[start : m.start()])
                at = at_
            elif not heads or heads[-1][1] is None:
                at = at_
        if heads and heads[-1][1] is not None and not skip:
            self.add(heads[-1][1], css[heads[-1][2] :])

    def add(self, selectors: str, style: str) -> None:
        said = _declared(style)
        if not said:
            return
        self.n += 1
        for one in selectors.lower().split(","):
            k = _SELECTOR.match(one.strip())
            if k is None or not k[0]:
                continue
            parts = re.findall(r"([.#])([\w-]+)", k[2])
            ids, classes = {x for c, x in parts if c == "#"}, {x for c, x in parts if c == "."}
            tag = "" if k[1] in (None, "*") else k[1]
            key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
            rank = (sum(c == "#" for c, _ in parts), sum(c == "." for c, _ in parts), bool(tag), self.n)
            self.by.setdefault(key, []).append((tag, ids, classes, rank, said))

    def of(self, x: Node) -> list[tuple]:
        """(rank, declarations) of the rules that an element meets."""
        own = set(x.attrs.get("class", "").lower().split())
        id_ = x.attrs.get("id", "").lower()
        keys = [("", ""), ("", x.tag), *((".", c) for c in own)] + [("#", id_)] * bool(id_)
        return [(rank, said) for k in keys for tag, ids, classes, rank, said in self.by.get(k, ()) if (not tag or tag == x.tag) and classes <= own and ids <= {id_}]


def _sheet(root: Node) -> Sheet:
    out, todo = Sheet(), [root]
    while todo:
        x = todo.pop()
        if x.tag == "style":
            if _on_screen(x.attrs.get("media", "")):
                out.read("".join(c for c in x.children if isinstance(c, str)))
        else:
            todo += [c for c in reversed(x.children) if not isinstance(c, str)]
    return out


def _effects(x: Node, rules: Sheet) -> dict[str, object]:
    """What holds for an element: none, seen, zero, pre, as far as something says so."""
    a = x.attrs
    if x.tag in _NEVER or (x.tag == "input" and a.get("type", "").lower() == "hidden"):
        return {"none": True}
    out: dict[str, object] = {}
    if "hidden" in a or (x.tag == "dialog" and "open" not in a):
        out["none"] = True
    if x.tag in ("pre", "textarea", "xmp", "plaintext", "listing"):
        out["pre"] = True
    found = rules.of(x) if rules.by else []
    if "style" in a:
        found.append(((1 << 30,), _declared(a["style"])))
    best: dict[str, tuple] = {}
    for rank, said in found:
        for what, (important, value) in said.items():
            if what not in best or (important, rank) > best[what][0]:
                best[what] = (important, rank), value
    return out | {what: value for what, (_, value) in best.items()}


# ---------------------------------------------------------------- rendering


class Lines:
    """Lines of a block so far, the open line, and what has to come before the next text."""

    __slots__ = ("done", "line", "space", "blank", "mark")

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.mark = ""

    def text(self, s: str) -> None:
        s = s.replace("\xa0", " ")
        body = _SPACE.sub(" ", s)
        if body == " " or not body:
            self.space |= bool(body) and bool(self.line)
            return
        if (self.space or body[0] == " ") and self.line:
            self.line.append(" ")
        self.space = body[-1] == " "
        self._room()
        self.line.append(body.strip(" "))

    def kept(self, s: str) -> None:
        for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self.end(True)
            if part:
                self._room()
                self.line.append(part)

    def _room(self) -> None:
        if self.blank and not self.line:
            if self.done and self.done[-1]:
                self.done.append("")
            self.blank = False

    def end(self, even_empty: bool = False) -> None:
        if self.line or even_empty:
            self.done.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def margin(self) -> None:
        self.end()
        self.blank = bool(self.done)

    def take(self, other: "Lines", first: str, rest: str) -> None:
        """The lines of a block inside, with a mark before the first and an indent before the others."""
        other.end()
        self.end()
        if other.done:
            self._room()
            self.done += [(first if k == 0 else rest) + x if x else (first.rstrip() if k == 0 else "") for k, x in enumerate(other.done)]


class Table:
    __slots__ = ("rows", "caption")

    def __init__(self):
        self.rows: list[list] = []  # of (lines, colspan, rowspan)
        self.caption: list[str] = []

    def render(self) -> list[str]:
        grid: list[dict[int, list[str]]] = []
        taken: dict[int, int] = {}  # column -> rows still covered
        width: dict[int, int] = {}
        spans = []
        for r, cells in enumerate(self.rows):
            row, col, left = {}, 0, {c: n - 1 for c, n in taken.items() if n > 1}
            covered = set(taken)
            for lines, cs, rs in cells:
                while col in covered:
                    col += 1
                row[col] = lines
                w = max(map(len, lines), default=0)
                if cs == 1:
                    width[col] = max(width.get(col, 0), min(w, _WIDEST))
                else:
                    spans.append((col, cs, min(w, _WIDEST)))
                for c in range(col, col + cs):
                    width.setdefault(c, 0)
                    if rs > 1:
                        left[c] = rs - 1
                col += cs
            grid.append(row)
            taken = left
        for col, cs, w in spans:
            lack = w - sum(width[c] for c in range(col, col + cs)) - 2 * (cs - 1)
            if lack > 0:
                width[col + cs - 1] += lack
        order = sorted(width)
        begin, x = {}, 0
        for c in order:
            begin[c] = x
            x += width[c] + (2 if width[c] else 0)
        out = list(self.caption)
        for row in grid:
            for k in range(max((len(v) for v in row.values()), default=0)):
                line = ""
                for c, v in row.items():
                    if k < len(v) and v[k]:
                        line = line.ljust(begin[c]) if len(line) < begin[c] or not line else line + "  "
                        line += v[k]
                out.append(line.rstrip())
        return out


def _number(text: str | None, default: int, low: int, high: int) -> int:
    try:
        return max(low, min(high, int(text)))
    except (TypeError, ValueError):
        return default


def render(root: Node) -> str:
    rules = _sheet(root)
    out = Lines()
    # (what to do, node, lines, (seen, no font size), kept, depth, list or table around)
    todo: list[tuple] = [("in", root, out, (True, False), False, 0, None)]
    while todo:
        what, x, lines, seen, kept, depth, around = todo.pop()
        if what == "in":
            if isinstance(x, str):
                if seen == (True, False):
                    lines.kept(x) if kept else lines.text(x)
                continue
            own = _effects(x, rules)
            if own.get("none"):
                continue
            seen = own.get("seen", seen[0]), own.get("zero", seen[1])
            tag, inner, state = x.tag, lines, around
            if tag == "br":
                lines.end(True)
                continue
            if tag in ("input", "button") and tag == "input":
                if seen == (True, False) and x.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                    lines.text(x.attrs.get("value", ""))
                continue
            deep = depth >= _DEEPEST
            if tag in _MARGIN:
                # a list in a list has no margin
                lines.end() if tag in ("ul", "ol", "menu") and isinstance(around, list) else lines.margin()
            elif tag in _BLOCK:
                lines.end()
            if tag in ("ul", "ol", "menu", "dir"):
                state = [tag, _number(x.attrs.get("start"), 1, -(10**9), 10**9)]
            elif tag == "table" and not deep:
                state = Table()
            elif tag == "tr" and isinstance(around, Table):
                around.rows.append([])
            if not deep and (tag in ("li", "blockquote", "dd") or (tag in ("td", "th", "caption") and isinstance(around, Table))):
                inner = Lines()
                state = around if tag == "li" else None
            todo.append(("out", x, lines, seen, kept, depth, (around, state, inner)))
            kids = x.children
            if tag == "details" and "open" not in x.attrs:
                kids = [c for c in kids if not isinstance(c, str) and c.tag == "summary"]
            kept = own.get("pre", kept)
            if tag in ("pre", "textarea") and kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
                kids = [kids[0][1:], *kids[1:]]
            if isinstance(state, Table) and tag in ("table", "thead", "tbody", "tfoot", "tr"):
                kids = [c for c in kids if not isinstance(c, str) or not c.isspace()]
            below = depth + (inner is not lines)
            todo += [("in", c, inner, seen, kept, below, state) for c in reversed(kids)]
            continue
        around, state, inner = around
        tag = x.tag
        if inner is not lines:
            if tag == "li":
                mark = "- "
                if isinstance(around, list):
                    if around[0] == "ol":
                        n = _number(x.attrs.get("value"), around[1], -(10**9), 10**9)
                        mark, around[1] = f"{n}. ", n + 1
                lines.take(inner, mark, " " * len(mark))
            elif tag in ("blockquote", "dd"):
                lines.take(inner, "    ", "    ")
            else:
                inner.end()
                if tag == "caption":
                    around.caption += inner.done
                else:
                    if not around.rows:
                        around.rows.append([])
                    around.rows[-1].append((inner.done, _number(x.attrs.get("colspan"), 1, 1, 1000), _number(x.attrs.get("rowspan"), 1, 1, 65534)))
        elif isinstance(state, Table) and tag == "table":
            body = Lines()
            body.done = state.render()
            lines.take(body, "", "")
        if tag in _MARGIN:
            lines.end() if tag in ("ul", "ol", "menu") and isinstance(around, list) else lines.margin()
        elif tag in _BLOCK:
            lines.end()
        elif tag == "q":
            pass
    out.end()
    while out.done and not out.done[-1]:
        out.done.pop()
    while out.done and not out.done[0]:
        out.done.pop(0)
    return "\n".join(out.done)


def html_to_text(source: str | None) -> str:
    """All visible text of a page; null and empty pages have none."""
    return render(parse(source.replace("\x00", ""))) if source else ""


def _extract(batches):
    for b in batches:
        page = b.column(b.num_columns - 1)
        for lo in range(0, b.num_rows, 64):
            text = [html_to_text(x.as_py()) for x in page.slice(lo, 64)]
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, 64) for c in b.columns[:-1]), pa.array(text, pa.string())], names=[*b.schema.names[:-1], "text"])


def extract_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages with text instead of the column `source`; one named text is replaced. Null and empty pages have the empty text. Rows are
    independent; an empty table gives an empty one."""
    keep = [c for c in pages.columns if c != source and c.lower() != "text"]
    src = pages.select(*[pages[c].alias(f"_c{i}") for i, c in enumerate(keep)], pages[source].alias("_html"))
    schema = ", ".join([*(f"_c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "text string"])
    return src.transform(C.map_batches, _extract, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "text")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")
