"""Main text of web pages by host consensus.

Each page is parsed once into blocks and containers.  A container's score is the text of the blocks in it, less their link
text; among equal scores the innermost one is the page's choice, so it holds all of the page's running text, parts beside an
article included.  Its generalised path of tags and classes is the page's vote; Spark counts the votes
per host, and pages are extracted again from their parsed blocks by their host's winning path.  A page whose containers on
that path hold less than half the text of its own choice keeps its own.

A block is a run of text between block-level tags; character references are decoded, white space in it becomes one
space, and blocks are joined by two line ends.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are known by their tags, roles, classes and ids, and give no text, but for elements that hold the
page itself: where no article or main element with running text stands outside of all furniture, an element that only has such
a word within a longer name (`sidebar-right`), or is a form or header, is none if it holds more than half of the page's running
text, and one that is marked by the word itself is none if it holds ten times what stands outside of all furniture.  Scripts,
controls, hidden elements, reader comments and consent notices are furniture always.  Headings in an article's own header are
of the article.

Tags are read as HTML5 reads them: end tags of head, p, li and table cells may be left out, quotes count only where a
value begins, and a quote that nothing closes ends with its word.

Edge cases: null and empty pages have an empty text and no vote; unclosed and stray tags are tolerated; a null url
votes with the empty host; very long pages are read whole, one at a time, and blocks below DEEPEST nested containers
belong to the last of those; repeated rows and null page_ids keep their rows; an empty table gives an empty result; extra
columns are ignored.  A hot host's votes are summed within each task first, and its pages are joined to one row.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize

#: Bytes of winning paths that may be broadcast; with more, pages and winners are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Nested containers that are told apart, and characters of a path that is written out.
DEEPEST, LONGEST = 256, 1000
#: Fixed sets of HTML tag names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTROLS = {"button", "select", "menu", "dialog", "head"} | RAW
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
#: Tags that a head may hold; any other one ends it.
IN_HEAD = {"head", "html", "title", "meta", "link", "base", "basefont", "bgsound", "script", "style", "noscript", "template"}
#: Tags that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Words in a class, id or role that mark page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?<!\bno-)(?<!\bhas-)(?<!\bwith-)(?<!\bwithout-)(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|header|masthead|footer|comments?|commentlist|disqus|replies|reply|respond|"
    r"cookies?|consent|gdpr|notice|notices|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|search|pagination|pager|widget|toolbar|hidden|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
#: Words of those that mark furniture wherever it is and whatever it holds.
ALWAYS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|reply|respond|cookies?|consent|gdpr)(?:$|[\s_-])", re.I)
#: What an element is marked as: furniture always, by a word or tag of its own, by part of a name, or an article's own header.
NEVER, STRONG, WEAK, HEADER = range(4)
_VALUE = r"""(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*+|["'][^\s>]*+)"""
_NAME = r"[^\s/>][^\s/>=]*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+", re.S)
_SPACE = re.compile(r"\s+")
_PARSED = "page_id long, url string, host string, best string, score long, own int, paths array<string>, blocks array<struct<text:string,inside:array<int>>>"


def generalise(tag: str, attrs: dict) -> str:
    """A tag with its first class, digits taken out."""
    names = (attrs.get("class") or "").split()
    return tag + ("." + re.sub(r"\d+", "0", names[0].lower()) if names else "")


def mark_of(tag: str, attrs: dict, inside: bool) -> int | None:
    """What marks an element as furniture, if anything; inside: an article or main element."""
    if tag in CONTROLS or "hidden" in attrs:
        return NEVER
    names = " ".join(attrs.get(k) or "" for k in ("class", "id", "role")) if tag not in ("body", "html", "article", "main") else ""
    if ALWAYS.search(names):
        return NEVER
    if tag in ("nav", "footer", "aside") or any(FURNITURE.fullmatch(x) for x in names.split()):
        return STRONG
    if tag == "header" and inside:
        return HEADER
    return WEAK if tag in ("header", "form") or FURNITURE.search(names) else None


def attributes(rest: str) -> dict:
    found: dict = {}
    for name, value in _ATTR.findall(rest):
        if value[:1] in ("'", '"'):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        found.setdefault(name.lower(), html.unescape(value))
    return found


class Page:
    """Blocks of a page: (text, link text length, numbers of the containers around); container 0 is the page itself.

    Blocks of furniture are left out.  stack: (tag, step, container, mark) of the open elements; marks: what each mark is.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, tuple[int, ...]]] = []
        self.paths: list[str] = [""]
        self.stack: list[tuple[str, str, int | None, int | None]] = []
        self.marks: list[int] = []
        self._found: list[tuple] = []
        self._run: list[str] = []
        self._links = 0
        at, n = 0, len(source)
        while at < n:
            found = _TOKEN.search(source, at)
            if not found:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                self._close(tag)
                continue
            if tag in RAW and not (found[3].endswith("/") and tag == "svg"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            self._open(tag, found[3])
        self._flush()
        self._judge()

    def _judge(self) -> None:
        """Keep the blocks that are in no furniture, which rests on what all of it holds."""
        running = [max(0, len(text) - 2 * links) for text, links, *_ in self._found]
        held, outside, article = [0] * len(self.marks), 0, False
        for n, (_, _, _, marks, _, in_article) in zip(running, self._found, strict=True):
            for m in marks:
                held[m] += n
            if not marks:
                outside += n
                article = article or (in_article and n > 0)
        whole = sum(running)
        pardoned = [
            not article and (kind == WEAK and 2 * n > whole or kind == STRONG and 2 * n > whole and n >= 10 * outside)
            for kind, n in zip(self.marks, held, strict=True)
        ]
        for text, links, inside, marks, heading, _ in self._found:
            if all(pardoned[m] or (heading and self.marks[m] == HEADER) for m in marks):
                self.blocks.append((text, links, inside))

    def _text(self, raw: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and raw.strip():
            self.stack.pop()
        self._run.append(raw)
        if any(x[0] == "a" for x in self.stack[-4:]):
            self._links += len(raw)

    def _flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self._run))).strip() if self._run else ""
        marks = [x[3] for x in self.stack if x[3] is not None]
        if text and not any(self.marks[m] == NEVER for m in marks):
            tags = {x[0] for x in self.stack}
            inside = (0, *(x[2] for x in self.stack if x[2] is not None))
            self._found.append((text, min(self._links, len(text)), inside, marks, bool(tags & HEADINGS), bool(tags & {"article", "main"})))
        self._run, self._links = [], 0

    def _open(self, tag: str, rest: str) -> None:
        if tag not in IN_HEAD:
            for i, x in enumerate(self.stack):
                if x[0] == "head":
                    self._flush()
                    del self.stack[i:]
                    break
        if tag == "br":
            self._run.append("\n")
            return
        if tag in VOID:
            if tag not in INLINE:
                self._flush()
            return
        attrs = attributes(rest) if rest else {}
        if tag not in INLINE:
            self._flush()
            if tag in ENDS_P:
                self._pop("p", {"article", "main", "section", "div", "td", "body", "blockquote", "li"})
            elif tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                self._pop(tag, {"ul", "ol", "table", "dl", "div", "article"})
        step, number, kind = generalise(tag, attrs), None, mark_of(tag, attrs, any(x[0] in ("article", "main") for x in self.stack))
        mark = None if kind is None else len(self.marks)
        if kind is not None:
            self.marks.append(kind)
        held = [x[2] for x in self.stack if x[2] is not None]
        if tag in CONTAINERS and len(held) < DEEPEST:
            number = len(self.paths)
            above = self.paths[held[-1]] if held else ""
            if len(above) > LONGEST:
                above = "#" + hashlib.sha256(above.encode("utf-8", "replace")).hexdigest()
            between = [x[1] for x in self.stack[1 + max((i for i, x in enumerate(self.stack) if x[2] is not None), default=-1) :] if x[0] not in INLINE and x[0] != "p"]
            self.paths.append(">".join(x for x in [above, *between, step] if x))
        self.stack.append((tag, step, number, mark))

    def _pop(self, tag: str, stops: set) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] in stops:
                return

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in ("body", "html"):  # what follows is still of the body
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if (tag in INLINE and self.stack[i][0] not in INLINE) or (tag == "li" and self.stack[i][0] in ("ul", "ol")) or (tag in ("td", "th", "tr") and self.stack[i][0] == "table"):
                return

    def scores(self) -> list[int]:
        """The text less links of each container's blocks."""
        out = [0] * len(self.paths)
        for text, links, inside in self.blocks:
            for c in inside:
                out[c] += max(0, len(text) - 2 * links)
        return out

    def best(self) -> tuple[str, int] | None:
        """The path and the score of the page's choice: of equal scores, the innermost container."""
        scores = self.scores()
        top = max(range(len(scores)), key=lambda c: (scores[c], c))
        return (self.paths[top], scores[top]) if scores[top] > 0 else None


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, best (path), score, own (best's place in paths), paths, blocks (with places in paths), per row."""

    def run(it):
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("best", pa.string()), ("score", pa.int64()), ("own", pa.int32()),
            ("paths", pa.list_(pa.string())), ("blocks", pa.list_(pa.struct([("text", pa.string()), ("inside", pa.list_(pa.int32()))]))),
        ])
        for batch in batches(it, column="html"):
            rows = []
            for page_id, url, host, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "html")), strict=True):
                page = Page(source or "")
                best = page.best() or (None, 0)
                paths = list(dict.fromkeys(page.paths[c] for _, _, inside in page.blocks for c in inside))
                place = {path: i for i, path in enumerate(paths)}
                blocks = [{"text": text, "inside": sorted({place[page.paths[c]] for c in inside})} for text, _, inside in page.blocks]
                rows.append((page_id, url, host, best[0], best[1], place.get(best[0]), paths, blocks))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").mapInArrow(run, _PARSED)


def winners(parsed: DataFrame) -> DataFrame:
    """host, path: the path with the most votes, then the most text, of each host."""
    voted = parsed.where("best is not null").groupBy("host", "best").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    first = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "best")).alias("first")
    return voted.groupBy("host").agg(first).select("host", F.col("first.best").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    parsed = materialize(parse(pages), "parsed")
    won = materialize(winners(parsed).withColumnRenamed("host", "_host"), "winners")
    size = won.agg(F.sum(F.octet_length("_host") + F.octet_length("path") + 32)).first()[0] or 0
    won = F.broadcast(won) if size <= BROADCAST_BYTES else won
    rows = parsed.join(won, F.col("host") == F.col("_host"), "left")
    inside = lambda place: F.transform(F.filter("blocks", lambda b: F.array_contains(b["inside"], place)), lambda b: b["text"])
    rows = rows.withColumn("winner", F.coalesce(inside((F.array_position("paths", F.col("path")) - 1).cast("int")), F.array().cast("array<string>")))
    rows = rows.withColumn("choice", F.when(F.col("own").isNull(), F.transform("blocks", lambda b: b["text"])).otherwise(inside(F.col("own"))))
    chars = lambda texts: F.aggregate(texts, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    text = F.array_join(F.when(F.size("winner").cast("boolean") & (2 * chars("winner") >= chars("choice")), F.col("winner")).otherwise(F.col("choice")), "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
