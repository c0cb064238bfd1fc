"""Main content and images of web pages."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- fixed values ---
CONTENT_HINTS = ("content", "contents", "article", "detail", "document", "entry", "post", "print", "view")
CONTENT_BONUS = {"data-content": 5000, "print-content": 4500, "article-content": 4000, "article-body": 4000, "post-content": 4000, "entry-content": 4000}
NAVIGATION_HINTS = ("breadcrumb", "category", "filter", "footer", "gnb", "header", "menu", "modal", "navbar", "pagination", "popup", "search", "sidebar", "subject-wrap")
DECORATIVE_HINTS = ("badge", "copyright", "footer", "icon", "license", "logo", "open-box")
DROPPED = ("script", "style", "noscript", "template", "nav", "footer", "iframe", "canvas", "svg")
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre", "table")
CLOSED_BLOCKS = ("p", "li", "blockquote", "pre", "table")
CONTROLS = ("button", "input", "select", "textarea")
MAX_CHARS, MAX_CHUNKS = 100_000, 200
DEFAULT_TITLE, IMAGE_LABEL = "웹페이지", "웹페이지 이미지 {}"
# --- end of fixed values ---

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_OPENS_P = {"div", "section", "article", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "main", "nav", "footer", "header"}


def tidy(text: str) -> str:
    """As tidemill.functions.text.clean_document_text says, with NFKC."""
    text = re.sub(r"\r\n?", "\n", unicodedata.normalize("NFKC", text))
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _even(white: str) -> str:
    """What `tidy` makes of white space between two words."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", white))


def _measured(piece: str) -> tuple[str, int, str]:
    """A piece of text as its white space at the front, the length of the rest once tidy, and the white space at its end (or all of it
    in front)."""
    s = _even(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", re.sub(r"\r\n?", "\n", unicodedata.normalize("NFKC", piece))))
    word = s.strip()
    return (s[: len(s) - len(s.lstrip())], len(word), s[len(s.rstrip()) :]) if word else (s, 0, "")


class Lengths:
    """How long any run of pieces is when it is joined and tidied: sums of a segment tree, so that overlapping runs aren't read again."""

    def __init__(self, pieces: list[tuple[str, int, str]], mark: str):
        self.mark, self.n = mark, 1 << max(0, len(pieces) - 1).bit_length()
        self.sums: list = [None] * self.n + pieces + [None] * (self.n - len(pieces))
        for i in range(self.n - 1, 0, -1):
            self.sums[i] = self._both(self.sums[2 * i], self.sums[2 * i + 1])

    def _both(self, a, b):
        if a is None or b is None:
            return a or b
        if not a[1]:
            return (_even(a[0] + self.mark + b[0]), b[1], b[2])
        between = _even(a[2] + self.mark + b[0])
        return (a[0], a[1] + len(between) + b[1], b[2]) if b[1] else (a[0], a[1], between)

    def of(self, begin: int, end: int) -> tuple[str, int, str]:
        left, right, a, b = None, None, begin + self.n, end + self.n
        while a < b:
            if a & 1:
                left, a = self._both(left, self.sums[a]), a + 1
            if b & 1:
                b -= 1
                right = self._both(self.sums[b], right)
            a, b = a >> 1, b >> 1
        return self._both(left, right) or ("", 0, "")


class Page(HTMLParser):
    """A page as arrays in document order: node i holds the nodes and texts of the half-open ranges that end at stop[i] and said[i].

    Everything a container's score needs is a difference of running sums over such a range, or a sum of `Lengths`; what a node's
    ancestors say is handed down as it opens. No tree is walked.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.up, self.stop, self.begin, self.said = [], [], [], [], [], []
        self.gone: list[bool] = []  # whether the node or one above it is dropped
        self.closed: list[int] = []  # how many nodes above it are closed blocks
        self._named: Counter = Counter()
        self.texts: list[str] = []
        self.titles: list[str] = []
        self._open: list[int] = []
        self._hidden = 0
        self.feed(html)
        self.close()
        while self._open:
            self._shut()

    def _shut(self) -> None:
        i = self._open.pop()
        self.stop[i], self.said[i] = len(self.tag), len(self.texts)
        self._hidden -= self.tag[i] in DROPPED
        self._named[self.tag[i]] -= 1

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _OPENS_P else set())
        while self._open and self.tag[self._open[-1]] in closes:
            self._shut()
        i = len(self.tag)
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        up = self._open[-1] if self._open else -1
        self.up.append(up)
        self.gone.append(tag in DROPPED or (up >= 0 and self.gone[up]))
        self.closed.append(self.closed[up] + (self.tag[up] in CLOSED_BLOCKS) if up >= 0 else 0)
        self.begin.append(len(self.texts))
        self.stop.append(i + 1)
        self.said.append(len(self.texts))
        if tag not in _VOID:
            self._open.append(i)
            self._hidden += tag in DROPPED
            self._named[tag] += 1

    def handle_endtag(self, tag):
        if self._named[tag]:
            while self.tag[self._open[-1]] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        if self._open and self.tag[self._open[-1]] == "title":
            self.titles.append(data)
        elif not self._hidden:
            self.texts.append(data)

    def marker(self, i: int) -> str:
        a = self.attrs[i]
        return f"{a.get('id', '')} {a.get('class', '')}".lower().replace("_", "-")

    def text(self, i: int) -> str:
        return tidy(" ".join(self.texts[self.begin[i] : self.said[i]]))

    def inside(self, i: int, tags) -> list[int]:
        return [j for j in range(i + 1, self.stop[i]) if self.tag[j] in tags and not self.gone[j]]

    def above(self, i: int):
        while (i := self.up[i]) >= 0:
            yield i

    def _measure(self) -> None:
        """Running sums over the nodes, and lengths of texts and of blocks."""
        self._lengths = Lengths([_measured(t) for t in self.texts], " ")
        own = [j for j in range(len(self.tag)) if self.tag[j] in BLOCKS and not self.gone[j]]
        self._blocks, pieces = own, []
        for j in own:
            a, n, z = self._lengths.of(self.begin[j], self.said[j])
            if self.begin[j] < self.said[j] and self.texts[self.said[j] - 1].endswith("\r"):  # it and the line's end are one
                a, z = (a, z[:-1]) if n else (a[:-1], z)
            pieces.append((a, n, z))
        self._block_lengths = Lengths(pieces, "\n")
        links = [self._lengths.of(self.begin[j], self.said[j])[1] if t == "a" and not self.gone[j] else 0 for j, t in enumerate(self.tag)]
        self._links = [0, *accumulate(links)]
        self._controls = [0, *accumulate(t in CONTROLS and not g for t, g in zip(self.tag, self.gone))]

    def score(self, i: int) -> float:
        role, marker = self.attrs[i].get("role", "").lower(), self.marker(i)
        kind = 2000 if self.tag[i] == "main" or role == "main" else 1000 if self.tag[i] == "article" else 0
        gain = sum(v for k, v in CONTENT_BONUS.items() if k in marker) - (6000 if any(h in marker for h in NAVIGATION_HINTS) else 0)
        first, end = i + 1, self.stop[i]
        blocks = self._block_lengths.of(bisect_left(self._blocks, first), bisect_left(self._blocks, end))[1]
        text = self._lengths.of(self.begin[i], self.said[i])[1]
        return blocks + 0.08 * min(text, 30_000) + kind + gain - 0.7 * (self._links[end] - self._links[first]) - 80 * (self._controls[end] - self._controls[first])

    def root(self) -> int | None:
        kinds = [i for i, t in enumerate(self.tag) if (t in ("main", "article") or self.attrs[i].get("role") == "main") and not self.gone[i]]
        kinds += [i for i, t in enumerate(self.tag) if t in ("div", "section") and any(h in self.marker(i) for h in CONTENT_HINTS) and not self.gone[i]]
        if kinds:
            self._measure()
            return max(dict.fromkeys(kinds), key=self.score)
        return next((i for i, t in enumerate(self.tag) if t == "body"), 0 if self.tag else None)

    def blocks(self, root: int) -> list[str]:
        out, outer = [], self.closed[root] + (self.tag[root] in CLOSED_BLOCKS)
        for i in self.inside(root, BLOCKS):
            text = "" if self.closed[i] > outer else self.text(i)  # within a closed block it has been said
            if text:
                out.append(f"{'#' * int(self.tag[i][1])} {text}" if re.fullmatch("h[1-6]", self.tag[i]) else text)
        return out or [t for t in [self.text(root)] if t]

    def images(self, root: int, base: str):
        for i in self.inside(root, ("img",)):
            a = self.attrs[i]
            src = next((v for k in ("src", "data-src", "data-original", "data-lazy-src") if (v := a.get(k, "").strip())), "") or a.get("srcset", "").split(",")[0].strip().split(" ")[0]
            if not src or src.startswith(("data:", "blob:")):
                continue
            url = urljoin(base, src)
            marks = [self.marker(j) for _, j in zip(range(6), [i, *self.above(i)])] + [url.lower().replace("_", "-")]
            yield url, a.get("alt", "") or a.get("title", ""), any(h in m for h in DECORATIVE_HINTS for m in marks)


def parse(html: str, url: str) -> dict:
    page = Page(html or "")
    root = page.root()
    title = tidy(" ".join(page.titles)) or urlparse(url or "").hostname or DEFAULT_TITLE
    if root is None:
        return {"title": title[:255], "text": "", "images": []}
    images = [{"url": u, "label": label, "decorative": d} for u, label, d in page.images(root, url or "")]
    return {"title": title[:255], "text": tidy("\n\n".join(page.blocks(root))), "images": images}


def parsed(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, title, text, images array<struct<url,label,decorative>>): one Arrow pass, pages by themselves."""
    kind = pages.schema[id_column].dataType.simpleString()
    image = pa.list_(pa.struct([("url", pa.string()), ("label", pa.string()), ("decorative", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                got = [parse(h, u) for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g["title"] for g in got]), pa.array([g["text"] for g in got]), pa.array([g["images"] for g in got], image)], names=["id", "url", "title", "text", "images"])

    return pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), html).mapInArrow(run, f"id {kind}, url string, title string, text string, images array<struct<url:string,label:string,decorative:boolean>>")


def image_table(parsed_pages: DataFrame) -> DataFrame:
    """(id, place, url, label): images that aren't decorative, each URL once a page, with a label by its place."""
    each = parsed_pages.select("id", F.posexplode("images").alias("at", "i")).where("NOT i.decorative")
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("id", "i.url").orderBy("at"))).where("_n = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    label = F.when(F.col("i.label") != "", F.col("i.label")).otherwise(F.concat(F.lit(IMAGE_LABEL.replace("{}", "")), F.col("place")))
    return placed.select("id", "place", "i.url", label.alias("label"))


def gate(text: Column, images: Column, chunks: Column | None = None) -> Column:
    """Why a page can't be taken, or null."""
    out = F.when((F.coalesce(text, F.lit("")) == "") & (F.size(images) == 0), "empty").when(F.length(text) > MAX_CHARS, "too_long")
    return out if chunks is None else out.when(chunks > MAX_CHUNKS, "too_many_chunks")
