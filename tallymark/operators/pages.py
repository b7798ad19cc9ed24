"""What a page holds: title, metadata, absolute links, images, structured data, text and markdown.

Pages go through a tokenizer with the state of the tree in Arrow batches, one
page after the other; nothing but its own row is kept of a page.

Defined results: null and empty pages have empty parts; what is not closed ends
with the page; a link that cannot be joined with the page's address stays as it
is; structured data that is no JSON is left out; of metadata with one name the
first counts; in titles, character references count only with their semicolon.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..registry import register

#: Elements whose content is no text, those that break lines, and those that have no end.
SILENT = {"script", "style", "template", "noscript"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
#: Pages whose parts a task holds at a time.
STEP = 64
PARTS = "title string, meta map<string,string>, links array<string>, images array<string>, data array<string>, text string, markdown string"


class Page(HTMLParser):
    """One page: feed it, close it, and ask for its parts."""

    def __init__(self, url: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.meta = url or "", None, {}
        self.here = 0  # how far the page has been read
        self.links: list[str] = []
        self.images: list[str] = []
        self.data: list[str] = []
        self.plain: list[str] = []
        self.marked: list[str] = []
        self.silent: list[str] = []  # open elements without text
        self.kept: list[str] | None = None  # text of an open title or script of data
        self.anchors: list[tuple[int, str]] = []  # open links: where their text began, and where they lead
        self.lists: list[str] = []

    def absolute(self, link: str) -> str:
        try:
            return urljoin(self.base, link.strip())
        except ValueError:
            return link.strip()

    def both(self, text: str, marked: str | None = None) -> None:
        self.plain.append(text)
        self.marked.append(text if marked is None else marked)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = {k: v or "" for k, v in reversed(attrs)}  # of a repeated attribute the first counts
        if tag == "base" and at.get("href"):
            self.base = self.absolute(at["href"])
        elif tag == "meta":
            name = at.get("name") or at.get("property") or at.get("http-equiv")
            if name and "content" in at:
                self.meta.setdefault(name.strip().lower(), at["content"].strip())
            elif "charset" in at:
                self.meta.setdefault("charset", at["charset"].strip())
        elif tag == "title":
            self.kept = []
        elif tag == "a" and "href" in at:
            link = self.absolute(at["href"])
            self.links.append(link)
            self.anchors.append((len(self.marked), link))
        elif tag == "img" and at.get("src"):
            self.images.append(self.absolute(at["src"]))
            self.both(f" {at['alt']} " if at.get("alt") else "", f" ![{at.get('alt', '')}]({self.images[-1]}) ")
        if tag in SILENT:
            self.silent.append(tag)
            if tag == "script" and at.get("type", "").strip().lower() == "application/ld+json":
                self.kept = []
        if tag in ("ul", "ol"):
            self.lists.append(tag)
        if tag in BLOCK:
            lead = "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "  " * (len(self.lists) - 1) + ("1. " if self.lists and self.lists[-1] == "ol" else "- ") if tag == "li" else "> " if tag == "blockquote" else ""
            self.both("\n", "\n" + lead)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.kept is not None and not self.silent:
            self.titled()
        if tag in self.silent:
            if tag == "script" and self.kept is not None:
                self.structured("".join(self.kept))
                self.kept = None
            self.silent.remove(tag)
        if tag == "a" and self.anchors:
            start, link = self.anchors.pop()
            said = " ".join("".join(self.marked[start:]).split())
            self.marked[start:] = [f"[{said}]({link})"] if said else []
        if tag in ("ul", "ol") and tag in self.lists:
            self.lists.pop()
        if tag in BLOCK:
            self.both("\n")

    def updatepos(self, i: int, j: int) -> int:
        self.here = j
        return super().updatepos(i, j)

    def finished(self, text: str) -> str:
        """Text as it stands on the page, with only those references resolved that end with a semicolon."""
        end = self.rawdata.find("<", self.here)
        raw = self.rawdata[self.here : end if end >= 0 else None]
        whole = lambda m: unescape(m[0]) if m[1][0] == "#" or m[1] in html5 else m[0]
        return re.sub("&(#?[0-9A-Za-z]+;)", whole, raw) if unescape(raw) == text else text

    def handle_data(self, text: str) -> None:
        if self.kept is not None:
            self.kept.append(text if self.silent else self.finished(text))
        elif not self.silent:
            self.both(re.sub(r"\s+", " ", text))

    def titled(self) -> None:
        """The first title counts."""
        said, self.kept = " ".join("".join(self.kept).split()), None
        self.title = said if self.title is None else self.title

    def structured(self, text: str) -> None:
        try:
            found = json.loads(text)
        except ValueError:
            return
        self.data += [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in (found if isinstance(found, list) else [found])]

    def parts(self) -> tuple:
        if self.kept is not None and not self.silent:  # a title that nothing closes
            self.titled()
        tidy = lambda parts: "\n".join(x for x in (" ".join(line.split(" ")).strip() for line in re.sub(" +", " ", "".join(parts)).split("\n")) if x)
        return self.title or "", self.meta, self.links, self.images, self.data, tidy(self.plain), tidy(self.marked)


def parsed(html: str | None, url: str | None) -> tuple:
    page = Page(url)
    page.feed(html or "")
    page.close()
    return page.parts()


def extract(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``key`` and the parts of each page (``PARTS``).  A task holds the parts of ``STEP`` pages at a time beside the batch that it reads."""
    names = [x.split()[0] for x in PARTS.split(", ")]

    kind = pages.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, {PARTS}"
    held = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                some = batch.slice(at, STEP)
                rows = zip(*[parsed(h, u) for h, u in zip(some["__html"].to_pylist(), some["__url"].to_pylist())])
                yield pa.RecordBatch.from_arrays([some["__key"], *[pa.array([list(x.items()) for x in c] if n == "meta" else c, held.field(n).type) for n, c in zip(names, rows)]], schema=held)

    return pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(html).alias("__html")).mapInArrow(run, shape)


register("page_extract", lambda v: extract(v.pages, "page_id", "url", "html").select("page_id", "title", F.size("links").alias("links")), r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\s+', ' ', 'g')) AS title, CAST(len(regexp_extract_all(html, '(?i)<a [^>]*href=')) AS INT) AS links FROM pages")
# Each link of a page in order, with the address that it leads to.
register(
    "page_links", lambda v: extract(v.pages, "page_id", "url", "html").select("page_id", F.posexplode("links").alias("place", "link")),
    r"WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS host, regexp_extract_all(html, '(?i)<a [^>]*href=\"([^\"]*)\"', 1) AS l FROM pages) SELECT page_id, unnest(range(0, len(l)))::INT AS place, CASE WHEN starts_with(unnest(l), '/') THEN host || unnest(l) ELSE unnest(l) END AS link FROM l",
)
register("page_parts", lambda v: extract(v.pages, "page_id", "url", "html").select("page_id", "meta", "images", "data", F.md5("text").alias("text_md5"), F.char_length("text").alias("text_chars"), F.md5("markdown").alias("markdown_md5")))
