"""Web pages to titles, authors, years, chunks, tables and images."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import text as T

#: Elements whose text is no content, those that are a block of it, those without an end, and where the content is looked for, in order.
SKIP = {"script", "style", "nav", "footer", "header", "aside"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"p", "li", "blockquote"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ROOTS = [("article",), ("#abs", ".abstract-content", "@articleBody"), ("main",), ("role=main",), (".content", ".post", ".entry"), ("body",)]


def _inner(html: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """The content of the meta element of a name or property."""
    tag = F.regexp_extract(html, rf"(?is)(<meta\b[^>]*\b(?:name|property)\s*=\s*[\"']?{name}[\"'\s][^>]*>)", 1)
    return F.nullif(F.trim(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))


def title(html: Column, url: Column) -> Column:
    """<title>, else <h1>, else og:title, else the URL's path."""
    return F.coalesce(_inner(html, "title"), _inner(html, "h1"), meta(html, "og:title"), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))


def authors(html: Column) -> Column:
    """Authors by meta elements, and texts under 200 characters of addresses and of elements of class author or byline; sorted, each once."""
    tags = T.every(html, r"(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*[\"']?(?:article:)?author[\"'\s][^>]*>")
    named = F.transform(tags, lambda t: F.trim(F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)))
    shown = F.concat(T.every(html, r"(?is)<address\b[^>]*>(.*?)</address>", 1), T.every(html, r"(?is)<\w+\b[^>]*\bclass\s*=\s*[\"'][^\"']*\b(?:author|byline)\b[^\"']*[\"'][^>]*>(.*?)</\w+>", 1))
    texts = F.filter(F.transform(shown, lambda t: F.trim(F.regexp_replace(t, "<[^>]*>", ""))), lambda t: F.length(t) < 200)
    return F.array_sort(F.array_distinct(F.filter(F.concat(named, texts), lambda a: a != "")))


def year(html: Column) -> Column:
    """The first four digits of the publication date in meta elements, else in the first time element."""
    digits = lambda c: F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).cast("int")
    stamp = F.regexp_extract(html, r"(?is)<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.coalesce(digits(meta(html, "article:published_time")), digits(meta(html, "date")), digits(stamp))


class _Page(HTMLParser):
    """One pass over a page: blocks by content root, tables as lines of cells, the abstract and the images."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, set[str]]] = []
        self.blocks: dict[str, list[tuple[str, str]]] = {}
        self.abstract, self.images = None, []
        self.text: list[str] | None = None
        self.kind, self.rows, self.cells, self.cell, self.caption, self.summary = "", None, None, None, None, None

    def marks(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = {tag, *(f".{c}" for c in a.get("class", "").split()), f"#{a.get('id', '')}", f"@{a.get('itemprop', '')}"}
        return names | ({"role=main"} if a.get("role") == "main" else set())

    def inside(self, *marks):
        return any(m in names for m in marks for _, names in self.open)

    def keep(self, kind, words):
        line = " ".join("".join(words).split())
        if line and not self.inside(*SKIP, ".ads", ".sidebar"):
            for roots in ROOTS:
                for root in roots:
                    if root == "body" or self.inside(root):
                        self.blocks.setdefault(str(roots), []).append((kind, line))
                        break

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (a.get("name") == "description" or a.get("property") == "og:description") and self.abstract is None and len(a.get("content", "").strip()) >= 80:
            self.abstract = a["content"].strip()
        if tag == "img" and a.get("src"):
            small = all(a.get(k, "").isdigit() for k in ("width", "height")) and min(int(a["width"]), int(a["height"])) < 100
            if not small:
                self.images.append([a["src"], a.get("alt", ""), None])
        if tag in VOID:
            return
        names = self.marks(tag, attrs)
        if tag in HEADINGS | BLOCKS and self.rows is None:
            if self.text is not None:
                self.keep(self.kind, self.text)
            self.text, self.kind = [], "heading" if tag in HEADINGS else "block"
        if tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cell = []
        elif tag == "figcaption":
            self.caption = []
        if self.summary is None and names & {".abstract", "@description"}:
            self.summary = [tag, []]
        self.open.append((tag, names))

    def handle_endtag(self, tag):
        if tag in HEADINGS | BLOCKS and self.text is not None:
            self.keep(self.kind, self.text)
            self.text = None
        elif tag in ("td", "th") and self.cell is not None:
            self.cells.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.cells is not None:
            if self.cells:
                self.rows.append(" | ".join(self.cells))
            self.cells = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows = self.rows, None
            if rows and not self.inside(*SKIP, ".ads", ".sidebar"):
                for roots in ROOTS:
                    if roots == ("body",) or self.inside(*roots):
                        self.blocks.setdefault(str(roots), []).append(("block", "\n".join(rows)))
        elif tag == "figcaption" and self.caption is not None:
            if self.images and self.images[-1][2] is None:
                self.images[-1][2] = " ".join("".join(self.caption).split())
            self.caption = None
        if isinstance(self.summary, list) and self.summary[0] == tag:
            found = " ".join("".join(self.summary[1]).split())
            self.summary = found if len(found) >= 80 else None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.inside("script", "style"):
            return
        for target in (self.cell, self.text, self.caption, self.summary[1] if isinstance(self.summary, list) else None):
            if target is not None:
                target.append(data)

    def finished(self, html: str | None):
        self.feed(html or "")
        self.close()
        if self.text is not None:
            self.keep(self.kind, self.text)
        return self

    def content(self) -> list[tuple[str, str]]:
        return next((self.blocks[str(r)] for r in ROOTS if str(r) in self.blocks), [])


def chunks_of(html: str | None, per_chunk: int = 5) -> Iterator[tuple[str | None, str]]:
    """(section, text) of each chunk: the abstract first, then the content; a heading opens a chunk, and one closes after so many blocks."""
    page = _Page().finished(html)
    abstract = page.summary if isinstance(page.summary, str) else page.abstract
    if abstract:
        yield "Abstract", abstract
    section, held = None, []
    for kind, line in [*page.content(), ("heading", None)]:
        if held and (kind == "heading" or len(held) == per_chunk):
            yield section, "\n".join(held)
            held = []
        if kind == "heading":
            section = line
        elif line != abstract:
            held.append(line)


def page_chunks(pages: DataFrame, per_chunk: int = 5) -> DataFrame:
    """Chunks of each page (page_id, html): page_id, chunk_index, section_title, text (see ``chunks_of``)."""

    def run(batches):
        for batch in batches:
            out = [(page, i, section, text) for page, html in zip(batch.page_id, batch.html, strict=True) for i, (section, text) in enumerate(chunks_of(html, per_chunk))]
            yield pd.DataFrame(out, columns=["page_id", "chunk_index", "section_title", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, chunk_index int, section_title string, text string")


def page_images(pages: DataFrame) -> DataFrame:
    """Images of each page (page_id, url, html), icons under 100 pixels aside: page_id, image_url, caption, image_type."""

    def run(batches):
        for batch in batches:
            out = [(page, urljoin(url or "", src), caption or alt, f"{alt} {caption or ''}") for page, url, html in zip(batch.page_id, batch.url, batch.html, strict=True) for src, alt, caption in _Page().finished(html).images]
            yield pd.DataFrame(out, columns=["page_id", "image_url", "caption", "told"])

    found = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, image_url string, caption string, told string")
    return found.select("page_id", "image_url", "caption", T.image_type(F.col("told")).alias("image_type"))
