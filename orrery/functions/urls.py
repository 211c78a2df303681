"""URL expressions, and the HTML parser as an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

AUTHORITY = r"^[^:/?#]+://([^/?#]*)"
PAGE = StructType([StructField(n, StringType()) for n in ("title", "text", "snippet")] + [StructField("links", ArrayType(StringType()))])


def netloc(u: Column) -> Column:
    """Host with port and user, as it stands; empty if there is none."""
    return F.regexp_extract(F.coalesce(u, F.lit("")), AUTHORITY, 1)


def domain_of(u: Column) -> Column:
    return F.coalesce(F.nullif(netloc(u), F.lit("")), F.lit("unknown"))


def normalise(u: Column) -> Column:
    """Scheme and host lower-cased, no trailing slash, parameters, query or fragment; an empty path is a slash."""
    c = F.trim(u)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), ";[^/]*$", ""), "/+$", "")
    return F.concat(F.lower(F.regexp_extract(c, r"^([^:/?#]+)://", 1)), F.lit("://"), F.lower(netloc(c)), F.when(path == "", "/").otherwise(path))


def in_domains(u: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or lies below one."""
    host = F.lower(netloc(u))
    found = F.lit(False)
    for d in domains:
        found = found | (host == d) | host.endswith("." + d)
    return found


def same_domain(a: Column, b: Column) -> Column:
    return netloc(a) == netloc(b)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.paragraphs, self.hrefs = None, [], [], []
        self.hidden = self.in_title = 0
        self.open_p: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        elif tag == "title":
            self.in_title += 1
        elif tag == "p":
            self._close_p()
            self.open_p.append([])
        elif tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                self.hrefs.append(href)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = max(0, self.in_title - 1)
        elif tag in ("p", "article", "div", "body"):
            self._close_p()

    def _close_p(self):
        while self.open_p:
            self.paragraphs.append(" ".join(self.open_p.pop()).strip())

    def handle_data(self, data):
        if self.hidden:
            return
        if self.in_title and self.title is None:
            self.title = data.strip()
        self.parts.append(data)
        for p in self.open_p:
            p.append(data)


def parse(html: str | None, base: str | None) -> tuple[str, str, str, list[str]]:
    """Title, visible text, snippet (first paragraph of over 80 characters, else the text; at most 600) and absolute links."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page._close_p()
    text = " ".join(" ".join(page.parts).split())
    snippet = next((p[:600] for p in page.paragraphs if len(p) > 80), text[:600])
    links = []
    for href in page.hrefs:
        try:
            absolute = urljoin(base or "", href.strip())
            if urlparse(absolute).scheme in ("http", "https"):
                links.append(absolute.split("#")[0])
        except ValueError:
            continue
    return page.title or "No title", text, snippet, links


#: Bytes of HTML that are parsed before their results leave Python's heap.
PARSED_BYTES = 1 << 20
_PAGE = pa.struct([(n, pa.string()) for n in ("title", "text", "snippet")] + [("links", pa.list_(pa.string()))])


def _parsed(html: pa.Array, base: pa.Array) -> Iterator[pa.Array]:
    """Structs of parse(), some rows at a time: neither pages nor results are ever all Python strings at once."""
    rows, size = [], 0
    for h, b in zip(html, base):
        rows.append(dict(zip(("title", "text", "snippet", "links"), parse(h.as_py(), b.as_py()))))
        size += len(h.as_buffer() or b"") if h.is_valid else 0
        if size > PARSED_BYTES:
            yield pa.array(rows, _PAGE)
            rows, size = [], 0
    yield pa.array(rows, _PAGE)


@F.arrow_udf(PAGE)
def parse_page(html: pa.Array, base: pa.Array) -> pa.Array:
    return pa.concat_arrays(list(_parsed(html, base)))


def parse_pages(pages: DataFrame, html: str, base: str) -> DataFrame:
    """pages with text, snippet and links in the place of html; results go on by the piece, so none but these is held beside a batch of pages."""
    kept = [c for c in pages.columns if c != html]
    schema = StructType([*pages.select(*kept).schema.fields, *[f for f in PAGE.fields if f.name != "title"]])

    def run(batches):
        for batch in batches:
            at = 0
            for found in _parsed(batch.column(html), batch.column(base)):
                if len(found):
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(found)) for c in kept], *[found.field(n) for n in ("text", "snippet", "links")]], schema.names)
                at += len(found)
            # The next batch comes while this name would still hold the last.
            del batch

    return pages.mapInArrow(run, schema)


#: Unicode's space separators, which DuckDB's trim takes from both ends; Spark's takes the plain space alone.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def title_of(html: Column) -> Column:
    """The title without leaving the JVM: first title element, common entities resolved, no spaces of any kind around it."""
    raw = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return F.coalesce(F.nullif(F.trim(raw, F.lit(SPACES)), F.lit("")), F.lit("No title"))


def robots_allowed(url: Column, rules: Column, always: Column) -> Column:
    """Whether robots rules let any agent fetch the URL; no rules, or a domain that is always allowed, mean yes."""

    @F.pandas_udf(BooleanType())
    def check(urls: pd.Series, texts: pd.Series, free: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for u, t, f in zip(urls, texts, free):
            if f or not t:
                out.append(True)
                continue
            if t not in parsers:
                parsers[t] = RobotFileParser()
                parsers[t].parse(t.splitlines())
            out.append(parsers[t].can_fetch("*", u or ""))
        return pd.Series(out, dtype=bool)

    return check(url, rules, always)


@F.pandas_udf(DoubleType())
def crawl_delay(rules: pd.Series) -> pd.Series:
    """Seconds that robots rules ask of all agents; null if they don't."""
    out = []
    for text in rules:
        parser = RobotFileParser()
        parser.parse((text or "").splitlines())
        parser.modified()
        wait = parser.crawl_delay("*")
        out.append(float(wait) if wait else None)
    return pd.Series(out, dtype="float64")
