"""HTML pages, links and page rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPPED = ("script", "style", "nav", "footer", "header")


#: Elements without content, which are never open.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Text(HTMLParser):
    """Collects the text outside dropped elements. An element ends with its own end tag, or with that of an element around it where its own is missing."""

    def __init__(self, dropped: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.open, self.inside, self.parts = frozenset(dropped), [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
            self.inside += tag in self.dropped

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            closed = None
            while closed != tag:
                closed = self.open.pop()
                self.inside -= closed in self.dropped

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def page_text(html: str | None, dropped: Sequence[str] = DROPPED) -> str:
    parser = _Text(dropped)
    parser.feed(html or "")
    parser.close()
    return "\n".join(line for part in parser.parts for line in map(str.strip, part.split("\n")) if line)


def html_to_text(pages: DataFrame, key: str = "page_id", html: str = "html", dropped: Sequence[str] = DROPPED) -> DataFrame:
    """(key, text): the text outside the dropped elements, one trimmed line each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_text(h, dropped) for h in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    rows = pages.select(key, html)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")


def html_title(html: Column) -> Column:
    """The first h1, else the title, else "Unknown", without tags inside."""
    inside = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))
    h1, title = inside("h1"), inside("title")
    return F.when(h1 != "", h1).when(title != "", title).otherwise("Unknown")


LINK = r'(?is)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def extract_links(pages: DataFrame, key: str, html: str, base: Column, in_href: str = "standard", in_text: str = "fas") -> DataFrame:
    """(key, title, url): anchors whose address or text holds the wanted term; relative addresses become absolute."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), 1).alias("href"), F.regexp_extract_all(html, F.lit(LINK), 2).alias("title"))
    links = pages.select(key, base.alias("base"), F.explode(both).alias("a")).select(key, "base", "a.href", F.trim("a.title").alias("title"))
    links = links.where(F.lower("href").contains(in_href) | F.lower("title").contains(in_text))
    return links.select(key, "title", F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat("base", "href")).alias("url"))


def assemble_pages(rows: DataFrame, key: str, number: str, text: str, heading: bool = False) -> DataFrame:
    """One document per key: its pages that aren't blank, in order, with an optional heading each."""
    body = F.concat(F.lit("## Page "), F.col(number).cast("string"), F.lit("\n\n"), F.col(text)) if heading else F.col(text)
    pages = rows.where(F.trim(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), body.alias("t")))).alias("p"))
    return pages.select(key, F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


def decode_viewer_links(pages: DataFrame, key: str, html: str, parameter: str = "tnc_pvfw", number: str = r"(\d+)") -> DataFrame:
    """(key, file_url, language, file_name, std): links whose parameter is base64 of ``k=v&...``; those that don't decode are dropped."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(rf"{parameter}=([A-Za-z0-9+/_-]+=*)"), 1)).alias("pos", "code"))
    padded = F.rpad(F.regexp_replace("code", "=+$", ""), (F.ceil(F.length(F.regexp_replace("code", "=+$", "")) / 4) * 4).cast("int"), F.lit("="))
    plain = F.try_to_binary(padded, F.lit("base64")).cast("string")
    decoded = found.select(key, "pos", F.str_to_map(plain, F.lit("&"), F.lit("=")).alias("m"))
    decoded = decoded.select(key, "pos", F.try_url_decode(F.col("m")["file"]).alias("file_url"), F.col("m")["lang"].alias("language"))
    name = F.element_at(F.split("file_url", "/"), -1)
    out = decoded.where(F.col("file_url").isNotNull()).withColumn("file_name", name)
    return out.withColumn("std", F.regexp_extract("file_name", number, 1)).where("std <> ''")


def pivot_language_urls(links: DataFrame) -> DataFrame:
    """(std, en, ar): the last address of each language; ar falls back to en."""
    one = lambda code: F.max_by("file_url", F.when(F.col("language") == code, F.col("pos")))
    out = links.groupBy("std").agg(F.max_by(F.when(F.col("language") == "en", F.col("file_url")), F.when(F.col("language") == "en", F.col("pos"))).alias("en"), one("ar").alias("ar"))
    return out.select("std", "en", F.coalesce("ar", "en").alias("ar"))


def rewrite_link_language(url: Column, parameter: str = "tnc_pvfw") -> Column:
    """The Arabic address of an English one: inside the base64 parameter, else by the first path form that occurs; null if nothing changes."""
    code = F.regexp_extract(url, rf"{parameter}=([A-Za-z0-9+/=]+)", 1)
    inner = F.base64(F.regexp_replace(F.try_to_binary(code, F.lit("base64")).cast("string"), "lang=[a-z]+", "lang=ar").cast("binary"))
    out = F.when((code != "") & inner.isNotNull(), F.replace(url, code, inner))
    for a, b in (("/en-", "/ar-"), ("_en_", "_ar_"), ("_en.", "_ar."), ("/en/", "/ar/")):
        out = out.when(url.contains(a), F.replace(url, F.lit(a), F.lit(b)))
    return F.nullif(out, url)
