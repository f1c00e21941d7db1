"""Web pages: links, readable text, JSON-LD."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url

MAX_PAGE_CHARS = 20_000


def is_detail(url: Column) -> Column:
    """A link to one listing: a language and a number in the path, and no asset."""
    return url.rlike(r"/[a-z]{2}/\d+") & ~F.lower(url).rlike(r"\.(png|jpe?g|css|js|pdf)(\?|$)")


def in_domains(url: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of the domains or below one."""
    host = F.lower(F.regexp_extract(url, "://([^/?#:]*)", 1))
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def text_and_links(pages: DataFrame, dropped: tuple[str, ...] = ("script", "style")) -> DataFrame:
    """page_id, text (lines of visible text outside ``dropped``) and links (canonical, distinct, in order), by the standard library's parser."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self) -> None:
                super().__init__(convert_charrefs=True)
                self.skip, self.lines, self.links = 0, [], []

            def handle_starttag(self, tag: str, attrs: list) -> None:
                self.skip += tag in dropped
                if tag == "a" and (href := dict(attrs).get("href")):
                    self.links.append(href)

            def handle_endtag(self, tag: str) -> None:
                self.skip = max(0, self.skip - (tag in dropped))

            def handle_data(self, data: str) -> None:
                if not self.skip and data.strip():
                    self.lines.append(data.strip())

        for b in batches:
            texts, links = [], []
            for html in b["html"]:
                r = Reader()
                r.feed(html or "")
                r.close()
                texts.append("\n".join(r.lines))
                links.append(list(dict.fromkeys(r.links)))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "hrefs": links})

    d = pages.select("page_id", "url", "html").mapInPandas(parse, "page_id long, url string, text string, hrefs array<string>")
    base = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    full = F.transform("hrefs", lambda h: F.when(h.startswith("/"), F.concat(base, h)).otherwise(h))
    return d.select("page_id", "text", F.array_distinct(F.filter(F.transform(full, canonical_url), lambda x: x.isNotNull())).alias("links"))


def readable(pages: DataFrame) -> DataFrame:
    """page_id and the text outside what frames a page, its first MAX_PAGE_CHARS characters, which is the operator's rule."""
    return text_and_links(pages, ("script", "style", "noscript", "nav", "header", "footer", "svg")).select("page_id", F.left("text", F.lit(MAX_PAGE_CHARS)).alias("text"))


def json_ld(pages: DataFrame, kind: str) -> DataFrame:
    """page_id, name, price of the JSON-LD objects of a type, inside @graph too; the dearest offer is the price."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    schema = "`@type` string, name string, offers array<struct<price:string>>, `@graph` array<struct<`@type`:string,name:string,offers:array<struct<price:string>>>>"
    j = pages.select("page_id", F.explode(blocks).alias("raw")).withColumn("j", F.from_json("raw", schema))
    own = F.struct(F.col("j.`@type`").alias("@type"), F.col("j.name").alias("name"), F.col("j.offers").alias("offers"))
    each = j.select("page_id", F.explode(F.concat(F.array(own), F.coalesce(F.col("j.`@graph`"), F.array().cast("array<struct<`@type`:string,name:string,offers:array<struct<price:string>>>>")))).alias("o"))
    price = F.array_max(F.transform(F.col("o.offers"), lambda x: x["price"].try_cast("double")))
    return each.filter(F.col("o.`@type`") == kind).select("page_id", F.col("o.name").alias("name"), price.alias("price"))


def sitemap_urls(xml: Column, scope: str) -> Column:
    """array: the distinct addresses of a sitemap, or of an index of sitemaps, that match, in order."""
    locs = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1), lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")))
    return F.array_distinct(F.filter(locs, lambda x: F.regexp_like(x, F.lit(scope))))


def offer_price(offers: Column) -> Column:
    """struct amount, currency, is_free of offers (price, priceCurrency, category): the dearest, the first of equals; without
    any price a category "free" says 0; else null, as "partially free" is no price."""
    amount = lambda o: F.replace(F.trim(o["price"]), F.lit(","), F.lit("")).try_cast("double")
    priced = F.filter(offers, lambda o: amount(o).isNotNull())
    top = F.array_max(F.transform(priced, amount))
    first = F.get(F.filter(priced, lambda o: amount(o) == top), F.lit(0))
    free = F.exists(offers, lambda o: F.coalesce(F.lower(F.trim(o["category"])) == "free", F.lit(False)))
    stated = F.struct(top.alias("amount"), F.nullif(F.trim(first["priceCurrency"]), F.lit("")).alias("currency"), (top == 0).alias("is_free"))
    return F.when(F.size(priced) > 0, stated).when(free, F.struct(F.lit(0.0).alias("amount"), F.lit(None).cast("string").alias("currency"), F.lit(True).alias("is_free")))


def message_time(raw: Column) -> Column:
    """A message's ISO time; one that names no zone is in UTC, one that isn't a time is null."""
    t = F.trim(raw)
    return F.try_to_timestamp(F.when(F.regexp_like(t, F.lit(r"(Z|[+-]\d\d:?\d\d)$")), t).when(F.regexp_like(t, F.lit(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d")), F.concat(t, F.lit("Z"))))


def outbound_links(hrefs: Column) -> Column:
    """array: the absolute links, canonical, distinct, in order: the first is the one a message is about."""
    own = F.filter(F.transform(hrefs, F.trim), lambda x: x.startswith("http"))
    return F.array_distinct(F.filter(F.transform(own, canonical_url), lambda x: x.isNotNull()))
