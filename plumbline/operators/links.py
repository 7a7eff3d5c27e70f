"""Links of pages, product links of a crawl, paging, and the URL cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import cache_key
from ..sources.tables import VersionedTable

THIN_PAGE = 2000


def authority(url: Column) -> Column:
    """The network location, user and port included."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def absolute(base: Column, link: Column) -> Column:
    """A link against its page's URL: full ones as they are, rooted ones on its authority, others in its folder."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/)?)", 1)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), link))


def extract_links(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, url, pos, link) of each href in double quotes, in order."""
    found = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(page, "url", F.posexplode(found).alias("pos", "href")).select(page, "url", "pos", "href", absolute(F.col("url"), F.col("href")).alias("link"))


def product_links(links: DataFrame, pattern: str, page: str = "page_id") -> DataFrame:
    """Links on their page's own authority that match, each once: (link, first page, first pos, n_seen)."""
    own = links.filter((authority(F.col("link")) == authority(F.col("url"))) & F.col("link").rlike(pattern))
    return own.groupBy("link").agg(F.min(F.struct(page, "pos")).alias("f"), F.count(F.lit(1)).alias("n_seen")).select("link", F.col(f"f.{page}").alias("first_page"), F.col("f.pos").alias("first_pos"), "n_seen")


def crawl(links: DataFrame, seeds: DataFrame, depth: int = 2, most_pages: int = 20) -> DataFrame:
    """(seed, url, depth): pages within `depth` steps over links (url, link) of the seed's authority, the first `most_pages` of each seed.

    The page budget is the crawl's own feature, by depth and then url.
    """
    edges = links.filter(authority(F.col("link")) == authority(F.col("url"))).select("url", "link").distinct()
    found = seeds.select(F.col("url").alias("seed"), "url").withColumn("depth", F.lit(0))
    frontier = found
    for k in range(1, depth + 1):
        step = frontier.join(edges, "url").select("seed", F.col("link").alias("url"), F.lit(k).alias("depth")).distinct()
        frontier = step.join(found.select("seed", "url"), ["seed", "url"], "left_anti")
        found = found.unionByName(frontier)
    order = Window.partitionBy("seed").orderBy("depth", "url")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most_pages).drop("r")


def page_of(links: DataFrame, limit: int, offset: int, order: list[str]) -> tuple[DataFrame, Column]:
    """A page of links and whether more follow it (a Column over the table's count `total`)."""
    return links.orderBy(*order).offset(offset).limit(limit), F.lit(offset + limit) < F.col("total")


def is_thin(html: Column, status: Column | None = None) -> Column:
    thin = F.coalesce(F.length(html), F.lit(0)) < THIN_PAGE
    return thin if status is None else thin | (status >= 400)


def cache_split(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of wanted urls against a cache (key, html); an entry without html is a miss."""
    good = cache.filter("html is not null").select("key", "html")
    keyed = wanted.withColumn("key", cache_key(F.col("url")))
    return keyed.join(good, "key"), keyed.join(good, "key", "left_anti")


CACHE = "key string, html string"


def page_cache(spark: SparkSession, path: str) -> VersionedTable:
    """The cache of pages under a path: of each key the page that was committed first."""
    return VersionedTable(spark, path, CACHE)


def ingest_urls(wanted: DataFrame, cache_path: str, fetch, use_cache: bool = True) -> DataFrame:
    """(url, key, html) of all urls (url), from the cache where it has them; what `fetch` (urls -> url, html) brings is added to it.

    Runs may overlap: each stages what it fetched and commits it in one step, and all of them then have the page that was
    committed first. A url that could not be fetched has a null html and is asked for again the next time; so has a null url.
    A url that is asked for twice is fetched once and has two rows.
    """
    keyed = wanted.select("url", cache_key(F.col("url")).alias("key"))
    if not use_cache:
        fetched = fetch(wanted.select("url").filter("url is not null").distinct()).select("url", "html")
        return keyed.join(fetched, "url", "left").select("url", "key", "html")
    cache = page_cache(wanted.sparkSession, cache_path)
    _, misses = cache_split(wanted.select("url"), cache.read())
    fetched = fetch(misses.select("url").filter("url is not null").distinct())
    cache.append(fetched.filter("html is not null").select(cache_key(F.col("url")).alias("key"), "html"))
    return keyed.join(cache.read(), "key", "left").select("url", "key", "html")


def seed_cache(spark, url: str, html_path: str, cache_path: str) -> None:
    """Puts a local page's text in the cache under a url that it does not have yet."""
    page = spark.read.text(html_path, wholetext=True)
    page_cache(spark, cache_path).append(page.select(cache_key(F.lit(url)).alias("key"), F.col("value").alias("html")))
