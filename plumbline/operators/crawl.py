"""Crawling listing pages by rounds that are written, the cache of link lists, and enrichment a page of links at a time.

A crawl's state is a table of rounds: round k has a row for each url that changed in it, and a url's state is its row of the
last round that has one. A round is worked out from the rounds before it alone and counts once it is written
whole; a crawl that was lost goes on behind the last whole round, and asks for no page of a whole round again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import cache_key
from ..sources.fetch import Fetcher
from ..sources.tables import Files, VersionedTable
from .links import authority, extract_links

PRODUCT = r"/(product|products|item|p)/"
STATE = "catalog string, url string, depth int, attempts int, outcome string, error string"
DUE, FETCHED, FAILED = "due", "fetched", "failed"


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


@dataclass
class Crawl:
    """A crawl of catalogues under `root`; the same root goes on where a run before it ended.

    fetch gives (url, html, error) for urls. Pages up to `depth` steps from a catalogue's own are asked for, `pages` of them
    a catalogue (by depth, then url: the crawl's own bound), each up to `attempts` times. Links are followed on the catalogue's authority, if their path
    begins with the catalogue's or the link matches `product`.
    """

    spark: SparkSession
    root: str
    fetch: Fetcher
    product: str = PRODUCT
    depth: int = 2
    pages: int = 20
    attempts: int = 2

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")
        self.files = Files(self.spark, self.root)

    def whole(self) -> int:
        """Rounds that are written whole; a round counts only if all before it do."""
        k = 0
        while self.files.exists(f"rounds/{k}/_SUCCESS"):
            k += 1
        return k

    def _rounds(self, what: str, schema: str, first: int, upto: int) -> DataFrame:
        rows = self.spark.createDataFrame([], f"{schema}, round int")
        names = rows.columns[:-1]
        for k in range(first, upto):
            rows = rows.unionByName(self.spark.read.schema(self.spark.createDataFrame([], schema).schema).parquet(f"{self.root}/{what}/{k}").select(*names, F.lit(k).alias("round")))
        return rows

    def state(self) -> DataFrame:
        """(catalog, url, depth, attempts, outcome, error) of every url that the crawl knows."""
        last = self._rounds("rounds", STATE, 0, self.whole()).groupBy("catalog", "url").agg(F.max_by(F.struct("depth", "attempts", "outcome", "error"), "round").alias("s"))
        return last.select("catalog", "url", "s.*")

    def fetched(self) -> DataFrame:
        """(url, html, round) of every page that whole rounds brought."""
        return self._rounds("pages", "url string, html string, error string", 1, self.whole()).filter("html is not null").select("url", "html", "round")

    def links(self) -> DataFrame:
        """(catalog, page, pos, link) of every link of a catalogue's pages on its authority."""
        read = self.state().filter(F.col("outcome") == FETCHED).select("catalog", "url", "depth")
        once = self.fetched().groupBy("url").agg(F.max_by("html", "round").alias("html"))
        found = extract_links(read.join(once, "url").withColumn("page", F.struct("catalog", "depth")), "page")
        own = authority(F.col("link")) == authority(F.col("page.catalog"))
        return found.filter(own).select("page.catalog", F.col("page.depth").alias("depth"), F.col("url").alias("page"), "pos", "link")

    def advance(self, catalogs: DataFrame) -> bool:
        """Works out and writes the next round; false if there was none to do."""
        k = self.whole()
        if k == 0:
            seeds = catalogs.select(F.col("url").alias("catalog"), "url").filter("url is not null").distinct()
            self._write(seeds.select("catalog", "url", F.lit(0).alias("depth"), F.lit(0).alias("attempts"), F.lit(DUE).alias("outcome"), F.lit(None).cast("string").alias("error")), 0)
            return True
        state = self.state()
        tried = state.groupBy("catalog").agg(F.count_if(F.col("attempts") > 0).alias("tried"))
        due = state.filter((F.col("outcome") == DUE) & (F.col("attempts") == 0)).withColumn("rank", F.row_number().over(Window.partitionBy("catalog").orderBy("depth", "url"))).filter(F.col("rank") <= self.pages)
        fresh = due.join(tried, "catalog").filter(F.col("rank") + F.col("tried") <= self.pages).select(*state.columns)
        asked = fresh.unionByName(state.filter((F.col("outcome") == DUE) & (F.col("attempts") > 0)))
        if asked.isEmpty():
            return False
        brought = self.fetch(asked.select("url").distinct()).select("url", "html", "error")
        brought.write.mode("overwrite").parquet(f"{self.root}/pages/{k}")
        brought = self.spark.read.schema(brought.schema).parquet(f"{self.root}/pages/{k}")
        joined = asked.drop("error").join(brought, "url", "left")
        tries = F.col("attempts") + 1
        outcome = F.when(F.col("html").isNotNull(), FETCHED).when(tries < self.attempts, DUE).otherwise(FAILED)
        done = joined.select("catalog", "url", "depth", tries.alias("attempts"), outcome.alias("outcome"), F.when(F.col("html").isNull(), F.coalesce("error", F.lit("no answer"))).alias("error"))
        near = joined.filter(F.col("html").isNotNull() & (F.col("depth") < self.depth)).withColumn("page", F.struct("catalog", "depth"))
        found = extract_links(near.select("page", "url", "html"), "page")
        catalog = F.col("page.catalog")
        follow = (authority(F.col("link")) == authority(catalog)) & (F.col("link").rlike(self.product) | F.startswith(path_of(F.col("link")), path_of(catalog)))
        new = found.filter(follow).groupBy(catalog.alias("catalog"), F.col("link").alias("url")).agg((F.min("page.depth") + 1).alias("depth"))
        new = new.join(state.select("catalog", "url"), ["catalog", "url"], "left_anti")
        self._write(done.unionByName(new.select("catalog", "url", "depth", F.lit(0).alias("attempts"), F.lit(DUE).alias("outcome"), F.lit(None).cast("string").alias("error"))), k)
        return True

    def _write(self, rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/rounds/{k}")

    def run(self, catalogs: DataFrame) -> DataFrame:
        """All rounds to the end; the state. catalogs (url) count in the first round only; null urls are left out, equal ones are one."""
        while self.advance(catalogs):
            pass
        return self.state()

    def product_links(self) -> DataFrame:
        """(catalog, links): each catalogue's distinct links that match `product`, in the order in which its pages (by depth, url) have them."""
        first = self.links().filter(F.col("link").rlike(self.product)).groupBy("catalog", "link").agg(F.min(F.struct("depth", "page", "pos")).alias("place"))
        return first.groupBy("catalog").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "link"))), lambda x: x["link"]).alias("links"))


LISTS = "key string, links array<string>"


def discover(catalogs: DataFrame, cache_path: str, crawl: Callable[[], Crawl]) -> DataFrame:
    """(catalog, links) of all catalogues (url): lists that the cache has, and one crawl of all others, whose lists are added to it.

    A catalogue whose own page failed has no list in the cache and is crawled again the next time; one without product links has an
    empty list, which is kept.
    """
    spark = catalogs.sparkSession
    cache = VersionedTable(spark, cache_path, LISTS)
    keyed = catalogs.select(F.col("url").alias("catalog")).filter("catalog is not null").distinct().withColumn("key", cache_key(F.col("catalog")))
    missing = keyed.join(cache.read(), "key", "left_anti").select(F.col("catalog").alias("url"))
    if not missing.isEmpty():
        work = crawl()
        state = work.run(missing)
        read = state.filter((F.col("outcome") == FETCHED) & (F.col("url") == F.col("catalog"))).select("catalog")
        lists = read.join(work.product_links(), "catalog", "left").select(cache_key(F.col("catalog")).alias("key"), F.coalesce("links", F.array().cast("array<string>")).alias("links"))
        cache.append(lists)
    return keyed.join(cache.read(), "key", "left").select("catalog", F.coalesce("links", F.array().cast("array<string>")).alias("links"))


def enrich(lists: DataFrame, fetch: Fetcher, extract: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], limit: int = 5, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(items, summary) of the links [offset, offset + limit) of each list (catalog, links).

    extract gives (url, product_name, error, ...) for pages (url, html), a row for each. items: (catalog, pos, link, enriched, error, and
    what extract gives but url and error): a link whose page could not be fetched, or gave no record, is a row with its error and
    sinks no other. summary: (catalog, total_discovered, enriched, failed_urls in order, offset, has_more), a row for
    each list, empty ones too. A link of several catalogues is fetched once. `keep` writes a table and reads it back.
    """
    wanted = lists.select("catalog", F.posexplode(F.slice("links", offset + 1, limit)).alias("k", "link")).withColumn("pos", F.col("k") + offset)
    fetched = keep(fetch(wanted.select(F.col("link").alias("url")).distinct()).select("url", "html", "error"))
    records = extract(fetched.filter("html is not null").select("url", "html"))
    found = fetched.select("url", F.col("error").alias("fetch_error"), F.col("html").isNotNull().alias("had")).join(records, "url", "left")
    joined = wanted.select("catalog", "pos", "link").join(found.withColumnRenamed("url", "link"), "link", "left")
    enriched = F.coalesce("had", F.lit(False)) & F.col("product_name").isNotNull() & F.col("error").isNull()
    error = F.when(~enriched, F.coalesce("error", "fetch_error", F.when(F.col("had"), "no record"), F.lit("no answer")))
    more = [c for c in records.columns if c not in ("url", "error")]
    items = keep(joined.select("catalog", "pos", "link", enriched.alias("enriched"), error.alias("error"), *more))
    failed = F.transform(F.array_sort(F.collect_list(F.when(~F.col("enriched"), F.struct("pos", "link")))), lambda x: x["link"])
    counts = items.groupBy("catalog").agg(F.count_if("enriched").alias("enriched"), failed.alias("failed_urls"))
    total = F.size("links").cast("long")
    summary = lists.join(counts, "catalog", "left").select(
        "catalog", total.alias("total_discovered"), F.coalesce("enriched", F.lit(0).cast("long")).alias("enriched"), F.coalesce("failed_urls", F.array().cast("array<string>")).alias("failed_urls"), F.lit(offset).alias("offset"), (F.lit(offset + limit) < total).alias("has_more")
    )
    return items, summary
