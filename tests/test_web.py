"""Fetching with a fall-back, the versioned cache, crawls that go on after a loss, and enrichment."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import crawl, links
from plumbline.sources import fetch
from plumbline.sources.tables import VersionedTable, scratch_dir

LONG = "x" * 2500


def keeper(spark):
    def keep(df):
        at = scratch_dir(spark, "test")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return keep


def test_static_first_then_rendered_row_by_row(spark):
    served = {"http://a/1": (200, LONG), "http://a/2": (200, "thin"), "http://b/3": (404, LONG), "http://b/4": (200, "short"), "http://c/5": (200, "y" * 2000)}
    shown = {"http://a/2": (200, "tiny but drawn"), "http://b/3": (200, LONG), "http://b/4": (200, ""), "http://d/7": (500, LONG)}
    asked = spark.sparkContext.accumulator(0)

    class Site:
        """Pages by url; others are refused."""

        def __init__(self, pages, count=0):
            self.pages, self.count = pages, count

        def get(self, url):
            if self.count:
                asked.add(self.count)
            if url not in self.pages:
                raise fetch.FetchError("refused", 403)
            return self.pages[url]

    run = fetch.with_fallback(fetch.by_client(lambda: Site(served)), fetch.by_client(lambda: Site(shown, 1)), keeper(spark))
    urls = spark.createDataFrame([(u,) for u in [*served, *served, "http://d/6", "http://d/7", None]], "url string")
    got = {r.url: (r.method, r.status, r.error, len(r.html) if r.html is not None else None) for r in run(urls).collect()}
    assert got == {
        "http://a/1": ("static", 200, None, 2500), "http://c/5": ("static", 200, None, 2000), "http://a/2": ("rendered", 200, None, 14), "http://b/3": ("rendered", 200, None, 2500),
        "http://b/4": (None, 200, "static: thin page of 5 characters; rendered: no content", None), "http://d/6": (None, 403, "static: refused; rendered: refused", None),
        "http://d/7": (None, 500, "static: refused; rendered: status 500", None),
    }
    assert asked.value == 5
    alone = fetch.with_fallback(fetch.by_client(lambda: Site(served)), None, keeper(spark))
    assert {r.url: r.error for r in alone(urls).collect() if r.method is None}["http://b/3"] == "static: status 404; no renderer"
    assert run(urls.limit(0)).collect() == []


def test_a_hot_host_is_many_streams(spark):
    urls = spark.range(3000).select(F.concat(F.lit("http://hot.example/"), "id").alias("url")).unionByName(spark.range(30).select(F.concat(F.lit("http://h"), "id", F.lit(".example/")).alias("url")))
    rows = fetch.deal(urls, streams=6, per_stream=500, tasks=40).select("url", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == 3030
    hot = Counter(r.p for r in rows if "hot" in r.url)
    assert 3 <= len(hot) <= 6 and max(hot.values()) < 1500


def table(spark, path):
    return VersionedTable(spark, str(path), "key string, html string", buckets=4)


def test_interleaved_runs_agree_on_the_first_commit(spark, tmp_path):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    rows = lambda who, keys: spark.createDataFrame([(k, f"{who} {k}") for k in keys], "key string, html string")
    assert one.read().collect() == []
    a, b = one.stage(rows("one", "abc")), two.stage(rows("two", "bcd"))
    lost = one.stage(rows("lost", "abcde"))
    assert one.read().collect() == [] and (two.commit(b), one.commit(a)) == (0, 1)
    want = {"a": "one a", "b": "two b", "c": "two c", "d": "two d"}
    for reader in (one, two, table(spark, tmp_path)):
        assert sorted(map(tuple, reader.read().collect())) == sorted(want.items())
    two.files.create("commits/000000000002", "")  # a driver that died between making its commit and filling it
    assert [n for n, _ in one.versions(patience=0)] == [0, 1] and lost not in [name for _, name in one.versions(patience=0)]
    later = table(spark, tmp_path)
    later.versions = lambda patience=0: VersionedTable.versions(later, 0)
    assert later.append(rows("late", "ae")) == 3 and {r.key: r.html for r in later.read().collect()} == want | {"e": "late e"}
    assert later.compact() == 4 and {r.key: r.html for r in later.read().collect()} == want | {"e": "late e"}
    assert not one.files.create("commits/000000000004", "x" * 32)


def test_overlapping_ingests_give_one_page_a_key(spark, tmp_path):
    """Both runs saw an empty cache; the second's own pages give way to the first's."""
    wanted = spark.createDataFrame([("http://a/1",), ("http://a/2",), ("http://a/2",), (None,)], "url string")
    path = str(tmp_path / "cache")

    def slow(urls):
        links.ingest_urls(wanted, path, lambda u: u.withColumn("html", F.concat(F.lit("quick "), "url"))).collect()
        return urls.withColumn("html", F.concat(F.lit("slow "), "url"))

    got = [(r.url, r.html) for r in links.ingest_urls(wanted, path, slow).collect()]
    assert sorted(got, key=str) == sorted([("http://a/1", "quick http://a/1"), ("http://a/2", "quick http://a/2"), ("http://a/2", "quick http://a/2"), (None, None)], key=str)
    assert links.page_cache(spark, path).read().count() == 2


def test_seeded_page_is_not_replaced(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>seed")
    for _ in range(2):
        links.seed_cache(spark, "http://a/", str(tmp_path / "p.html"), str(tmp_path / "cache"))
    wanted = spark.createDataFrame([("http://a/",)], "url string")
    assert [r.html for r in links.ingest_urls(wanted, str(tmp_path / "cache"), None or (lambda u: u.withColumn("html", F.lit("new")))).collect()] == ["<p>seed"]


def page(*hrefs):
    return LONG + "".join(f'<a href="{h}">x</a>' for h in hrefs)


WEB = {
    "http://s/list": page("/list/2", "/p/1", "/p/2", "/about", "http://t/p/9"),
    "http://s/list/2": page("/p/3", "/p/1", "/list/3"),
    "http://s/list/3": page("/p/4"),
    "http://s/p/1": page("/p/5"), "http://s/p/3": page(), "http://s/p/5": page("/p/6"),
    "http://t/": page("/p/9", "/x"), "http://t/p/9": page(),
}


class Web:
    """A fetcher over WEB that counts what it is asked for and can break down."""

    def __init__(self, spark, breaks=()):
        self.spark, self.asked, self.breaks, self.calls = spark, Counter(), set(breaks), 0

    def __call__(self, urls):
        self.calls += 1
        if self.calls in self.breaks:
            raise RuntimeError("lost")
        self.asked.update(r.url for r in urls.collect())
        rows = [(u, WEB.get(u)) for u in self.asked]
        return urls.join(self.spark.createDataFrame(rows, "url string, html string"), "url", "left").withColumn("error", F.when(F.col("html").isNull(), "status 404"))


def start(spark, root, web, **more):
    return crawl.Crawl(spark, str(root), web, product=r"/p/", **more)


def seeds(spark):
    return spark.createDataFrame([("http://s/list",), ("http://t/",), ("http://u/gone",), ("http://t/",), (None,)], "url string")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_crawl_states(spark, tmp_path):
    web = Web(spark)
    state = {(r.catalog, r.url): (r.depth, r.attempts, r.outcome) for r in start(spark, tmp_path, web).run(seeds(spark)).collect()}
    s, t = "http://s/list", "http://t/"
    assert state == {
        (s, s): (0, 1, "fetched"), (s, "http://s/list/2"): (1, 1, "fetched"), (s, "http://s/p/1"): (1, 1, "fetched"), (s, "http://s/p/2"): (1, 2, "failed"),
        (s, "http://s/p/3"): (2, 1, "fetched"), (s, "http://s/list/3"): (2, 1, "fetched"), (s, "http://s/p/5"): (2, 1, "fetched"),
        (t, t): (0, 1, "fetched"), (t, "http://t/p/9"): (1, 1, "fetched"), (t, "http://t/x"): (1, 2, "failed"), ("http://u/gone", "http://u/gone"): (0, 2, "failed"),
    }
    assert web.asked["http://s/list"] == 1 and web.asked["http://s/p/2"] == 2


@pytest.mark.parametrize("lost", [1, 2, 3])
def test_crawl_goes_on_after_a_loss(spark, tmp_path, lost):
    """A run breaks down in a round; the next, with another driver's objects, ends in the same state and asks for no page again that a whole round has."""
    whole = rows(start(spark, tmp_path / "whole", Web(spark)).run(seeds(spark)))
    web = Web(spark, breaks=[lost])
    with pytest.raises(RuntimeError):
        start(spark, tmp_path / "lost", web).run(seeds(spark))
    before = start(spark, tmp_path / "lost", web)
    half = tmp_path / "lost" / "rounds" / str(before.whole())
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_text("half a file")
    assert rows(before.run(seeds(spark))) == whole
    assert all(n == (2 if u not in WEB else 1) for u, n in web.asked.items())


def test_page_budget_of_each_catalogue(spark, tmp_path):
    state = start(spark, tmp_path, Web(spark), pages=3).run(seeds(spark))
    tried = {r.catalog: r.n for r in state.filter("attempts > 0").groupBy("catalog").agg(F.count("*").alias("n")).collect()}
    assert tried == {"http://s/list": 3, "http://t/": 3, "http://u/gone": 1}
    # known, and beyond the budget
    assert {r.url for r in state.filter("outcome = 'due'").collect()} == {"http://s/p/2", "http://s/p/3", "http://s/p/5", "http://s/list/3"}


def test_lists_are_kept_and_enriched_by_pages(spark, tmp_path):
    web = Web(spark)
    found = crawl.discover(seeds(spark), str(tmp_path / "lists"), lambda: start(spark, tmp_path / "crawl", web))
    lists = {r.catalog: r.links for r in found.collect()}
    assert lists == {"http://s/list": [f"http://s/p/{k}" for k in (1, 2, 3, 5, 4, 6)], "http://t/": ["http://t/p/9"], "http://u/gone": []}
    calls = web.calls
    again = crawl.discover(seeds(spark).filter("url <> 'http://u/gone'"), str(tmp_path / "lists"), lambda: pytest.fail("the lists are kept"))
    assert {r.catalog: r.links for r in again.collect()} == {k: v for k, v in lists.items() if v} and web.calls == calls

    extract = lambda pages: pages.select("url", F.when(~F.col("url").endswith("/3"), F.concat(F.lit("Product of "), "url")).alias("product_name"), F.when(F.col("url").endswith("/5"), "bad answer").alias("error"))
    items, summary = crawl.enrich(found, web, extract, keeper(spark), limit=4, offset=1)
    assert rows(items.select("pos", "link", "enriched", "error")) == [(1, "http://s/p/2", False, "status 404"), (2, "http://s/p/3", False, "no record"), (3, "http://s/p/5", False, "bad answer"), (4, "http://s/p/4", False, "status 404")]
    assert rows(summary) == [("http://s/list", 6, 0, [f"http://s/p/{k}" for k in (2, 3, 5, 4)], 1, True), ("http://t/", 1, 0, [], 1, False), ("http://u/gone", 0, 0, [], 1, False)]
    first, summary = crawl.enrich(found, web, extract, keeper(spark), limit=5)
    assert {r.catalog: (r.enriched, r.has_more) for r in summary.collect()} == {"http://s/list": (1, True), "http://t/": (1, False), "http://u/gone": (0, False)}
    assert {r.link: r.product_name for r in first.filter("enriched").collect()} == {u: f"Product of {u}" for u in ("http://s/p/1", "http://t/p/9")}


def repeated(spark, tmp_path):
    """Pages of which two and three share a url; of the urls one is up by its second page only, one is down. No two links of a url share a place."""
    anchors = lambda hrefs: LONG + "".join(f'<a href="{h}">x</a>' for h in hrefs)
    rows = [
        (0, "http://s/a", anchors(["/Aaa", "/Bbb", "/Ccc"])), (3, "http://s/a", anchors(["/Aaa", "/x", "/y", "/Ddd"])), (6, "http://s/a", "short"),  # 3 is down, 6 is thin
        (13, "http://s/b", anchors(["/Aab"])), (1, "http://s/b", "thin"), (4, "http://s/c", anchors(["/Bbe", "/c/1"])), (9, "http://s/c", "<h1>short</h1>"), (12, "http://s/d", "<h1>D</h1>" + LONG),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["q_fetch_pages", "q_cache_miss", "q_crawl_state", "q_enrichment"])
def test_pages_that_share_a_url(spark, tmp_path, name):
    """The rows of the SQL, as many times as it has them."""
    import duckdb

    from plumbline.plans import registry

    at = repeated(spark, tmp_path)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{at}/pages.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, at).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
