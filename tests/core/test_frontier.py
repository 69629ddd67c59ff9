"""Crawls against a plain queue, and sitemaps."""

import random
import re

import pytest

from skein.sources import frontier, pages


def plain_crawl(links, known, seeds, max_depth, per_host, total):
    """One address after another, as a queue gives them."""
    out, hosts, visits = {}, {}, 0
    level = [(None, url) for url, _ in sorted(set(seeds), key=lambda s: (s[1], s[0])) if url is not None]
    for depth in range(max_depth + 1):
        reached = []
        for parent, url in level:
            if url is None or url in out:
                continue
            host = re.match(r"https?://([^/]*)", url)[1]
            if url not in known:
                outcome = "missing"
            elif visits >= total:
                outcome = "budget"
            elif hosts.get(host, 0) >= per_host:
                outcome = "host_quota"
            else:
                outcome = "visited"
                hosts[host] = hosts.get(host, 0) + 1
                reached.append(url)
            out[url] = (depth, visits if outcome == "visited" else None, parent, outcome)
            visits += outcome == "visited"
        level = [(u, t) for u in reached for _, t in sorted((o, t) for f, o, t in links if f == u and t is not None)]
    return out


@pytest.mark.parametrize(("per_host", "total", "max_depth"), [(4, 1000, 6), (100, 25, 6), (3, 30, 2), (0, 5, 3)])
def test_crawl_equals_a_plain_queue(spark, per_host, total, max_depth):
    rng = random.Random(per_host * 7 + total)
    urls = [f"https://{'hot' if k % 3 else f'h{k % 5}'}.example.com/{k}" for k in range(90)]
    links = [(rng.choice(urls), k, rng.choice([*urls, "https://gone.example.net/x", None])) for k in range(260)]
    links += links[:5] + [(None, 1, urls[0]), (urls[0], 900, urls[0])]
    seeds = [(urls[3], 1), (urls[4], 0), (urls[3], 5), ("https://gone.example.net/y", 2), (None, 3)]
    seeds = [s for s in seeds if s != (urls[3], 5)] + [(urls[3], 5)]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    found = frontier.crawl(
        make(links, "url string, ordinal long, target string"), make([(u,) for u in [*urls, urls[0]]], "url string"), make(seeds, "url string, ordinal long"),
        max_depth=max_depth, per_host=per_host, total=total,
    )
    got = {r["url"]: tuple(r)[1:] for r in found.collect()}
    assert len(got) == found.count()
    assert got == plain_crawl(links, set(urls), [s for s in seeds if s != (urls[3], 5)], max_depth, per_host, total)


def test_pages_that_share_an_address_are_visited_each(spark):
    at = "https://a.example.com/"
    known = [(at,), (at,), (f"{at}b",), (f"{at}b",), (f"{at}c",), ("https://b.example.com/d",), ("https://b.example.com/d",)]
    links = [(at, 0, f"{at}b"), (at, 1, f"{at}c"), (at, 2, "https://b.example.com/d"), (at, 3, "https://gone.example.net/x")]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    tables = make(links, "url string, ordinal long, target string"), make(known, "url string"), make([(at, 0)], "url string, ordinal long")
    found = frontier.crawl(*tables, per_host=3, total=4, repeated=True)
    got = sorted(((r["url"], r["depth"], r["arrival"], r["outcome"]) for r in found.collect()), key=str)
    want = [
        (at, 0, 0, "visited"), (at, 0, 1, "visited"), (f"{at}b", 1, 2, "visited"), (f"{at}b", 1, None, "host_quota"), (f"{at}c", 1, None, "host_quota"),
        ("https://b.example.com/d", 1, 3, "visited"), ("https://b.example.com/d", 1, None, "budget"), ("https://gone.example.net/x", 1, None, "missing"),
    ]
    assert got == sorted(want, key=str)
    assert found.count() == len(want) and frontier.crawl(*tables).count() == 5


def test_page_crawl_equals_its_sql_where_addresses_repeat(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from skein.plans import catalog

    html = "".join(f'<a href="/l{k}">x</a>' for k in range(9))
    rows = [(k, f"https://h{k % 4}.example.com/{k % 28}{'#top' if k % 28 % 5 == 0 else ''}", html) for k in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    pages_ = duckdb.connect()
    pages_.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = pages_.execute(f"SELECT url, depth, arrival, parent, outcome FROM ({catalog.oracle_sql()['page_crawl']})").fetchall()
    got = [tuple(r) for r in catalog.queries()["page_crawl"](spark, str(tmp_path)).select("url", "depth", "arrival", "parent", "outcome").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > len({r[0] for r in got})


def test_crawl_without_seeds(spark):
    links = spark.createDataFrame([("https://a.example.com/", 0, "https://a.example.com/b")], "url string, ordinal long, target string")
    assert frontier.crawl(links, links.select("url"), links.select("url", "ordinal").limit(0)).count() == 0


def test_scripts_are_followed_through_their_references(spark):
    at = "https://cdn.example.com/js/"
    scripts = [(f"{at}a.js", 'import "./b.js"; import("./c.js?v=2")'), (f"{at}b.js", 'import x from "./d.js"'), (f"{at}c.js", ""), (f"{at}d.js", 'import "./a.js"'), (f"{at}e.js", "")]
    table = spark.createDataFrame(scripts, "url string, content string")
    met = pages.followed(table, table.filter("url LIKE '%a.js'").select("url"))
    assert {(r["url"][-4], r["depth"]) for r in met.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert pages.followed(table, table.filter("url LIKE '%a.js'").select("url"), max_depth=1).count() == 3


def test_sitemaps_and_robots(spark):
    body = "<urlset><url><loc>https://a.example.com/1</loc></url><url><loc> https://a.example.com/logo.png </loc></url><url><loc>https://b.example.com/2</loc></url><url><loc>https://a.example.com/1</loc></url></urlset>"
    maps = spark.createDataFrame([("https://a.example.com/", 0, body), ("https://a.example.com/", 1, "<loc>https://a.example.com/3</loc>")], "base string, ordinal long, body string")
    assert [(r["page"], r["nth"]) for r in pages.sitemap_pages(maps).orderBy("nth").collect()] == [("https://a.example.com/1", 1), ("https://a.example.com/3", 2)]
    assert pages.sitemap_pages(maps, limit=1).count() == 1
    robots = spark.createDataFrame([("https://a.example.com/", "User-agent: *\nSitemap: /s1.xml\nsitemap: /s2.xml\nSitemap: /s1.xml")], "base string, body string")
    assert [r["sitemap"] for r in pages.robots_sitemaps(robots).orderBy("ordinal").collect()] == ["/s1.xml", "/s2.xml"]
