"""The crawl against a plain queue a site, with limits, sitemaps, repeated and differently spelled links."""

import random

from pyspark.sql import functions as F

from millrace.operators import crawl, ids


def plain(pages, seeds, most, depth_most):
    """site -> rows (url, depth, place, state) of a first-in, first-out queue."""
    out = {}
    for site, first in seeds.items():
        queue, seen, documents, k = [], set(), 0, 0
        for url in first:
            if url.lower() not in seen:
                seen.add(url.lower())
                queue.append((url, 0))
        rows = {}
        while k < len(queue) and documents < most and k < 4 * most:
            url, depth = queue[k]
            k += 1
            utility, links = url.endswith("/sitemap.xml"), pages.get(url.lower())
            rows[url] = (depth, k, "not_found" if links is None else "utility" if utility else "document")
            documents += links is not None and not utility
            for path in (links or []) if depth < depth_most else []:
                target = site + path
                if target.lower() not in seen:
                    seen.add(target.lower())
                    queue.append((target, depth + 1))
        rows |= {url: (depth, None, "left") for url, depth in queue[k:]}
        out[site] = rows
    return out


def test_crawl_equals_a_queue(spark):
    rng = random.Random(3)
    pages, seeds, rows = {}, {}, []
    for s in range(8):
        # one site has most of the pages
        site, n = f"https://s{s}.example", 400 if s == 0 else rng.randint(1, 40)
        for i in range(n):
            links = [f"/{rng.choice(['P', 'p'])}{rng.randint(0, n + 10)}" for _ in range(rng.randint(0, 6))]
            pages[f"{site}/p{i}"] = links
            markup = "".join(f'<a href="{x}{rng.choice(["", "/", "?q=1", "#t"])}">l</a>' for x in links)
            rows.append((rng.choice([f"{site}/p{i}", f"https://www.{site[8:]}/p{i}/", f"{site}/P{i}"]), f"<h1>Page {i}</h1>{markup}<p>{'word ' * rng.choice([1, 30])}</p>"))
        seeds[site] = [f"{site}/sitemap.xml", f"{site}/p0", f"{site}/P0", f"{site}/p{n}"]
        if s % 2:
            pages[f"{site}/sitemap.xml"] = ["/p1", "/p2"]
            rows.append((f"{site}/sitemap.xml", f"<urlset><loc>{site}/p1</loc><loc>{site}/p2/</loc></urlset>"))
    table = spark.createDataFrame([*rows, (None, "x"), ("https://s9.example/p0", "bad")], "url string, html string")
    first = spark.createDataFrame([(site, u, k) for site, urls in seeds.items() for k, u in enumerate(urls)], "site string, url string, place int")
    for most, depth in ((1000, 10), (7, 10), (3, 2), (25, 0)):
        found = crawl.crawl_sites(table, first, most, depth)
        got = {}
        for r in found.attempts.collect():
            got.setdefault(r.site, {})[r.url] = (r.depth, r.place, r.state)
        assert got == plain(pages, seeds, most, depth)
    documents = found.documents.collect()
    assert {r.status_code for r in documents} == {"ok", "empty_content"} and all((r.content == "") == (r.status_code != "ok") for r in documents)
    limits = {r.site: r.limit for r in crawl.results(crawl.crawl_sites(table, first, 7, 10), 7).collect()}
    assert limits["https://s0.example"] in ("documents", "attempts")
    assert crawl.crawl_sites(table.limit(0), first.limit(0)).attempts.count() == 0
    alone = crawl.crawl_sites(table.withColumn("http_status", F.lit(503)), first, 5)
    assert {r.state for r in alone.attempts.collect()} == {"not_found"} and alone.documents.count() == 0


def test_running_sums(spark):
    rows = [(g, i, i % 3) for g in "abc" for i in range(400 if g == "a" else 5)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(7)
    got = {(r.g, r.i): (r.n, r.total) for r in ids.running(df, ["g"], ["i"], {"n": F.lit(1), "total": F.col("v")}).collect()}
    want = {(g, i): (i + 1, sum(k % 3 for k in range(i + 1))) for g, i, _ in rows}
    assert got == want and not ids.running(df.limit(0), ["g"], ["i"], {"n": F.lit(1)}).collect()
