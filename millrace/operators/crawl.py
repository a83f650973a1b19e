"""The crawl of sites over landed pages: a frontier in order, a budget of attempts, and rows for what was found.

A site's queue is first in, first out. So its addresses are visited by depth,
and within a depth in the order in which the pages before named them: by the
number of the page, then by the place of the link. A round is one depth of all
sites at once. Its addresses are numbered by running sums, which also tell how
many attempts and documents a site has had before each; an address is visited
if neither has reached its limit. That holds for a site with most of the pages
as for any other, since no site is one task's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, html, labels, urls
from ..sources import views
from ..sources.versions import scratch
from .ids import running

#: Attempts of a site, as a multiple of its documents.
ATTEMPTS = 4
#: Fewest characters of text that a document is kept with.
LEAST_CHARS = 40
# What a page without text is told as.
EMPTY = ("empty_content", "Sayfada kullanılabilir metinsel içerik bulunamadı.")


@dataclass
class Crawl:
    """What a crawl did.

    ``attempts``: site, url, depth, place (number of the visit, from 1; null for
    what a limit left) and state: ``document``, ``utility`` (read for its links),
    ``not_found`` or ``left``. ``documents``: a row for each document.
    """

    attempts: DataFrame
    documents: DataFrame


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _landed(pages: DataFrame) -> DataFrame:
    """key, html and http_status of the landed pages, of those with one key that of the least url."""
    status = F.col("http_status") if "http_status" in pages.columns else F.lit(200)
    keyed = pages.where("url is not null").select(urls.key_of(F.col("url")).alias("key"), "url", "html", status.cast("int").alias("http_status"))
    return keyed.groupBy("key").agg(F.min(F.struct("url", "html", "http_status")).alias("p")).select("key", "p.html", "p.http_status")


def crawl_sites(pages: DataFrame, seeds: DataFrame, max_pages: int = 1000, max_depth: int = 10, least_chars: int = LEAST_CHARS) -> Crawl:
    """Crawls each site of ``seeds`` (site, url, place) over ``pages`` (url, html, maybe http_status).

    Seeds are queued by place. An address is queued once a site, whatever its
    case. Each visit is an attempt; a site ends with ``max_pages`` documents or
    four times as many attempts, or when its queue is empty, and follows links
    ``max_depth`` deep. A landed page with a good status is a document, without
    enough text one of state ``empty_content``; robots and sitemaps are only
    read for links; any other address is an attempt without a document. Sites
    may share pages. Pages without a URL are never reached, empty tables give
    empty results.
    """
    landed = _written(_landed(pages), "landed")
    light = landed.select("key", F.col("http_status").between(200, 299).alias("_good"))
    first = seeds.where("site is not null and url is not null").select(
        "site", urls.canonical(F.col("url")).alias("url"), urls.key_of(F.col("url")).alias("key"), F.lit(0).cast("long").alias("parent"), F.col("place").cast("long").alias("link")
    )
    frontier = _first_of(first)
    seen, done, before = None, [], None
    for depth in range(max_depth + 1):
        found = frontier.join(light, "key", "left").withColumn("good", F.coalesce("_good", F.lit(False))).drop("_good")
        found = found.withColumn("utility", labels.is_utility(F.col("url")))
        counted = found.withColumns({"_tries": F.lit(1).cast("long"), "_rows": (F.col("good") & ~F.col("utility")).cast("long")})
        if before is not None:
            # what a site has had stands before its first address
            counted = counted.unionByName(before, allowMissingColumns=True)
        totals = {"tries": F.col("_tries"), "rows": F.col("_rows")}
        summed = running(counted, ["site"], ["parent", "link"], totals)
        go = (F.col("tries") <= ATTEMPTS * max_pages) & (F.col("rows") - F.col("_rows") < max_pages)
        visited = _written(summed.withColumn("go", go).withColumn("depth", F.lit(depth)), "visited")
        mine = visited.where("url is not null")
        done.append(mine)
        went = mine.where("go")
        before = went.groupBy("site").agg(F.max("tries").alias("_tries"), F.max("rows").alias("_rows")).withColumns(
            {"parent": F.lit(-1).cast("long"), "link": F.lit(-1).cast("long")}
        )
        before = _written(before, "before")
        own = mine.select("site", "key")
        seen = own if seen is None else seen.unionByName(own)
        if depth == max_depth:
            break
        pulled = went.where("good").join(landed, "key").select("site", "url", "tries", F.posexplode(html.links(F.col("html"))).alias("link", "raw"))
        target = urls.resolve(F.col("raw"), F.col("url"), F.col("site"))
        named = pulled.select("site", target.alias("_to"), F.col("tries").alias("parent"), F.col("link").cast("long").alias("link")).where("_to is not null")
        keyed = named.select("site", urls.canonical(F.col("_to")).alias("url"), urls.key_of(F.col("_to")).alias("key"), "parent", "link")
        frontier = _written(_first_of(keyed).join(seen, ["site", "key"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
    whole = done[0]
    for df in done[1:]:
        whole = whole.unionByName(df)
    state = F.when(~F.col("go"), "left").when(~F.col("good"), "not_found").when(F.col("utility"), "utility").otherwise("document")
    attempts = whole.select("site", "url", "key", "depth", F.when(F.col("go"), F.col("tries")).alias("place"), state.alias("state"))
    documents = _rows(attempts.where("state = 'document'").join(landed, "key"), least_chars)
    return Crawl(attempts.drop("key"), documents)


def _first_of(rows: DataFrame) -> DataFrame:
    """Of the rows of a site and key the one that is queued: the first named."""
    one = rows.groupBy("site", "key").agg(F.min(F.struct("parent", "link", "url")).alias("f"))
    return one.select("site", "key", "f.url", "f.parent", "f.link")


def _rows(found: DataFrame, least_chars: int) -> DataFrame:
    """The document of each page: site, url, title, content, content_preview, content_hash, status_code and http_status.

    A page without enough text has no content, and its hash is that of its
    address and state.
    """
    text = clean.clean(html.html_to_text("html"))
    named = F.coalesce(html.title(F.col("html")), urls.title_of(F.col("url")))
    rows = found.select("site", "url", "place", "http_status", named.alias("title"), text.alias("_text"))
    full = F.char_length("_text") >= least_chars
    status = F.concat_ws("|", "url", F.lit(EMPTY[0]), F.lit(EMPTY[1]))
    return rows.select(
        "site", "url", "place", "title", F.when(full, F.col("_text")).otherwise("").alias("content"),
        F.when(full, clean.clean_preview(F.col("_text"))).otherwise(EMPTY[1]).alias("content_preview"),
        F.upper(F.sha2(F.when(full, F.col("_text")).otherwise(status), 256)).alias("content_hash"),
        F.when(full, "ok").otherwise(EMPTY[0]).alias("status_code"), "http_status",
    )


def results(crawl: Crawl, max_pages: int = 1000) -> DataFrame:
    """A row a site: whether any document is ok, documents, attempts, those without a document, and which limit left addresses in its queue."""
    tried = crawl.attempts.groupBy("site").agg(
        F.count_if(F.col("state") == "document").alias("documents"), F.count("place").alias("attempts"),
        F.count_if(F.col("state") == "not_found").alias("not_found"), F.count_if(F.col("state") == "left").alias("_left"),
    )
    good = crawl.documents.groupBy("site").agg(F.bool_or(F.col("status_code") == "ok").alias("_ok"))
    limit = F.when((F.col("_left") > 0) & (F.col("documents") >= max_pages), "documents").when(F.col("_left") > 0, "attempts")
    return tried.join(good, "site", "left").select("site", F.coalesce("_ok", F.lit(False)).alias("successful"), "documents", "attempts", "not_found", limit.alias("limit"))


#: Documents of a site in the query below.
_MOST = 4


def _crawled(spark: SparkSession, sf_dir: str) -> Crawl:
    """Each site from its sitemap, which isn't landed, and its landed https pages in order of page_id."""
    pages = views.table(spark, sf_dir, "pages")
    https = F.concat(F.lit("https://"), urls.host(F.col("url")))
    first = pages.where(urls.scheme(F.col("url")) == "https").select(https.alias("site"), "url", F.col("page_id").alias("place"))
    maps = first.select("site").distinct().select("site", F.concat("site", F.lit("/sitemap.xml")).alias("url"), F.lit(-1).alias("place"))
    return crawl_sites(pages, first.unionByName(maps), _MOST, 3)


def q_crawl_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir).attempts


def q_crawl_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(_crawled(spark, sf_dir), _MOST).drop("successful")


QUERIES = {"crawl_attempts": q_crawl_attempts, "crawl_results": q_crawl_results}

_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#]*)', 1)), ':\\d*$', ''), '^www\\.', '')"
_PATH = "rtrim(regexp_replace(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/')"
#: A queue a site, a visit an iteration: each adds the links of the address at its head that aren't queued yet.
_QUEUE = f"""page AS (
  SELECT page_id, url, lower(regexp_extract(url, '^((?i:https?))://', 1)) AS scheme, {_HOST} AS host, {_PATH} AS path, html FROM pages
), landed AS (
  SELECT lower(scheme || '://' || host || path) AS key, arg_min(html, url) AS html FROM page GROUP BY 1
), raw AS (
  SELECT key, unnest(range(0, len(found))) AS nth, unnest(found) AS link FROM (
    SELECT key, list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']+)["'']', 1)
      || regexp_extract_all(html, '(?i)"(?:href|url)"\\s*:\\s*"([^"]+)"', 1)
      || regexp_extract_all(html, '["''](/[A-Za-z0-9][^"''\\s<>]*)["'']', 1)
      || regexp_extract_all(html, '(?i)<loc>\\s*([^<\\s]+)\\s*</loc>', 1), lambda x: trim(x) <> '') AS found FROM landed)
), link AS (
  SELECT key, list(path ORDER BY nth) AS links FROM (
    SELECT key, nth, rtrim(regexp_replace(regexp_replace(trim(link), '[?#].*$', ''), '/{{2,}}', '/', 'g'), '/') AS path FROM raw WHERE starts_with(trim(link), '/'))
  WHERE NOT regexp_matches(lower(path), '\\.(jpg|jpeg|png|gif|webp|svg|css|js|ico|xml|pdf|zip|mp4|webm)$') GROUP BY key
), seed AS (
  SELECT 'https://' || host AS site, list(path ORDER BY place) AS paths FROM (
    SELECT host, path, min(page_id) AS place FROM page WHERE scheme = 'https' GROUP BY host, path, lower(path)
    UNION ALL SELECT DISTINCT host, '/sitemap.xml', -1 FROM page WHERE scheme = 'https') GROUP BY host
), step AS (
  SELECT site, paths AS queue, list_transform(paths, lambda x: 0) AS depths, list_transform(paths, lambda x: lower(x)) AS keys, 0 AS k, 0 AS documents FROM seed
  UNION ALL
  SELECT site, queue || list_transform(fresh, lambda x: x.path), depths || list_transform(fresh, lambda x: depths[k + 1] + 1), keys || list_transform(fresh, lambda x: lower(x.path)),
    k + 1, documents + hit
  FROM (
    SELECT s.*, CASE WHEN l.key IS NOT NULL AND lower(queue[k + 1]) NOT IN ('/robots.txt', '/sitemap.xml') THEN 1 ELSE 0 END AS hit,
      CASE WHEN depths[k + 1] >= 3 THEN [] ELSE list_filter(list_transform(coalesce(n.links, []), lambda x, i: {{'path': x, 'i': i}}),
        lambda x: NOT list_contains(keys, lower(x.path)) AND list_position(list_transform(n.links, lambda y: lower(y)), lower(x.path)) = x.i) END AS fresh
    FROM step s LEFT JOIN landed l ON l.key = lower(s.site || s.queue[s.k + 1]) LEFT JOIN link n ON n.key = lower(s.site || s.queue[s.k + 1])
    WHERE s.k < len(s.queue) AND s.documents < {_MOST} AND s.k < {ATTEMPTS * _MOST})
), ended AS (
  SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY site ORDER BY k DESC) = 1
), queued AS (
  SELECT site, unnest(queue) AS path, unnest(depths) AS depth, unnest(range(1, len(queue) + 1)) AS nth, k FROM ended
), attempt AS (
  SELECT q.site, q.site || q.path AS url, depth::INT AS depth, CASE WHEN nth <= k THEN nth END AS place,
    CASE WHEN nth > k THEN 'left' WHEN l.key IS NULL THEN 'not_found' WHEN lower(path) IN ('/robots.txt', '/sitemap.xml') THEN 'utility' ELSE 'document' END AS state
  FROM queued q LEFT JOIN landed l ON l.key = lower(q.site || q.path)
)"""
ORACLES = {
    "crawl_attempts": f"WITH RECURSIVE {_QUEUE} SELECT * FROM attempt",
    "crawl_results": f"""WITH RECURSIVE {_QUEUE}
SELECT site, count(*) FILTER (state = 'document') AS documents, count(place) AS attempts, count(*) FILTER (state = 'not_found') AS not_found,
  CASE WHEN count(*) FILTER (state = 'left') = 0 THEN NULL WHEN count(*) FILTER (state = 'document') >= {_MOST} THEN 'documents' ELSE 'attempts' END AS "limit"
FROM attempt GROUP BY site""",
}
