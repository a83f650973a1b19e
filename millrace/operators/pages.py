"""Queries over text and landed pages: hashes, previews, cleaning, URLs, titles, links and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean, html, text, urls
from ..sources import views


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.documents(spark, sf_dir)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages")


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 10, max_pages: int = 1000) -> DataFrame:
    """Pages reached from ``seeds`` (url, site) by links, over landed ``pages`` (url, html): url, site and depth.

    Each round joins the frontier with the pages, follows their links and drops
    what its site has seen. Rounds are written to the shared folder, so lineage
    stays short. Each site is a crawl of its own, with at most ``max_pages``
    pages, by depth and URL; there is no limit over all sites. A page that two
    sites reach (one within the other's domain) is in both.
    """
    # of pages with one address that of the least spelling, whatever the order of the rows
    spelled = pages.groupBy(urls.canonical(F.col("url")).alias("_url")).agg(F.min(F.struct("url", "html")).alias("_page"))
    keyed = spelled.select(F.col("_url").alias("url"), "_page.html")
    landed = keyed.select("url")

    def within_cap(new: DataFrame, counts: DataFrame | None, depth: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("site").orderBy("url"))
        ranked = new.join(landed, "url", "left_semi").withColumn("_rank", rank).where(F.col("_rank") <= max_pages)
        if counts is not None:
            ranked = ranked.join(counts, "site", "left").where(F.col("_rank") + F.coalesce("_had", F.lit(0)) <= max_pages)
        return ranked.select("url", "site", F.lit(depth).alias("depth")).checkpoint()

    first = seeds.select(urls.canonical(F.col("url")).alias("url"), "site").dropDuplicates(["site", "url"])
    seen = last = within_cap(first, None, 0)
    for depth in range(1, max_depth + 1):
        found = last.join(keyed, "url").select("url", "site", F.explode(html.links(F.col("html"))).alias("link"))
        found = found.select(urls.resolve(F.col("link"), F.col("url"), F.col("site")).alias("url"), "site").where("url is not null")
        found = found.withColumn("url", urls.canonical(F.col("url"))).dropDuplicates(["site", "url"])
        new = found.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        last = within_cap(new, seen.groupBy("site").agg(F.count("*").alias("_had")), depth)
        if last.isEmpty():
            break
        seen = seen.unionByName(last).checkpoint()
    return seen.orderBy("depth", "url", "site")


def q_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select(
        "id", "content_hash", text.sha256(F.concat_ws("|", "url", "status_code"), upper=True).alias("status_hash"),
        text.guid_of(F.col("url")).alias("guid"),
    )


def q_preview_260(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("id", text.preview(F.col("content"), F.col("title"), "-").alias("preview"))


def q_collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("content")
    return _docs(spark, sf_dir).select(
        "id", F.sha2(text.collapse_white(content), 256).alias("white"), F.sha2(text.collapse_lines(content), 256).alias("lines")
    )


def q_short_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = clean.once_if_short(F.split("content", "\n"))
    return _docs(spark, sf_dir).select("id", F.size(lines).cast("long").alias("lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean.clean(F.col("content"))
    return _docs(spark, sf_dir).select("id", F.sha2(cleaned, 256).alias("hash"), F.char_length(cleaned).cast("long").alias("chars"))


def q_clean_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("id", clean.clean_preview(F.col("content")).alias("preview"))


def q_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, sf_dir).select(
        "page_id", urls.canonical(url).alias("canonical"), urls.canonical(url, with_path=False).alias("address"),
        urls.host(url).alias("host"), urls.title_of(url).alias("title"),
    )


def q_distinct_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).agg(F.count_distinct(F.nullif(urls.host(F.col("url")), F.lit(""))).alias("hosts"))


def q_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.posexplode(html.links(F.col("html"))).alias("position", "link"))


def q_page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html.title(F.col("html")).alias("title"))


def q_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html.html_to_text("html").alias("text"))


def q_followed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    found = pages.select("page_id", "url", F.explode(html.links(F.col("html"))).alias("link"))
    resolved = found.select("page_id", urls.resolve(F.col("link"), F.col("url"), urls.canonical(F.col("url"), False)).alias("target"))
    return resolved.where("target is not null").groupBy("page_id", "target").agg(F.count("*").alias("times"))


def q_crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    # a source each address; the landed pages stand for the sitemap that seeds its crawl, the root among them
    seeds = pages.select("url", urls.canonical(F.col("url"), False).alias("site"))
    return crawl(pages, seeds).groupBy("url").agg(F.min("depth").alias("depth"))


def q_refresh_period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods made from event ids, parsed to minutes and back."""
    made = views.table(spark, sf_dir, "events").select(F.col("event_id"))
    unit = F.element_at(F.array(*map(F.lit, ("minute", "hours", "day", "Weeks", "month"))), (F.col("event_id") % 5 + 1).cast("int"))
    period = F.concat((F.col("event_id") % 70).cast("string"), F.lit(" "), unit)
    minutes = made.select("event_id", text.refresh_minutes(period).alias("minutes")).where("minutes is not null")
    back = text.minutes_as_unit(F.col("minutes"))
    return minutes.select("event_id", "minutes", back["value"].alias("value"), back["unit"].alias("unit"))


QUERIES = {
    "content_hash": q_content_hash,
    "preview_260": q_preview_260,
    "collapse_whitespace": q_collapse_whitespace,
    "short_line_dedup": q_short_line_dedup,
    "clean_text": q_clean_text,
    "clean_preview": q_clean_preview,
    "canonical_url": q_canonical_url,
    "distinct_hosts": q_distinct_hosts,
    "page_links": q_page_links,
    "page_title": q_page_title,
    "html_to_text": q_html_to_text,
    "followed_links": q_followed_links,
    "crawled_pages": q_crawled_pages,
    "refresh_period_parse": q_refresh_period_parse,
}

_LINES = """line AS (
  SELECT id, i, trim(regexp_replace(string_split(replace(content, chr(13), chr(10)), chr(10))[i], '\\s+', ' ', 'g'), ' ') AS line
  FROM (SELECT id, content, unnest(range(1, len(string_split(replace(content, chr(13), chr(10)), chr(10))) + 1)) AS i FROM doc))"""
_LEAD = "(?i)^(?:(?:" + "|".join(clean.LEADING) + ")\\s*)+"
_CLEAN = f"""{_LINES}, stripped AS (
  SELECT id, i, trim(regexp_replace(line, '{_LEAD}', ''), ' ') AS line FROM line
), kept AS (
  SELECT * FROM stripped WHERE line <> '' AND lower(line) NOT IN ({", ".join(f"'{x}'" for x in clean.EXACT)})
    AND NOT ({" OR ".join(f"starts_with(lower(line), '{x.strip()}')" for x in clean.FOOTERS)})
    AND NOT ({" OR ".join(f"contains(lower(line), '{x}')" for x in clean.CLIENT_ERRORS)})
), once AS (
  SELECT * FROM kept QUALIFY length(line) >= 80 OR row_number() OVER (PARTITION BY id, upper(line) ORDER BY i) = 1
), cleaned AS (
  SELECT doc.id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS t,
    coalesce(string_agg(line, ' ' ORDER BY i) FILTER (length(line) >= 24), string_agg(line, ' ' ORDER BY i), '') AS p
  FROM doc LEFT JOIN once ON once.id = doc.id GROUP BY doc.id)"""
_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#]*)', 1)), ':\\d*$', ''), '^www\\.', '')"
_PATH = "rtrim(regexp_replace(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/')"
_SCHEME = "lower(regexp_extract(url, '^((?i:https?))://', 1))"
ORACLES = {
    "content_hash": """
SELECT id, content_hash, upper(sha256(url || '|' || status_code)) AS status_hash,
  h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:32] AS guid
FROM (SELECT *, sha256(url) AS h FROM doc)""",
    "preview_260": r"""
SELECT id, CASE WHEN length(c) <= 260 THEN c ELSE rtrim(left(c, 260), ' ') || '...' END AS preview FROM (
  SELECT id, CASE WHEN c <> '' THEN c ELSE coalesce(nullif(trim(title, ' '), ''), '-') END AS c FROM (
    SELECT id, title, trim(regexp_replace(translate(content, chr(13) || chr(10), '  '), ' +', ' ', 'g'), ' ') AS c FROM doc))""",
    "collapse_whitespace": f"""WITH {_LINES}
SELECT doc.id, sha256(trim(regexp_replace(any_value(content), '\\s+', ' ', 'g'), ' ')) AS white,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), '')) AS lines
FROM doc LEFT JOIN line ON line.id = doc.id GROUP BY doc.id""",
    "short_line_dedup": """
WITH line AS (
  SELECT id, i, string_split(content, chr(10))[i] AS line
  FROM (SELECT id, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM doc)
), once AS (
  SELECT * FROM line QUALIFY length(line) >= 80 OR row_number() OVER (PARTITION BY id, upper(line) ORDER BY i) = 1)
SELECT id, count(*) AS lines, sha256(string_agg(line, chr(10) ORDER BY i)) AS hash FROM once GROUP BY id""",
    "clean_text": f"WITH {_CLEAN} SELECT id, sha256(t) AS hash, length(t) AS chars FROM cleaned",
    "clean_preview": f"""WITH {_CLEAN}, spot AS (
  SELECT *, CASE WHEN strpos(reverse(left(p, 221)), ' ') = 0 THEN -1 ELSE length(left(p, 221)) - strpos(reverse(left(p, 221)), ' ') END AS k FROM cleaned)
SELECT id, CASE WHEN length(p) <= 220 THEN p ELSE rtrim(left(p, CASE WHEN k < 80 THEN 220 ELSE k END), ' ') || '...' END AS preview FROM spot""",
    "canonical_url": f"""
SELECT page_id, {_SCHEME} || '://' || {_HOST} || {_PATH} AS canonical, {_SCHEME} || '://' || {_HOST} AS address, {_HOST} AS host,
  CASE WHEN string_split({_PATH}, '/')[-1] = '' THEN {_HOST} ELSE trim(url_decode(replace(translate(string_split({_PATH}, '/')[-1], '-_', '  '), '+', '%2B'))) END AS title
FROM pages""",
    "distinct_hosts": f"SELECT count(DISTINCT nullif({_HOST}, '')) AS hosts FROM pages",
    "page_links": r"""
SELECT page_id, (unnest(range(0, len(found))))::INT AS position, unnest(found) AS link FROM (
  SELECT page_id, list_filter(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']+)["'']', 1)
    || regexp_extract_all(html, '(?i)"(?:href|url)"\s*:\s*"([^"]+)"', 1)
    || regexp_extract_all(html, '["''](/[A-Za-z0-9][^"''\s<>]*)["'']', 1)
    || regexp_extract_all(html, '(?i)<loc>\s*([^<\s]+)\s*</loc>', 1), lambda x: trim(x) <> '') AS found FROM pages)""",
    "refresh_period_parse": """
SELECT event_id, minutes, CASE WHEN minutes % 10080 = 0 AND minutes // 10080 BETWEEN 1 AND 4 THEN minutes // 10080
    WHEN minutes % 1440 = 0 AND minutes // 1440 BETWEEN 1 AND 4 THEN minutes // 1440
    WHEN minutes % 60 = 0 AND minutes // 60 BETWEEN 1 AND 24 THEN minutes // 60 ELSE least(greatest(minutes, 1), 60) END AS value,
  CASE WHEN minutes % 10080 = 0 AND minutes // 10080 BETWEEN 1 AND 4 THEN 'week'
    WHEN minutes % 1440 = 0 AND minutes // 1440 BETWEEN 1 AND 4 THEN 'day'
    WHEN minutes % 60 = 0 AND minutes // 60 BETWEEN 1 AND 24 THEN 'hour' ELSE 'minute' END AS unit
FROM (SELECT event_id, (CASE event_id % 5 WHEN 0 THEN CASE WHEN n BETWEEN 1 AND 60 THEN n END
    WHEN 1 THEN CASE WHEN n BETWEEN 1 AND 24 THEN n * 60 END WHEN 2 THEN CASE WHEN n BETWEEN 1 AND 4 THEN n * 1440 END
    WHEN 3 THEN CASE WHEN n BETWEEN 1 AND 4 THEN n * 10080 END END)::INT AS minutes
  FROM (SELECT event_id, event_id % 70 AS n FROM events)) WHERE minutes IS NOT NULL""",
}
