"""URL functions and set operations on URL columns."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

# Extensions and patterns of URLs that are not crawled.
EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".zip", ".tar", ".gz", ".rar", ".7z", ".exe", ".dmg", ".pkg", ".deb", ".rpm", ".iso", ".bin", ".dat", ".css", ".js", ".xml", ".rss", ".atom", ".json", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".odp")
CRAWLER_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".zip", ".tar", ".gz", ".mp3", ".mp4")
LINK = r"https?://[^\s<>\"{}|\\^`\[\]]+"
JUNK = (r"/wp-login\.php", r"/wp-admin/", r"/cart/?$", r"/checkout/?$", r"\?add-to-cart=", r"/search\?", r"/tag/", r"/author/", "#", "javascript:", "mailto:", "tel:")


def _normal(url: str | None) -> str | None:
    try:
        u = urlparse(url.strip())
        scheme, host = u.scheme.lower(), u.netloc.lower()
        for end, kind in ((":80", "http"), (":443", "https")):
            if scheme == kind:
                host = host.removesuffix(end)
        return urlunparse((scheme, host, u.path.rstrip("/") or "/", u.params, urlencode(sorted(parse_qsl(u.query))), ""))
    except (ValueError, AttributeError):
        return url


@F.pandas_udf(t.StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    """Lower-case scheme and host, no default port, sorted query without blank values, no fragment; parameters of the last segment (`;x`) stay behind the path; what can't be parsed stays as it is."""
    return urls.map(_normal)


@F.pandas_udf(t.StringType())
def make_absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", x or "") for b, x in zip(base, link, strict=True)])


def host(url: Column) -> Column:
    """Lower-case authority, with port and user."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def base_domain(url: Column) -> Column:
    return F.substring_index(host(url), ".", -2)


def is_valid(url: Column, domains: list[str] | None = None) -> Column:
    """http(s), a host, no excluded extension on the path, no junk pattern; a host of the list if there is one."""
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([^:/?#]+)://", 1))
    ok = scheme.isin("http", "https") & (host(url) != "") & ~F.lower(path(url)).rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$") & ~url.rlike("|".join(JUNK))
    return F.coalesce(ok & host(url).isin(domains) if domains else ok, F.lit(False))


def crawl_key(url: Column) -> Column:
    """The crawler's own form: without fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def crawlable(url: Column, domains: list[str] | None = None) -> Column:
    """The crawler's own test: the extension is looked for at the end of the whole URL."""
    ok = F.lower(url).rlike("^https?://[^/?#]+") & ~F.lower(url).rlike("(" + "|".join(e.replace(".", r"\.") for e in CRAWLER_EXTENSIONS) + ")$")
    return F.coalesce(ok & host(url).isin(domains) if domains else ok, F.lit(False))


def robots_url(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1), F.lit("/robots.txt"))


def can_fetch(pages: DataFrame, robots: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """Adds allowed: what the robots file of the URL's host says (host, content; without one all is allowed). Rules are parsed once a host and batch."""

    @F.pandas_udf(t.BooleanType())
    def told(links: pd.Series, content: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}

        def one(link, rules) -> bool:
            if rules is None or link is None:
                return True
            if rules not in parsed:
                parsed[rules] = RobotFileParser()
                parsed[rules].parse(rules.splitlines())
            return parsed[rules].can_fetch(agent, link)

        return pd.Series([one(a, b) for a, b in zip(links, content, strict=True)])

    known = robots.groupBy(F.lower("host").alias("_host")).agg(F.min("content").alias("_rules"))
    return pages.withColumn("_h", host(F.col(url))).join(known, F.col("_h") == F.col("_host"), "left").withColumn("allowed", told(F.col(url), F.col("_rules"))).drop("_h", "_host", "_rules")


def fetch_times(pages: DataFrame, order: str, delay_s: float = 1.0, url: str = "url", start: str | None = None) -> DataFrame:
    """Adds fetch_s: when each URL is fetched if the URLs of a host keep `delay_s` seconds apart, in the order of a column. start: when it is asked for (default 0).

    A scan in two levels: ranges of (host, order) are counted and folded on their own, then each range learns what the ones before hold of its host. A host with half of all rows spreads over many ranges.
    """
    asked = F.col(start).cast("double") if start else F.lit(0.0)
    dealt = pages.withColumns({"_h": F.coalesce(host(F.col(url)), F.lit("")), "_asked": asked}).repartitionByRange("_h", order).withColumn("_p", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("_p", "_h").orderBy(order)
    told = dealt.withColumn("_place", F.row_number().over(inside) - 1)
    # the latest of all earlier demands, each with a delay for every row between
    told = told.withColumn("_most", F.max(F.col("_asked") - F.col("_place") * delay_s).over(inside))
    earlier = Window.partitionBy("_h").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a host
    sums = told.groupBy("_p", "_h").agg(F.count("*").alias("_n"), F.max("_most").alias("_m"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    sums = sums.withColumn("_held", F.max(F.col("_m") - F.col("_before") * delay_s).over(earlier)).select("_p", "_h", "_before", "_held")
    both = told.join(sums, ["_p", "_h"])
    most = F.greatest(F.col("_most") - F.col("_before") * delay_s, F.coalesce("_held", F.lit(float("-inf"))))
    return both.withColumn("fetch_s", most + (F.col("_before") + F.col("_place")) * delay_s).select(*(c for c in both.columns if c in pages.columns), "fetch_s")


def url_hash(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


def links_in_text(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(0))


def deduplicate(df: DataFrame, url: str, order: str) -> DataFrame:
    """The first row of each normalised URL."""
    return _first_of(df, normalize_url(F.col(url)), order)


def _first_of(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by the order column; a null order comes last. The join is by key and order together, so a key that many rows share is no hot task."""
    told = df.withColumn("_h", key)
    first = told.groupBy("_h").agg(F.min(order).alias("_o")).withColumnRenamed("_h", "_g")
    same = F.col("_h").eqNullSafe(F.col("_g")) & F.col(order).eqNullSafe(F.col("_o"))
    return told.join(first, same, "left_semi").dropDuplicates(["_h", order]).drop("_h")


def merge_results(parts: list[DataFrame], order: str, text: str = "text", content_hash: str = "content_hash") -> DataFrame:
    """The union of crawls, first row of each content hash (of the text where it is null)."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    key = F.coalesce(F.col(content_hash), F.sha2(F.col(text), 256)) if content_hash in whole.columns else F.sha2(F.col(text), 256)
    return _first_of(whole, key, order)


def filter_domains(df: DataFrame, url: str, domains: DataFrame) -> DataFrame:
    """Rows whose host is in a table (column domain)."""
    return df.join(domains.select(F.col("domain").alias("_d")).distinct(), host(F.col(url)) == F.col("_d"), "left_semi")


def crawl_size(seeds: Column, links: Column, depth: Column) -> Column:
    """The sum of seeds * links^d for d from 0 to depth."""
    return F.aggregate(F.sequence(F.lit(0), depth), F.lit(0.0), lambda s, d: s + seeds * F.pow(links.cast("double"), d)).cast("long")


def chunk(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds `chunk`: consecutive groups of a size, by the global order."""
    return _ranked(df, order).withColumn("chunk", F.floor((F.col("_rank") - 1) / size)).drop("_rank")


class _Page(HTMLParser):
    HIDDEN = ("script", "style", "nav", "footer")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_title, self.title, self.text, self.links = 0, False, [], [], []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        self.in_title = tag == "title"
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.hidden:
            self.text.append(data)


@F.pandas_udf(t.StructType([t.StructField("title", t.StringType()), t.StructField("text", t.StringType()), t.StructField("links", t.ArrayType(t.StringType()))]))
def parse_html(pages: pd.Series) -> pd.DataFrame:
    """Title, visible text with single spaces (script, style, nav and footer left out) and hrefs in order."""
    rows = []
    for html in pages:
        p = _Page()
        p.feed(html or "")
        p.close()
        rows.append((" ".join("".join(p.title).split()), " ".join(" ".join(p.text).split()), p.links))
    return pd.DataFrame(rows, columns=["title", "text", "links"])


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """url, title, text, content_hash and links of pages whose text has the least length."""
    df = pages.withColumn("_p", parse_html(html)).select(*(c for c in pages.columns if c != html), "_p.*")
    return df.filter(F.length("text") >= least).withColumn("content_hash", F.sha2("text", 256))


def extract_links(pages: DataFrame, url: str = "url") -> DataFrame:
    """Distinct (url, link): absolute, normalised, valid."""
    links = pages.select(url, F.explode("links").alias("_l")).withColumn("link", normalize_url(make_absolute(F.col(url), F.col("_l"))))
    return links.filter(is_valid(F.col("link"))).select(url, "link").distinct()


def accepted(responses: DataFrame, order: str, least: int = 100) -> DataFrame:
    """Responses that a crawler keeps: status 200, an HTML content type, text of the least length, the first of each content by the order column. Adds content_hash. Columns: status, content_type, text."""
    fine = (F.col("status") == 200) & F.contains(F.lower("content_type"), F.lit("text/html")) & (F.length("text") >= least)
    told = responses.filter(F.coalesce(fine, F.lit(False))).withColumn("content_hash", F.sha2("text", 256))
    return _first_of(told, F.col("content_hash"), order)


def _ranked(df: DataFrame, *order: str) -> DataFrame:
    """Adds _rank, from 1, by the order of columns over all rows: places inside ranges plus the counts of the ranges before, of which there is one row each."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    before, rows = 0, []
    for p, n in sorted(dealt.groupBy("_p").count().collect()):
        rows.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_p int, _b long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_b")
    return dealt.join(F.broadcast(offsets), "_p").withColumn("_rank", place).drop("_p", "_b")


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(url, depth) by breadth-first search over a table of links (url, link): each URL at its least depth. Every level is one anti-join and is checkpointed.

    max_pages: so many URLs at most, the first by depth, then by the place of the first page that links to them, then by URL. A level that goes beyond is cut by its places over all partitions.
    """
    found = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    found = (_ranked(found, "url") if max_pages else found.withColumn("_rank", F.lit(0).cast("long"))).checkpoint()
    frontier, count = found, found.count() if max_pages else 0
    for depth in range(1, max_depth + 1):
        if max_pages and count >= max_pages:
            break
        reached = links.join(frontier.select("url", "_rank"), "url").groupBy(F.col("link").alias("url")).agg(F.min("_rank").alias("_from"))
        new = reached.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        new = _ranked(new, "_from", "url").withColumn("_rank", F.col("_rank") + count) if max_pages else new.withColumn("_rank", F.lit(0).cast("long"))
        frontier = new.select("url", "depth", "_rank").checkpoint()
        more = frontier.count() if max_pages else frontier.limit(1).count()
        if not more:
            break
        count += more
        found = found.unionByName(frontier).checkpoint()
    return found.filter(F.col("_rank") <= max_pages).select("url", "depth") if max_pages else found.select("url", "depth")
