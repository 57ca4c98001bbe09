"""URL filter by temporal list join, in DataFrame functions only.

A block list is a log of dated entries (domain, listed_at, action add or remove). Per domain, each entry holds from its
date until the domain's next one, so additions become validity intervals. Every capture is then joined as of its fetch
time: it is blocked while an interval of its host or of a parent domain (on a label boundary) covers that time.

The join goes by distinct host: suffixes of hosts meet domains, each host gets its whole history as one row, and that
row meets its captures. Up to BROADCAST_HOSTS history rows of at most BROADCAST_ENTRIES intervals altogether are
broadcast; beyond that, captures are salted so that a host with a third of all rows is split.

Edge cases: null or unparsable URLs have no host and are never blocked, nor are captures with a null fetch time;
hosts and listed domains are compared in lower case without trailing dots; of two entries of a domain at one time,
removal comes last; entries with a null or empty domain or a null date count for nothing, and so do those whose action
is null or neither add nor remove; other columns stay as they are, and added ones take underscores where a column has
their name in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolweave.llm.common import fresh, quoted, save, table

BROADCAST_HOSTS, BROADCAST_ENTRIES, SALTS = 100_000, 200_000, 16
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]+)"


def url_host(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to): valid_to is null while the entry still holds."""
    known = entries.where("listed_at IS NOT NULL AND action IN ('add', 'remove')")
    dated = known.select(F.rtrim(F.lower("domain"), F.lit(".")).alias("domain"), "listed_at", (F.col("action") != "add").cast("int").alias("removes")).where("domain <> ''").distinct()
    w = Window.partitionBy("domain").orderBy("listed_at", "removes")
    spans = dated.select("domain", "removes", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(w).alias("valid_to"))
    return spans.where("removes = 0 AND (valid_to IS NULL OR valid_from < valid_to)").drop("removes")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures with url_host, blocked (boolean), blocked_by (the most specific domain) and blocked_since."""
    columns = captures.columns
    host, history, hit, salt = (fresh(captures, x) for x in ("url_host", "url_history", "url_hit", "url_salt"))
    named = captures.withColumn(host, url_host(F.col(url)))
    hosts = named.select(F.col(host).alias("host")).where("host IS NOT NULL").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = hosts.withColumn("domain", F.explode(suffixes)).join(intervals(entries), "domain")
    span = F.struct((-F.length("domain")).alias("rank"), "valid_from", "valid_to", "domain")
    histories = save(met.groupBy("host").agg(F.array_sort(F.collect_list(span)).alias("history")), "url-histories")
    size = histories.agg(F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum(F.size("history")), F.lit(0)).alias("spans")).first()
    side = histories.select(F.col("host").alias(host), F.col("history").alias(history))
    if size["hosts"] <= BROADCAST_HOSTS and size["spans"] <= BROADCAST_ENTRIES:
        joined = named.join(F.broadcast(side), host, "left")
    else:
        dealt = named.withColumn(salt, F.pmod(F.xxhash64(F.col(url), F.col(fetched), F.rand(7)), F.lit(SALTS)).cast("int"))
        joined = dealt.join(side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [host, salt], "left")
    covers = lambda x: (x["valid_from"] <= F.col(fetched)) & (x["valid_to"].isNull() | (F.col(fetched) < x["valid_to"]))
    found = joined.withColumn(hit, F.try_element_at(F.filter(F.col(history), covers), F.lit(1)))
    return found.select(
        *quoted(columns), F.col(host), F.col(hit).isNotNull().alias(fresh(captures, "blocked")),
        F.col(hit)["domain"].alias(fresh(captures, "blocked_by")), F.col(hit)["valid_from"].alias(fresh(captures, "blocked_since")),
    )


def page_captures(spark, sf_dir) -> DataFrame:
    """pages with a fetch time each: the table has none, so the id fixes one within 2024."""
    day = F.make_interval(days=F.pmod(F.col("page_id"), F.lit(366)).cast("int"), hours=F.pmod(F.col("page_id"), F.lit(24)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + day).alias("fetched_at"))


def page_entries(captures: DataFrame) -> DataFrame:
    """A dated list over the hosts of captures and their parents: a hash of each domain fixes if and when it is listed, removed, listed again."""
    host = captures.select(url_host(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    domains = host.select(F.explode(F.array("host", parent)).alias("domain")).where("domain <> ''").distinct()
    x = F.conv(F.substring(F.md5(F.col("domain").cast("binary")), 1, 7), 16, 10).cast("int")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda days, action: F.struct((start + F.make_interval(days=days.cast("int"))).alias("listed_at"), F.lit(action).alias("action"))
    log = F.array(
        F.when(x % 3 == 0, at(x % 200, "add")),
        F.when((x % 3 == 0) & (x % 2 == 0), at(x % 200 + 30 + x % 90, "remove")),
        F.when((x % 3 == 0) & (x % 10 == 0), at(x % 200 + 150, "add")),
    )
    return domains.select("domain", F.explode(F.array_compact(log)).alias("e")).select("domain", "e.listed_at", "e.action")


ORACLE = """
WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) + to_hours(CAST(page_id % 24 AS INTEGER)) AS fetched_at,
  nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:@]+)', 1)), '.'), '') AS host FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
dom AS (SELECT host AS domain FROM h UNION SELECT regexp_extract(host, '^[^.]+\\.([^.]+\\..+)$', 1) FROM h),
x AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 7) AS BIGINT) AS x FROM dom WHERE domain <> ''),
e AS (SELECT domain, x % 200 AS day, 0 AS removes FROM x WHERE x % 3 = 0
  UNION ALL SELECT domain, x % 200 + 30 + x % 90, 1 FROM x WHERE x % 3 = 0 AND x % 2 = 0
  UNION ALL SELECT domain, x % 200 + 150, 0 FROM x WHERE x % 3 = 0 AND x % 10 = 0),
o AS (SELECT DISTINCT domain, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS valid_from, removes FROM e),
i AS (SELECT domain, removes, valid_from, lead(valid_from) OVER (PARTITION BY domain ORDER BY valid_from, removes) AS valid_to FROM o),
m AS (SELECT p.page_id, i.domain, i.valid_from, row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.domain) DESC, i.valid_from) AS r
  FROM p JOIN i ON (p.host = i.domain OR p.host LIKE '%.' || i.domain) AND i.removes = 0 AND i.valid_from <= p.fetched_at AND (i.valid_to IS NULL OR p.fetched_at < i.valid_to))
SELECT p.page_id, p.url, p.fetched_at, p.host AS url_host, m.domain IS NOT NULL AS blocked, m.domain AS blocked_by, m.valid_from AS blocked_since
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.r = 1
"""
