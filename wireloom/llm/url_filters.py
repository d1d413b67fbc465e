"""URL filters by a temporal join against dated lists.

A list is a table of dated entries (domain, action, listed_at): from that time on the domain has that action, until
the domain's next entry. ``intervals`` turns entries into half-open validity intervals. ``evaluate`` joins every capture,
by its host and the host's parent domains, with the entry that was active at fetch time (as-of join); of several domains the
longest decides. Actions: block, allow, and none (which ends a listing).

The lists' side is grouped by domain into arrays of intervals, so an equi-join on the domain finds them and the as-of
choice is made in the row. Hosts are resolved once: distinct hosts meet the list, and captures join the result on
their host. That result is a written table: it is broadcast by its known size, or adaptive execution splits a host that holds
a large part of the captures. Native expressions only.

A null or unparsable URL, a host of more than 253 characters, or a null fetch time, has no entry: verdict keep. Entries with
null fields are ignored; of entries of one domain and time, block wins over allow over none. Repeated captures get equal
verdicts, empty tables give empty results. Columns of captures named host, matched_domain, action or verdict are
replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ENTRIES = "domain string, action string, listed_at timestamp"
ADDED = ("host", "matched_domain", "action", "verdict")
#: Fixed entries of the registered query's list; ``dated_list`` adds those of the hosts that the pages have.
DEFAULT = (
    ("casino-win.example.com", "block", "2024-01-15 00:00:00"),
    ("casino-win.example.com", "none", "2024-06-01 00:00:00"),
    ("casino-win.example.com", "block", "2024-09-01 12:00:00"),
    ("free-bets.example.com", "block", "2024-02-01 00:00:00"),
    ("cheap-pills.example.com", "block", "2024-03-10 06:00:00"),
    ("example.net", "block", "2024-10-01 00:00:00"),
    ("tiontion.example.net", "allow", "2024-10-15 00:00:00"),
    ("blog.tionsh.example.com", "block", "2024-05-05 00:00:00"),
    ("blog.tionsh.example.com", "allow", "2024-08-08 08:00:00"),
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Captures carry no time of their own: an hour a page, over 2024.
FETCHED = "timestamp_seconds(1704067200 + 3600 * pmod(page_id, 8784))"


def host(url: Column) -> Column:
    """Lower-case host without a final dot; null where there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when((found != "") & (F.length(found) <= 253), found)


def domains(of: Column) -> Column:
    """The host and its parents, longest first."""
    parts = F.split(of, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, valid_from, valid_to): valid_to is null for a domain's last entry."""
    usable = entries.where("domain IS NOT NULL AND action IS NOT NULL AND listed_at IS NOT NULL")
    order = F.array_position(F.array(*[F.lit(a) for a in ("none", "allow", "block")]), F.col("action"))
    one = usable.groupBy(F.lower("domain").alias("domain"), "listed_at").agg(F.max_by("action", order).alias("action"))
    following = F.lead("listed_at").over(Window.partitionBy("domain").orderBy("listed_at"))
    return one.select("domain", "action", F.col("listed_at").alias("valid_from"), following.alias("valid_to"))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """Add host, matched_domain, action and verdict (drop or keep) to each capture."""
    host_, at_, other, held_, hit = common.free_names(captures, "host_", "at_", "other", "held", "hit")
    span = F.struct("valid_from", "valid_to", "action")
    # As many intervals for a domain as its list has dates.
    listed = intervals(entries).groupBy("domain").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    rows = captures.withColumns({host_: host(F.col(url)), at_: F.col(fetched_at)})
    hosts = rows.select(F.col(host_).alias("host")).where("host IS NOT NULL").distinct()
    candidates = hosts.select("host", F.posexplode(domains(F.col("host"))).alias("depth", "domain")).join(listed, "domain")
    # A host has as many candidates as labels.
    held = candidates.groupBy(F.col("host").alias(other)).agg(F.sort_array(F.collect_list(F.struct("depth", "domain", "spans"))).alias(held_))
    held = common.written(held, "listed-hosts")
    at = F.col(at_)
    active = lambda s: (s["valid_from"] <= at) & (s["valid_to"].isNull() | (at < s["valid_to"])) & (s["action"] != "none")
    hits = F.filter(F.transform(held_, lambda h: F.struct(h["domain"].alias("domain"), F.get(F.filter(h["spans"], active), F.lit(0))["action"].alias("action"))), lambda h: h["action"].isNotNull())
    joined = rows.join(held, F.col(host_) == F.col(other), "left").withColumn(hit, F.get(hits, F.lit(0)))
    action = F.col(hit)["action"]
    values = (F.col(host_), F.col(hit)["domain"], action, F.when(action == "block", "drop").otherwise("keep"))
    stay = [F.col(f"`{x}`") for x in captures.columns if x.lower() not in ADDED]
    return joined.select(*stay, *[v.alias(n) for n, v in zip(ADDED, values, strict=True)])


def default_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT), "domain string, action string, at string").select("domain", "action", F.to_timestamp("at").alias("listed_at"))


def dated_list(hosts: DataFrame) -> DataFrame:
    """Entries made by a rule from a table of hosts (host): the digits of a host's MD5 say what is listed and when.

    By the first digit: 0-3 the host is blocked; 4-5 blocked and later allowed; 6-7 blocked, later unlisted, later blocked
    again; 8-9 its parent domain is blocked and the host itself allowed later. The next two digits are the hour of 2024 of the
    first entry, and each entry comes 24 hours after the one before.
    """
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("host"), i, 1)) - 1
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    plans = [(range(0, 4), ["block"]), (range(4, 6), ["block", "allow"]), (range(6, 8), ["block", "none", "block"]), (range(8, 10), ["parent", "allow"])]
    entry = lambda i, a: F.struct((parent if a == "parent" else F.col("host")).alias("domain"), F.lit("block" if a == "parent" else a).alias("action"), F.lit(24 * i).alias("later"))
    chosen = F.coalesce(*[F.when(digit(1).isin(list(d)), F.array(*[entry(i, a) for i, a in enumerate(actions)])) for d, actions in plans])
    listed = hosts.select(F.inline(chosen), (digit(2) * 16 + digit(3)).alias("first"))
    return listed.select("domain", "action", F.timestamp_seconds(F.lit(1704067200) + 3600 * (F.col("first") + F.col("later"))).alias("listed_at"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    hosts = pages.select(host(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    entries = default_list(spark).unionByName(dated_list(hosts))
    return evaluate(pages, entries).select("page_id", "host", "matched_domain", "action", "verdict")


_VALUES = ", ".join(f"('{d}', '{a}', TIMESTAMP '{t}')" for d, a, t in DEFAULT)
ORACLE = rf"""
WITH caps AS (
  SELECT page_id, CASE WHEN length(h) BETWEEN 1 AND 253 THEN h END AS host, fetched FROM (
    SELECT page_id, regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\.$', '') AS h,
      TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(((page_id % 8784) + 8784) % 8784 AS INTEGER)) AS fetched
    FROM pages)
), hosts AS (
  SELECT DISTINCT host, instr('0123456789abcdef', substr(md5(host), 1, 1)) - 1 AS plan,
    (instr('0123456789abcdef', substr(md5(host), 2, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5(host), 3, 1)) - 1 AS hour
  FROM caps WHERE host IS NOT NULL
), listed(domain, action, valid_from) AS (
  VALUES {_VALUES}
  UNION ALL SELECT host, 'block', TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(hour AS INTEGER)) FROM hosts WHERE plan < 8
  UNION ALL SELECT regexp_replace(host, '^[^.]+\.', ''), 'block', TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(hour AS INTEGER)) FROM hosts WHERE plan IN (8, 9)
  UNION ALL SELECT host, CASE WHEN plan IN (6, 7) THEN 'none' ELSE 'allow' END, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(hour + 24 AS INTEGER)) FROM hosts WHERE plan BETWEEN 4 AND 9
  UNION ALL SELECT host, 'block', TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(hour + 48 AS INTEGER)) FROM hosts WHERE plan IN (6, 7)
), entries AS (
  SELECT domain, valid_from, CASE max(CASE action WHEN 'block' THEN 3 WHEN 'allow' THEN 2 ELSE 1 END) WHEN 3 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END AS action
  FROM listed GROUP BY domain, valid_from
), spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY domain ORDER BY valid_from) AS valid_to FROM entries
), hits AS (
  SELECT c.page_id, c.host, s.domain, s.action, row_number() OVER (PARTITION BY c.page_id, c.host ORDER BY length(s.domain) DESC) AS n
  FROM (SELECT DISTINCT * FROM caps) c JOIN spans s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain))
    AND s.valid_from <= c.fetched AND (s.valid_to IS NULL OR c.fetched < s.valid_to) AND s.action <> 'none'
)
SELECT c.page_id, c.host, h.domain AS matched_domain, h.action, CASE WHEN h.action = 'block' THEN 'drop' ELSE 'keep' END AS verdict
FROM caps c LEFT JOIN hits h ON c.page_id = h.page_id AND c.host = h.host AND h.n = 1
"""
