"""Captures judged by the list entries in force when they were fetched.

A list is a log of dated entries (list, kind, pattern, day, action): ``add`` puts a pattern on the list
from that day on, ``remove`` takes it off. The log becomes validity intervals (a window over each
pattern's entries). Each capture has the keys that entries can name: its host and every parent domain
(kind ``domain``), and its host with every leading run of path segments (kind ``prefix``). An as-of
join finds, for every key and day, the entries in force. A capture is blocked if a block list holds
one of its keys and no allow list does.

Built-in functions only. Captures are reduced to distinct (key, day) before the as-of join, so a host
with a third of all captures meets the list once a day; what comes back is joined on (key, day).

Defined results: a null or unparsable URL, or one without a fetch day, has no keys and passes; of
entries of one list, pattern and day the last action in the alphabet counts (``remove``); repeated
entries count once; entries with nulls are ignored; repeated captures give a row each; empty lists
block nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)"


def host(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def keys(url: F.Column) -> F.Column:
    """``domain:`` keys from the host up to its last two labels, ``prefix:`` keys of one segment and more."""
    name = host(url)
    labels = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != "")
    prefixes = F.transform(F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")),
                           lambda i: F.concat(F.lit("prefix:"), name, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")) \
        .otherwise(F.array_distinct(F.concat(parents, prefixes)))


def folded(pattern: F.Column) -> F.Column:
    """A pattern with its host in lower case; a path keeps its case, as in the keys of captures."""
    name = F.substring_index(pattern, "/", 1)
    return F.concat(F.lower(name), F.substring(pattern, F.length(name) + 1, F.length(pattern)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, allow, key, since, until): until is the day of the pattern's next entry, or null."""
    complete = entries.where("list is not null and kind is not null and pattern is not null and day is not null "
                             "and action in ('add', 'remove')")
    by_day = complete.groupBy("list", F.coalesce("allow", F.lit(False)).alias("allow"),
                              F.concat_ws(":", "kind", folded(F.col("pattern"))).alias("key"), F.col("day").cast("date").alias("since")) \
        .agg(F.max("action").alias("action"))
    later = Window.partitionBy("list", "allow", "key").orderBy("since")
    return by_day.withColumn("until", F.lead("since").over(later)).where("action = 'add'").drop("action")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """For ``captures`` (id, url, day): id, blocked, lists (names of the lists in force on it, sorted,
    joined by commas)."""
    rows = captures.select("id", "url", F.col("day").cast("date").alias("day"), F.monotonically_increasing_id().alias("row")) \
        .select("id", "row", "day", F.explode_outer(keys(F.col("url"))).alias("key"))
    asked = rows.where("key is not null and day is not null").select("key", "day").distinct()
    active = asked.join(intervals(entries), "key").where("day >= since and (until is null or day < until)") \
        .groupBy("key", "day").agg(F.collect_set("list").alias("lists"), F.max("allow").alias("allowed"),
                                   F.max(~F.col("allow")).alias("listed"))
    return rows.join(active, ["key", "day"], "left").groupBy("row").agg(
        F.first("id").alias("id"), F.flatten(F.collect_set("lists")).alias("lists"),
        F.max("allowed").alias("allowed"), F.max("listed").alias("listed")).select(
        "id", F.coalesce(F.col("listed") & ~F.col("allowed"), F.lit(False)).alias("blocked"),
        F.array_join(F.array_sort(F.array_distinct("lists")), ",").alias("lists"))


def drawn(text: F.Column) -> F.Column:
    """A number below 2**28 drawn from a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures. The table has no fetch time; the day is drawn from the id, over four years."""
    days = (drawn(F.col("page_id").cast("string")) % 1461).cast("int")
    return pages.select(F.col("page_id").alias("id"), "url", F.date_add(F.lit("2020-01-01").cast("date"), days).alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated entries on the pages' own hosts, drawn from the host's name: domains that come, go and
    come back, parent domains, path prefixes, and an allow list."""
    hosts = pages.select(host(F.col("url")).alias("h")).where("h <> ''").distinct() \
        .withColumn("c", drawn(F.col("h")))
    start = F.lit("2020-01-01").cast("date")

    def entry(name: str, allow: bool, kind: str, pattern: F.Column, day: F.Column, action: str, where: F.Column) -> DataFrame:
        return hosts.where(where).select(F.lit(name).alias("list"), F.lit(allow).alias("allow"), F.lit(kind).alias("kind"),
                                         pattern.alias("pattern"), F.date_add(start, day.cast("int")).alias("day"),
                                         F.lit(action).alias("action"))
    c, h = F.col("c"), F.col("h")
    parent = F.substring_index(h, ".", -3)
    out = entry("spam", False, "domain", h, c % 700, "add", c % 3 == 0)
    for more in (entry("spam", False, "domain", h, c % 700 + 200, "remove", c % 6 == 0),
                 entry("spam", False, "domain", h, c % 700 + 500, "add", c % 12 == 0),
                 entry("adult", False, "domain", parent, c % 1300, "add", c % 7 == 1),
                 entry("legal", False, "prefix", F.concat(h, F.lit("/en")), c % 900, "add", c % 5 == 2),
                 entry("legal", False, "prefix", F.concat(h, F.lit("/en")), c % 900 + 300, "remove", c % 10 == 2),
                 entry("trusted", True, "domain", h, c % 1000, "add", c % 9 == 3)):
        out = out.unionByName(more)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(page_captures(pages), page_entries(pages)).withColumnRenamed("id", "page_id")


SQL = r"""
with p as (
  select page_id, date '2020-01-01' + cast(('0x' || substr(md5(cast(page_id as varchar)), 1, 7))::bigint % 1461 as int) as day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as h,
         trim(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)', 1), '/+', '/', 'g'), '/') as path
  from pages),
hosts as (select distinct h, ('0x' || substr(md5(h), 1, 7))::bigint as c from p where h <> ''),
entries as (
  select 'spam' as list, false as allow, 'domain:' || h as key, c % 700 as day, 'add' as action from hosts where c % 3 = 0
  union all select 'spam', false, 'domain:' || h, c % 700 + 200, 'remove' from hosts where c % 6 = 0
  union all select 'spam', false, 'domain:' || h, c % 700 + 500, 'add' from hosts where c % 12 = 0
  union all select 'adult', false, 'domain:' || array_to_string(string_split(h, '.')[greatest(len(string_split(h, '.')) - 2, 1):], '.'),
                   c % 1300, 'add' from hosts where c % 7 = 1
  union all select 'legal', false, 'prefix:' || h || '/en', c % 900, 'add' from hosts where c % 5 = 2
  union all select 'legal', false, 'prefix:' || h || '/en', c % 900 + 300, 'remove' from hosts where c % 10 = 2
  union all select 'trusted', true, 'domain:' || h, c % 1000, 'add' from hosts where c % 9 = 3),
by_day as (select list, allow, key, date '2020-01-01' + cast(day as int) as since, max(action) as action
           from entries group by all),
iv as (select *, lead(since) over (partition by list, allow, key order by since) as until from by_day),
parts as (select page_id, day, h, string_split(h, '.') as labels, string_split(path, '/') as segments, path
          from p where h <> ''),
keyed as (
  select page_id, day, 'domain:' || array_to_string(labels[i:], '.') as key
  from (select *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) as i from parts)
  union
  select page_id, day, 'prefix:' || h || '/' || array_to_string(segments[:i], '/')
  from (select *, unnest(range(1, len(segments) + 1)) as i from parts where path <> '')),
hits as (select page_id, string_agg(distinct list, ',' order by list) as lists, bool_or(allow) as allowed, bool_or(not allow) as listed
         from keyed join iv on keyed.key = iv.key and iv.action = 'add' and day >= since and (until is null or day < until)
         group by page_id)
select page_id, coalesce(listed and not allowed, false) as blocked, coalesce(lists, '') as lists
from pages left join hits using (page_id)
"""
