"""Temporal URL lists: every capture is judged by the list entries active when it was fetched.

Dated entries (list, pattern, action add or remove, date) become validity intervals: an entry holds from an add up to, not
including, the next remove of the same list and pattern; further adds in between change nothing, and on a day with both the
remove wins. A pattern is a host or a parent domain; it covers the host and everything below it.

The as-of join has no range condition between tables. Captures look up each of their patterns in one row per (pattern,
month): the state of every list at the start of the month and its changes in it. Such a row is bounded by the days of a
month and the number of lists; it exists only for months with captures. The join is a plain equi-join on two exchanges, so a
host with a third of all captures is split by adaptive execution.

Hosts are lower-case, without user, port, ``www.`` or a final dot. A null or host-less url, and a null fetch date, match
nothing; entries with a null field, or an unknown action, are ignored. Repeated entries count once, repeated captures keep
one row each. Extra columns are ignored. Empty tables give empty results, or captures that match nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import keep


def host_of(url: str = "url") -> Column:
    """Host of a url, empty if it has none."""
    authority = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.$", ""), r"^www\.", "")


def patterns_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more (a host of one label: itself)."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, start, stop) of (list, pattern, action, day); stop is null while an entry still holds."""
    known = entries.where("action in ('add', 'remove') and list is not null and pattern is not null and day is not null")
    # One row per list, pattern and day: what a window sees of a pattern is bounded by the calendar.
    daily = known.groupBy("list", F.lower("pattern").alias("pattern"), "day").agg(F.max(F.col("action") == "remove").alias("gone"))
    order = Window.partitionBy("list", "pattern").orderBy("day")
    turns = daily.withColumn("was", F.lag("gone").over(order)).where("was is null or was <> gone")
    ends = turns.withColumn("stop", F.lead("day").over(order))
    return ends.where("not gone").select("list", "pattern", F.col("day").alias("start"), "stop")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(capture_id, host, day, n_active, lists, pattern): entries that hold for each capture (capture_id, url, day) on its day."""
    seen = captures.select("capture_id", host_of().alias("host"), "day").withColumn("row", F.struct(F.monotonically_increasing_id().alias("n"), "capture_id", "host", "day"))
    seen = keep(seen.select("row"), "captures")
    tried = seen.where("row.day is not null").select("row", F.explode(patterns_of(F.col("row.host"))).alias("pattern")).withColumn("month", F.trunc("row.day", "month"))
    held = keep(intervals(entries), "intervals")
    months = tried.select("pattern", "month").distinct()
    # Intervals of a pattern by month with captures: those that reach into the month, clipped to it.
    reach = months.join(held, "pattern").where((F.col("start") <= F.last_day("month")) & (F.col("stop").isNull() | (F.col("stop") > F.col("month"))))
    rows = keep(reach.groupBy("pattern", "month").agg(F.collect_list(F.struct("list", "start", "stop")).alias("held")), "monthly")
    active = tried.join(rows, ["pattern", "month"]).select("row", "pattern", F.transform(F.filter("held", lambda h: (
        h["start"] <= F.col("row.day")) & (h["stop"].isNull() | (h["stop"] > F.col("row.day")))), lambda h: h["list"]).alias("lists")).where(F.size("lists") > 0)
    # At most one row per label of the host for each capture.
    found = active.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("lists"), F.sum(F.size("lists")).alias("n_active"),
                                      F.max(F.struct(F.length("pattern").alias("size"), "pattern"))["pattern"].alias("pattern"))
    out = seen.join(found, "row", "left")
    return out.select("row.capture_id", "row.host", "row.day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
                      F.array_join(F.coalesce("lists", F.array().cast("array<string>")), ",").alias("lists"), F.coalesce("pattern", F.lit("")).alias("pattern"))


#: Fixed values of the list and fetch dates derived from ``pages``.
FIRST_DAY, DAYS = "2022-01-01", 730


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures (capture_id, url, day): page k was fetched on day 7919 k mod 730 of the two years."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("int"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A moderation log over the pages' hosts: each page reports its host, or every seventh its parent domain, to one of three
    lists on a day of its own; two of three reports add, the third removes."""
    k, host = F.col("page_id"), host_of()
    parts = F.split(host, r"\.")
    parent = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    return pages.select(
        F.element_at(F.array(*map(F.lit, ("malware", "spam", "adult"))), (F.pmod(k, F.lit(3)) + 1).cast("int")).alias("list"),
        F.when(F.pmod(k, F.lit(7)) == 0, parent).otherwise(host).alias("pattern"),
        F.when(F.pmod(F.floor(k / 3), F.lit(3)) == 2, "remove").otherwise("add").alias("action"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(k * 3571, F.lit(DAYS)).cast("int")).alias("day"))


SQL = r"""
WITH hosts AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '^www\.', '') AS host
  FROM pages),
captures AS (SELECT page_id AS capture_id, host, DATE '2022-01-01' + CAST(page_id * 7919 % 730 AS INTEGER) AS day FROM hosts),
entries AS (
  SELECT ['malware', 'spam', 'adult'][page_id % 3 + 1] AS list,
    CASE WHEN page_id % 7 = 0 THEN array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') ELSE host END AS pattern,
    (page_id // 3) % 3 = 2 AS gone, DATE '2022-01-01' + CAST(page_id * 3571 % 730 AS INTEGER) AS day
  FROM hosts),
daily AS (SELECT list, pattern, day, bool_or(gone) AS gone FROM entries GROUP BY ALL),
states AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS next FROM daily),
active AS (
  SELECT c.capture_id, s.list, s.pattern FROM captures c JOIN states s
  ON (c.host = s.pattern OR (ends_with(c.host, '.' || s.pattern) AND contains(s.pattern, '.')))
  AND s.day <= c.day AND (s.next IS NULL OR s.next > c.day)
  WHERE NOT s.gone AND c.host <> ''),
found AS (
  SELECT capture_id, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists, count(*) AS n_active,
    (max({'size': length(pattern), 'pattern': pattern})).pattern AS pattern
  FROM active GROUP BY capture_id)
SELECT c.capture_id, c.host, c.day, coalesce(f.n_active, 0) AS n_active, coalesce(f.lists, '') AS lists, coalesce(f.pattern, '') AS pattern
FROM captures c LEFT JOIN found f USING (capture_id)
"""
