"""Dated URL lists applied to dated captures: entries become validity intervals, captures join those of their time.

Only DataFrame operations. Intervals and captures meet by equality of pattern and month, so a pattern that most captures
share is spread over its months and, within one, left to adaptive skew splitting; no window runs over captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: On one day the entry of a pattern with the greatest strength counts.
STRENGTH = {"remove": 0, "allow": 1, "block": 2}


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", found)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def candidates(url: Column, depth: int) -> Column:
    """Patterns that cover a URL: its host, its parent domains of two labels or more, and its host with path beginnings of up to ``depth`` segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    within = F.least(F.size(segments), F.lit(depth))
    paths = F.when(within > 0, F.transform(F.sequence(F.lit(1), within), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))))
    none = F.array().cast("array<string>")
    return F.when(host.isNotNull(), F.concat(F.array(host), F.coalesce(parents, none), F.coalesce(paths, none)))


def validity(entries: DataFrame) -> DataFrame:
    """``pattern, action, valid_from, valid_to`` (open end: null) of dated entries ``pattern, action, listed_on``.

    An entry holds until the pattern's next one. Entries without pattern or date, or with another action, are ignored.
    """
    strength = F.create_map(*(F.lit(x) for pair in STRENGTH.items() for x in pair))
    usable = entries.where(F.col("pattern").isNotNull() & F.col("listed_on").isNotNull() & F.col("action").isin(*STRENGTH))
    daily = usable.groupBy("pattern", "listed_on").agg(F.max_by("action", strength[F.col("action")]).alias("action"))
    follows = Window.partitionBy("pattern").orderBy("listed_on")
    spans = daily.select("pattern", "action", F.col("listed_on").alias("valid_from"), F.lead("listed_on").over(follows).alias("valid_to"))
    return spans.where("action <> 'remove'")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Verdict of every capture ``page_id, url, fetched_at``: ``page_id, url, fetched_at, pattern, action, blocked``.

    Of the patterns that cover the URL and are active at the time of the fetch the longest decides (equal lengths: the
    greatest in string order). With none, or a null or unreadable URL, or a null time, ``pattern`` and ``action`` are
    null and the capture isn't blocked. Repeated captures each get a row. Extra columns are not read.
    """
    spans = validity(entries)
    bounds = captures.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    depth = entries.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    month = lambda c: F.trunc(c, "month")
    low, high = (F.lit(b).cast("timestamp") for b in bounds)
    first = F.greatest(month(F.col("valid_from")), month(low))
    last = F.least(month(F.coalesce(F.col("valid_to").cast("timestamp"), high)), month(high))
    active = spans.where(first <= last).withColumn("month", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))

    rows = captures.select(F.col(id_col).alias("page_id"), "url", F.col("fetched_at").cast("timestamp").alias("fetched_at")).withColumn("row", F.monotonically_increasing_id())
    asked = rows.withColumn("month", month(F.col("fetched_at"))).withColumn("asked", F.explode_outer(candidates(F.col("url"), depth)))
    at = F.to_timestamp("valid_from"), F.to_timestamp("valid_to")
    in_force = (F.col("fetched_at") >= at[0]) & (at[1].isNull() | (F.col("fetched_at") < at[1]))
    joined = asked.join(active.withColumnRenamed("month", "in_month"), (F.col("asked") == F.col("pattern")) & (F.col("month") == F.col("in_month")) & in_force, "left")
    rank = F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), F.col("pattern").alias("pattern"), F.col("action").alias("action")))
    best = joined.groupBy("row", "page_id", "url", "fetched_at").agg(F.max(rank).alias("best"))
    return best.select("page_id", "url", "fetched_at", "best.pattern", "best.action", F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"))


def _number(key: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(key), first, digits), 16, 10).cast("long")


def sample_captures(pages: DataFrame) -> DataFrame:
    """Captures of the ``pages`` table, which has no times: within 2024, by a hash of the id."""
    hours = _number(F.col("page_id").cast("string"), 1, 8) % (366 * 24)
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), hours.cast("int"))).alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list about the hosts of ``pages``: per host up to two entries for it, one for its parent domain, one for a path."""
    host = host_of(F.col("url"))
    seen = pages.select(host.alias("host"), F.regexp_extract(path_of(F.col("url")), "^(/[^/]+)", 1).alias("path")).where("host is not null").groupBy("host").agg(F.min("path").alias("path"))
    numbered = seen.withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    key = F.concat_ws(":", "host", F.col("k").cast("string"))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    pattern = F.when(F.col("k") < 2, F.col("host")).when(F.col("k") == 2, parent).otherwise(F.concat("host", "path"))
    action = F.element_at(F.array(*map(F.lit, ("block", "allow", "remove"))), (_number(key, 5, 4) % 3 + 1).cast("int"))
    listed = F.date_add(F.lit("2024-01-01").cast("date"), (_number(key, 9, 4) % 366).cast("int"))
    return numbered.where(_number(key, 1, 4) % 3 > 0).select(pattern.alias("pattern"), action.alias("action"), listed.alias("listed_on"))
