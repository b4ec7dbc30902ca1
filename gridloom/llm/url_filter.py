"""URL filters by a temporal list join.

Dated list events (an entry is added or removed on a day) become validity
intervals; each capture is evaluated, as of its fetch day, against the entries
active then. An entry covers its host and all hosts below it; of several active
entries the longest decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables


def intervals(events: DataFrame) -> DataFrame:
    """(entry, valid_from, valid_to) from (entry, day, action): an `add` holds until the entry's next event.

    Of several events of an entry on one day, `remove` counts. Rows with a null are left out.
    """
    daily = events.where(F.col("entry").isNotNull() & F.col("day").isNotNull() & F.col("action").isNotNull()).groupBy(F.lower("entry").alias("entry"), "day").agg(F.max("action").alias("action"))
    spans = daily.withColumn("valid_to", F.lead("day").over(Window.partitionBy("entry").orderBy("day")))
    return spans.where(F.col("action") == "add").select("entry", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """`captures` (url, fetched) with host, matched_entry and blocked; earlier columns of these names are replaced.

    Null or malformed urls have a null host; they, and captures without a fetch day, are not blocked.
    Every row stays, repeated ones too. Captures are made distinct by host and day before the list
    join, so a host that holds most captures is a few rows there, and is spread by day where verdicts join back.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = captures.drop("host", "matched_entry", "blocked").withColumn("host", F.when(host != "", host))
    seen = rows.select("host", "fetched").where(F.col("host").isNotNull() & F.col("fetched").isNotNull()).distinct()
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = seen.withColumn("name", F.explode(names))
    active = intervals(events)
    during = (asked["name"] == active["entry"]) & (active["valid_from"] <= asked["fetched"]) & (active["valid_to"].isNull() | (asked["fetched"] < active["valid_to"]))
    verdicts = asked.join(active, during).groupBy("host", "fetched").agg(F.max_by("entry", F.length("entry")).alias("matched_entry"))
    return rows.join(verdicts, ["host", "fetched"], "left").select(*rows.columns, "matched_entry", F.col("matched_entry").isNotNull().alias("blocked"))


START = "DATE'2024-01-01'"


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page, repeated ones too: page_id, host, fetched, matched_entry, blocked. A null or malformed url has a null host and is
    not blocked, nor is a page without an id, which has no day; an empty table gives no rows.

    `pages` has neither fetch days nor lists, so both are derived: a page is fetched page_id mod 365 days
    after the start of 2024; each host, and each name without its first label, is added, removed
    40 days later and, if its least page_id is even, added again after 100 days.
    """
    pages = tables.read(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"date_add({START}, cast(pmod(page_id, 365) as int))").alias("fetched"))
    hosts = pages.select("page_id", F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)).alias("host"))
    named = hosts.groupBy("host").agg(F.min("page_id").alias("least"))
    named = named.union(named.where("host like '%.%.%.%'").select(F.regexp_replace("host", r"^[^.]+\.", ""), "least")).where("host != ''").groupBy("host").agg(F.min("least").alias("least"))
    day = F.expr("cast(pmod(least * 7 + length(host) * 13, 365) as int)")
    steps = F.expr("array(named_struct('action', 'add', 'after', 0), named_struct('action', 'remove', 'after', 40), named_struct('action', if(least % 2 = 0, 'add', null), 'after', 100))")
    events = named.select(F.col("host").alias("entry"), day.alias("from"), F.explode(steps).alias("s")).select("entry", F.expr(f"date_add({START}, `from` + s.after)").alias("day"), F.col("s.action").alias("action"))
    return evaluate(pages, events).select("page_id", "host", "fetched", "matched_entry", "blocked")


OP4_SQL = r"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host, CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS fetched FROM pages),
n AS (SELECT host, min(page_id) AS least FROM p WHERE host IS NOT NULL GROUP BY host),
a AS (SELECT host, min(least) AS least FROM (SELECT * FROM n UNION ALL SELECT regexp_replace(host, '^[^.]+\.', ''), least FROM n WHERE host LIKE '%.%.%.%') GROUP BY host),
i AS (
  SELECT host AS entry, day AS f, day + 40 AS t FROM (SELECT *, CAST((least * 7 + length(host) * 13) % 365 AS INTEGER) AS day FROM a)
  UNION ALL SELECT host, day + 100, NULL FROM (SELECT *, CAST((least * 7 + length(host) * 13) % 365 AS INTEGER) AS day FROM a) WHERE least % 2 = 0),
m AS (SELECT p.page_id, arg_max(i.entry, length(i.entry)) AS matched_entry
  FROM p JOIN i ON (p.host = i.entry OR p.host LIKE '%.' || i.entry) AND i.f <= p.page_id % 365 AND (i.t IS NULL OR p.page_id % 365 < i.t) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.fetched, m.matched_entry, m.matched_entry IS NOT NULL AS blocked FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
