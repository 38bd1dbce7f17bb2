"""URL filters as a temporal list join: dated entries become validity intervals, captures meet the entries active at fetch time.

An entry is about a host with all its subdomains (``example.com``) or about a host and a path prefix (``example.com/news``).
The latest entry of a pattern holds until its next one. Captures are reduced to distinct (URL, day) before the join, which is an
equi-join on the pattern with the interval as a condition; the most specific active entry decides. A URL is spread over the
numbers of host labels and path segments that entries have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^?#]*)", 1)


def patterns_of(url: Column, labels: list[int], segments: list[int]) -> Column:
    """Every pattern with these numbers of labels or segments that covers a URL: its host, the parent domains, and the host with
    path prefixes of whole segments."""
    host = F.split(host_of(url), r"\.")
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    counts = lambda numbers, most: F.filter(F.array(*map(F.lit, numbers)).cast("array<int>"), lambda n: n <= most)
    domains = F.transform(counts(labels, F.size(host)), lambda n: F.array_join(F.slice(host, -n, n), "."))
    paths = F.transform(counts(segments, F.size(parts)), lambda n: F.concat_ws("/", host_of(url), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(F.coalesce(F.length(host_of(url)), F.lit(0)) > 0, F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to): entries (pattern, action, listed_on) as half-open intervals, the last one open.

    Entries of one pattern and day count as one, and ``block`` wins; so a pattern has at most one row a day.
    Entries without a pattern, an action or a date are left out. Hosts are lower-cased, paths keep their case.
    """
    sound = entries.filter(F.col("pattern").isNotNull() & F.col("listed_on").isNotNull() & F.col("action").isin("block", "allow"))
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.substr("pattern", F.length(host) + 1))
    daily = sound.groupBy(pattern.alias("pattern"), "listed_on").agg(F.max("action").alias("action"))
    later = F.lead("listed_on").over(Window.partitionBy("pattern").orderBy("listed_on"))
    return daily.select("pattern", "action", F.col("listed_on").alias("valid_from"), later.alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", date_col: str = "fetched_on") -> DataFrame:
    """Adds blocked boolean, pattern and action (null where no entry was active) to every row of ``captures``.

    Path entries beat host entries, then the longer pattern wins. Rows without a URL, a host or a date match nothing and
    are not blocked; repeated rows stay. Columns of captures named like the added ones are replaced.
    """
    keys = captures.filter(F.col(url_col).isNotNull() & F.col(date_col).isNotNull()).select(
        F.col(url_col).alias("_url"), F.col(date_col).alias("_day")).distinct()
    listed = staged(intervals(entries), "intervals")
    labels = F.when(~F.contains("pattern", F.lit("/")), F.size(F.split("pattern", r"\.")))
    segments = F.when(F.contains("pattern", F.lit("/")), F.size(F.split("pattern", "/")) - 1)
    # A few numbers: the different lengths of entries
    found = listed.agg(F.collect_set(labels).alias("labels"), F.collect_set(segments).alias("segments")).first()
    spread = keys.withColumn("pattern", F.explode(patterns_of(F.col("_url"), sorted(found["labels"]), sorted(found["segments"]))))
    active = spread.join(listed, "pattern").filter(
        (F.col("valid_from") <= F.col("_day")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))))
    rank = F.struct(F.contains("pattern", F.lit("/")).alias("path"), F.length("pattern").alias("size"), F.col("pattern"), F.col("action"))
    verdict = active.groupBy("_url", "_day").agg(F.max(rank).alias("_best"))
    plain = captures.drop("blocked", "pattern", "action")
    joined = plain.join(verdict, (F.col(url_col) == F.col("_url")) & (F.col(date_col) == F.col("_day")), "left")
    return joined.select(
        *[plain[c] for c in plain.columns], F.coalesce(F.col("_best.action") == "block", F.lit(False)).alias("blocked"),
        F.col("_best.pattern").alias("pattern"), F.col("_best.action").alias("action"))
