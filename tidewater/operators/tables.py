"""Keyed table maintenance and dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import zone_letters
from ..plans.frames import staged
from ..plans.ordering import join_null_safe, row_index
from .temporal import first_per_key, latest_per_key


def field_map(df: DataFrame, mapping: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Target columns from the first non-null of their source columns; absent sources count as missing."""
    targets = []
    for target, sources in mapping.items():
        present = [F.col(s) for s in sources if s in df.columns]
        targets.append((F.coalesce(*present) if present else F.lit(None).cast("double")).alias(target))
    return df.select(*keep, *targets)


def keep_present(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.select(*ids, *[c for c in columns if c in df.columns])


def insert_new_only(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is new, one per key."""
    return first_per_key(incoming, key, order).join(existing.select(*key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Existing rows replaced by incoming rows of the same key, new keys added.

    Of several incoming rows of one key the last along ``order`` counts; without an order, that with the smallest values.
    """
    newest = latest_per_key(incoming, key, order) if order else incoming
    ranked = newest.withColumn("_rank", F.lit(0)).unionByName(
        existing.withColumn("_rank", F.lit(1)), allowMissingColumns=True
    )
    return first_per_key(ranked, key, ["_rank"]).drop("_rank")


def union_prefer_first(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Union by name where the earliest table wins a shared key."""
    whole = tables[0].withColumn("_rank", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        whole = whole.unionByName(t.withColumn("_rank", F.lit(i)), allowMissingColumns=True)
    return first_per_key(whole, key, ["_rank"]).drop("_rank")


def patch_column(df: DataFrame, patch: DataFrame, keys: list[str], column: str, digits: int = 6) -> DataFrame:
    """Left-join one new column on rounded keys; a table that already has the column is returned unchanged."""
    if column in df.columns:
        return df
    rounded = lambda t: [F.round(k, digits).alias(f"_{k}") if dict(t.dtypes)[k] in ("double", "float") else F.col(k).alias(f"_{k}") for k in keys]
    right = patch.select(*rounded(patch), column)
    temp = [f"_{k}" for k in keys]
    return df.select("*", *rounded(df)).join(right, temp, "left").drop(*temp)


def fill_ratio(df: DataFrame, column: str) -> Column:
    return F.avg(F.col(column).isNotNull().cast("double"))


#: Letters of the longest gram in the index of names
GRAM = 3


def _grams(text: Column, widths: range) -> Column:
    """Every distinct substring of the given widths."""
    of_width = lambda n: F.when(
        F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of_width(n) for n in widths])))


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(_s, _t): every pair of distinct texts of which ``_s``, of more than GRAM letters, lies in ``_t``.

    A short text meets the long ones that hold its rarest gram, and one of whose grams no long text holds meets none.
    """
    own = range(GRAM, GRAM + 1)
    postings = staged(long.select("_t", F.explode(_grams(F.col("_t"), own)).alias("_g")), "grams")
    held = postings.groupBy("_g").agg(F.count("*").alias("_n"))
    asked = short.filter(F.length("_s") > GRAM).select("_s", F.explode(_grams(F.col("_s"), own)).alias("_g")).join(held, "_g", "left")
    rarest = asked.groupBy("_s").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_r")).filter("_r.n > 0")
    met = rarest.select("_s", F.col("_r.g").alias("_g")).join(postings, "_g")
    return met.filter(F.contains("_t", "_s")).select("_s", "_t")


def fuzzy_name_join(df: DataFrame, names: DataFrame, name: str, key: str = "known_name", rank: str = "rank") -> DataFrame:
    """Exact name match, else the first known name that contains, or is contained in, the row's name.

    Distinct names are matched once, through an index of their grams: a name brings in as many entries as it has letters, and
    names of up to GRAM letters are entries themselves, for which the best-ranked known name is found beforehand.
    """
    columns = [c for c in names.columns if c != key]
    rest = [c for c in columns if c != rank]
    best = F.min(F.struct(rank, *rest)).alias("_m")
    asked = staged(df.select(F.col(name).alias("_t")).distinct().filter(F.length("_t") > 0), "asked")
    whole = staged(names.filter(F.length(key) > 0).groupBy(F.col(key).alias("_s")).agg(best), "names")
    short = range(1, GRAM + 1)
    exact = asked.join(whole, asked["_t"] == whole["_s"]).select("_t", F.lit(0).alias("_loose"), "_m.*")
    parts = whole.select(F.explode(_grams(F.col("_s"), short)).alias("_g"), "_m").groupBy("_g").agg(F.min("_m").alias("_m"))
    inside = asked.select("_t", F.explode(_grams(F.col("_t"), short)).alias("_s")).join(whole, "_s").select("_t", "_m").unionByName(
        _contained(whole.select("_s"), asked).join(whole, "_s").select("_t", "_m"))
    known, wanted = whole.select(F.col("_s").alias("_t")), asked.select(F.col("_t").alias("_s"))
    around = asked.join(parts, asked["_t"] == parts["_g"]).select("_t", "_m").unionByName(
        _contained(wanted, known).withColumnsRenamed({"_s": "_a", "_t": "_s"}).join(whole, "_s").select(F.col("_a").alias("_t"), "_m"))
    loose = inside.unionByName(around).select("_t", F.lit(1).alias("_loose"), "_m.*")
    matched = first_per_key(exact.unionByName(loose), ["_t"], ["_loose", rank]).withColumnRenamed("_t", name)
    return df.join(matched.drop("_loose", rank), name, "left")


def zone_codes(farms: DataFrame, region: str, farm: str, size: int = 9) -> DataFrame:
    """Zone code per farm: within a region north to south, west to east, ``size`` farms per letter."""
    placed = row_index(
        farms.withColumn("_south", -F.col("lat")), [region], [("_south", True), ("lon", True), (farm, True)], "_pos"
    )
    i = F.col("_pos") - 1
    number = F.lpad((i % size + 1).cast("string"), 2, "0")
    return placed.withColumn(
        "zone", F.concat(zone_letters(F.floor(i / size)), F.lit("-"), number)
    ).drop("_pos", "_south")


def duplicate_labels(farms: DataFrame, name: str, farm: str) -> DataFrame:
    """Name plus '#k' where the name occurs more than once."""
    counts = farms.groupBy(name).agg(F.count("*").alias("_n"))
    placed = join_null_safe(row_index(farms, [name], [(farm, True)], "_k"), counts, [name])
    return placed.withColumn(
        "label", F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit(" #"), F.col("_k").cast("string"))).otherwise(F.col(name))
    ).drop("_n", "_k")


def group_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """Membership rows with the size of their group, instead of one unbounded list per group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size"))
    return join_null_safe(df.select(group, member), sizes, [group])


def token_search(df: DataFrame, query: str, haystack: Column, limit: int = 300, order: list[Column] | None = None) -> DataFrame:
    """Rows whose text contains every whitespace token of the query, at most ``limit``."""
    tokens = [t for t in query.lower().split() if t]
    hit = F.lit(True)
    for token in tokens:
        hit = hit & F.contains(F.lower(haystack), F.lit(token))
    found = df.filter(hit)
    return (found.orderBy(*order) if order else found).limit(limit)
