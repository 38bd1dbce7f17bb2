"""Benchmark leaks, re-parameterised ones included, with column functions only.

Texts are brought to templates: numbers, names (runs of title-case words that do not begin a sentence) and units after a number
become typed placeholders, everything else is lower-cased words, or single characters in scripts that are written without spaces. A
title-case word that begins a sentence is read as a word and, where the text has it as a name elsewhere, in a second reading as a name. Windows of template tokens of the documents are hash-joined with
those of the benchmark; matches of one item within about its length count together, so words put in or left out between them
do no harm. Where enough of an item's windows match, the values of the placeholders in them must be the item's own, or
consistent: one benchmark value stands for one document value at most places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

WINDOW, COVERAGE, LITERALS = 8, 0.5, 3
#: Benchmark windows (16 bytes each and their hash table) up to this number are broadcast, else joined by a shuffle
BROADCAST_WINDOWS = 1 << 18
#: Matched documents up to this number are broadcast to read their texts again
BROADCAST_IDS = 1 << 20
#: Marks before a number, a name and a unit, after a name, and before a title-case word that begins a sentence
NUMBER, NAME, UNIT, END, MAYBE = "\x04", "\x05", "\x06", "\x07", "\x03"
UNITS = (
    "mm|cm|m|km|in|ft|yd|mi|mg|g|kg|t|oz|lb|lbs|ml|l|cl|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|usd|eur|dollars|euros|cents|"
    "percent|meters|metres|kilometers|kilometres|miles|inches|feet|grams|kilograms|liters|litres|watts|volts|degrees"
)
#: Thai and Lao, Myanmar, Khmer, kana, Chinese characters
_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}"
_WORD = rf"(?:[\p{{L}}&&[^{_UNSPACED}]][\p{{L}}\p{{M}}&&[^{_UNSPACED}]]*|[{_UNSPACED}&&\p{{L}}]\p{{M}}*)"
_NUM = r"[0-9]+(?:[.,][0-9]+)*+"


def _plain(text: Column) -> Column:
    """The text, null as empty, without the control characters that serve as placeholders."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t.rlike(r"[\x03-\x07]"), F.translate(t, NUMBER + NAME + UNIT + END + MAYBE, "     ")).otherwise(t)


_TITLE = r"\p{Lu}\p{Ll}++(?![\p{L}\p{M}])"
_BEGIN = r"(?:^|[.!?:;\n])[\"'()\[\]*\s]{0,3}"


def with_names(text: Column) -> Column:
    """The text with its names marked: runs of title-case words that do not begin a sentence."""
    # Cheap look at the first letter, then what stands before it: a letter, or the end of a sentence and up to three marks
    name = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}])(?<!{_BEGIN}){_TITLE}(?:[ \t -]+{_TITLE})*+"
    return F.regexp_replace(_plain(text), name, f"{NAME}$0{END}")


def tokens(named: Column) -> Column:
    """Lower-cased words of a text with marked names, a run of name words as one; numbers, names and units are led by their mark."""
    t = F.regexp_replace(named, _NUM, f" {NUMBER}$0 ")
    unit = rf"({NUMBER}[0-9.,]++\s*)((?i:{UNITS})(?![\p{{L}}\p{{M}}]))"
    t = F.regexp_replace(t, unit, f"$1{UNIT}$2")
    found = F.regexp_extract_all(F.lower(t), F.lit(f"{NAME}[^{END}]*{END}|{NUMBER}{_NUM}|[{UNIT}{MAYBE}]?{_WORD}"), 0)
    return F.transform(found, lambda x: F.when(x.startswith(NAME), F.concat(F.lit(NAME), F.array_join(_words(x), " "))).otherwise(x))


def read_twice(text: Column) -> Column:
    """Marked tokens of a text, where a word that begins a sentence has the mark MAYBE if the text has names at all."""
    begin = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}{NAME}])(?<={_BEGIN}){_TITLE}"
    return _let(with_names(text), lambda named: tokens(F.when(F.contains(named, F.lit(NAME)), F.regexp_replace(named, begin, f"{MAYBE}$0")).otherwise(named)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _unsure(token: Column) -> Column:
    return token.startswith(MAYBE)


def _bare(token: Column) -> Column:
    return F.substr(token, F.lit(2))


def first_reading(read: Column) -> Column:
    """Tokens of ``read_twice`` with sentences beginning with plain words."""
    return F.transform(read, lambda x: F.when(_unsure(x), _bare(x)).otherwise(x))


def second_reading(read: Column) -> Column:
    """The same tokens with words that begin a sentence as names where they are names elsewhere in the text; null where there are none."""
    known = F.array_distinct(F.flatten(F.transform(F.filter(read, lambda x: x.startswith(NAME)), _words)))
    name = lambda names, x: _unsure(x) & F.array_contains(names, _bare(x))
    resolved = lambda names: F.when(F.exists(read, lambda x: name(names, x)), F.transform(
        read, lambda x: F.when(name(names, x), F.concat(F.lit(NAME), _bare(x))).when(_unsure(x), _bare(x)).otherwise(x)))
    return F.when(F.exists(read, _unsure), _let(known, resolved))


def marked(text: Column) -> Column:
    """Marked tokens of a text, sentences beginning with plain words."""
    return first_reading(read_twice(text))


def _words(name: Column) -> Column:
    return F.filter(F.split(name, r"[^\p{L}\p{M}]+", -1), lambda x: x != "")


def _kind(token: Column) -> Column:
    """The template token of a marked one."""
    return F.when(token < "\x08", F.left(token, F.lit(1))).otherwise(token)


def template(text: Column) -> Column:
    """Template tokens of a text."""
    return F.transform(marked(text), _kind)


def _named(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def _least(width: int | Column, literals: int) -> Column:
    """Plain tokens that a window needs to be compared as a template; one with fewer is compared by its values."""
    return F.least(F.lit(literals), F.greatest(F.lit(1), F.lit(width) - 1))


def _windows(docs: DataFrame, widths: list[int], literals: int, keep: list[str]) -> DataFrame:
    """(keep..., at, h) for every window of each of the ``widths`` of the marked tokens ``m``."""
    tokens = docs.withColumn("t", F.transform("m", _kind)).filter(F.size("t") >= min(widths))
    spread = tokens.select(*keep, "m", "t", F.explode(F.sequence(F.lit(0), F.size("t") - min(widths))).alias("at"))

    def value(width: int) -> Column:
        at = lambda name: [F.get(name, F.col("at") + k) for k in range(width)]
        plain = sum(((x >= "\x08").cast("int") for x in at("t")), F.lit(0))
        return F.when(plain >= _least(width, literals), F.xxhash64(F.lit(width), *at("t"))).otherwise(F.xxhash64(F.lit(width), *at("m")))

    if len(widths) == 1:
        return spread.select(*keep, "at", value(widths[0]).alias("h"))
    every = F.array(*[F.when(F.col("at") + w <= F.size("t"), value(w)) for w in widths])
    return spread.select(*keep, "at", F.explode(every).alias("h")).filter("h is not null")


def benchmark_forms(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(key, item, n, n_windows, forms): every item's text as a template, with its first word read as a name too, with names read as
    plain words too, and in its second reading. A form is an array of template token x, marked token y, value v and the token's position p in the first form."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    items = items.withColumn("read", read_twice(F.col("text"))).withColumn("m", first_reading(F.col("read"))).select(
        F.monotonically_increasing_id().alias("key"), "item", "m", F.coalesce(second_reading(F.col("read")), "m").alias("m2"),
        F.regexp_extract(_plain(F.col("text")), f"{_NUM}|{_WORD}", 0).rlike(r"^\p{Lu}\p{Ll}+$").alias("title")).filter("size(m) > 0")

    def token(y: Column, p: Column) -> Column:
        return F.struct(_kind(y).alias("x"), y.alias("y"), F.when(y < "\x08", F.substr(y, F.lit(2))).otherwise(y).alias("v"), p.alias("p"))

    first, second = F.get("m", F.lit(0)), F.get("m", F.lit(1))
    run = F.coalesce(second.startswith(NAME), F.lit(False))
    led = F.when(run, F.concat(F.lit(NAME), first, F.lit(" "), F.substr(second, F.lit(2)))).otherwise(F.concat(F.lit(NAME), first))
    items = items.withColumn("f", F.transform("m", token))
    forms = F.array(
        F.col("f"),
        F.when(F.col("title"), F.concat(F.array(token(led, run.cast("int"))), F.slice("f", run.cast("int") + 2, F.size("f")))).otherwise(F.col("f")),
        F.flatten(F.transform("f", lambda t: F.when(t["x"] == NAME, F.transform(_words(t["v"]), lambda w: token(w, t["p"]))).otherwise(F.array(t)))),
        F.transform("m2", token),
    )
    n = F.size("m")
    return items.select("key", "item", n.alias("n"), (n - F.least(n, F.lit(window)) + 1).alias("n_windows"), F.array_distinct(forms).alias("forms"))


def benchmark_windows(items: DataFrame, window: int, literals: int) -> DataFrame:
    """(key, n, n_windows, width, h, j, form, start): windows of every form; ``j`` is the window of the first form that begins there.

    A form shorter than ``window`` is one window of its own width. Windows with fewer than ``literals`` plain tokens (or, in short
    items, fewer than their width less one) say nothing about a template and are compared by their values; a short item without
    any word is left out."""
    every = items.select("key", "n", "n_windows", F.posexplode("forms").alias("form", "f")).withColumn("width", F.least(F.size("f"), F.lit(window)))
    spread = every.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("f") - F.col("width"))))
    cut = spread.withColumn("w", F.slice("f", F.col("start") + 1, F.col("width")))
    plain = F.size(F.filter("w", lambda t: ~_named(t["x"])))
    cut = cut.withColumn("plain", plain).filter((F.col("plain") > 0) | (F.col("width") == window))
    read = F.when(F.col("plain") >= _least(F.col("width"), literals), F.transform("w", lambda t: t["x"])).otherwise(F.transform("w", lambda t: t["y"]))
    cut = cut.withColumn("read", read)
    widths = [F.when(F.col("width") == k, F.xxhash64(F.lit(k), *[F.get("read", F.lit(i)) for i in range(k)])) for k in range(1, window + 1)]
    j = F.least(F.get("w", F.lit(0))["p"], F.col("n_windows") - 1).alias("j")
    made = cut.select("key", "n", "n_windows", "width", F.coalesce(*widths).alias("h"), j, F.struct("form", "start").alias("from"))
    return made.groupBy("key", "n", "n_windows", "width", "h", "j").agg(F.min("from").alias("from")).select("*", "from.*").drop("from")


def _readings(rows: DataFrame) -> DataFrame:
    """(id, row, m) per reading of each of the ``rows`` (id, row, text): a second one counts as a row of its own."""
    read = rows.withColumn("read", read_twice(F.col("text"))).withColumn("m2", second_reading(F.col("read")))
    second = F.when(F.col("m2").isNotNull(), F.struct(F.xxhash64("row").alias("row"), F.col("m2").alias("m")))
    return read.select("id", F.inline(F.array_compact(F.array(F.struct("row", first_reading(F.col("read")).alias("m")), second))))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, literals: int = LITERALS,
) -> DataFrame:
    """(id_col, item_col, matched, n_windows, coverage, exact, slots): the benchmark items that a document holds.

    A pair is returned when at least ``coverage`` of the item's windows match, in about the item's length, with the item's own slot
    values, or with the value that the document has at most places of each of the item's values; ``matched`` counts these windows,
    ``exact`` tells that all slot values in matched windows are the item's own, ``slots`` how many pairs of values there are. Rows that share an id are judged one
    by one, and the best counts. Null and empty texts hold nothing; null ids take no part; of items that share an id each text counts.
    """
    items = staged(benchmark_forms(benchmark.filter(F.col(item_col).isNotNull()), item_col, item_text_col, window), "benchmark_forms")
    marks = staged(benchmark_windows(items, window, literals), "benchmark_windows")
    found = marks.agg(F.count("*"), F.collect_set("width")).first()
    few = found[0] <= BROADCAST_WINDOWS
    text = F.col(text_col).cast("string")
    rows = docs.filter(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    known = _readings(rows)
    # At most ``window`` different widths: that of long items, and those of items shorter than it
    own = marks.drop("width")
    matches = _windows(known, sorted(found[1] or [window]), literals, ["id", "row"]).join(F.broadcast(own) if few else own, "h").withColumn("shift", F.col("at") - F.col("j"))
    # Two rows of bands, half a band apart: shifts that differ by up to half the item's length share a band
    pair = ["id", "row", "key", "n", "n_windows"]
    place = F.first(F.struct("j", "form", "start", "at"))
    shifts = matches.groupBy(*pair, "shift", "j").agg(place.alias("w")).groupBy(*pair, "shift").agg(F.collect_list("w").alias("w"))
    wide = F.greatest("n", F.lit(window))
    bands = F.array(*[F.struct(F.lit(k).alias("k"), F.floor((F.col("shift") + k * wide / 2) / wide).alias("b")) for k in (0, 1)])
    spread = shifts.withColumn("band", F.explode(bands)).select(*pair, "band", "shift", F.size("w").alias("support"), F.explode("w").alias("w"))
    # Of several places of a window, the one whose shift most windows share
    once = spread.groupBy(*pair, "band", F.col("w.j").alias("j")).agg(F.max(F.struct("support", -F.col("shift"), "w"))["w"].alias("w"))
    banded = once.groupBy(*pair, "band").agg(F.collect_list("w").alias("w"))
    aligned = staged(banded.filter(F.size("w") >= coverage * F.col("n_windows")), "alignments")
    ids = staged(aligned.select("id").distinct(), "leaking")
    small = ids.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(ids) if small else ids, "id", "left_semi").dropDuplicates(["id", "row"])
    both = aligned.join(_readings(texts), ["id", "row"]).join(items.select("key", "item", "forms"), "key")

    def slots(w: Column) -> Column:
        """Item's value ``a`` and document's value ``b`` of every placeholder of a window."""
        part = F.slice(F.get("forms", w["form"]), w["start"] + 1, F.lit(window))
        values = F.transform(part, lambda t, i: F.struct(
            t["p"].alias("p"), _named(t["x"]).alias("named"), t["v"].alias("a"), F.substr(F.get("m", w["at"] + i), F.lit(2)).alias("b")))
        return F.transform(F.filter(values, lambda x: x["named"]), lambda x: F.struct(x["p"].alias("p"), x["a"].alias("a"), x["b"].alias("b")))

    windows = both.select("id", "item", "n_windows", F.transform("w", slots).alias("w"))
    pairs = F.array_distinct(F.transform(F.flatten("w"), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    windows = windows.withColumn("pairs", pairs).withColumn("own", F.size(F.filter("w", lambda w: F.forall(w, lambda x: x["a"] == x["b"]))))
    exact = F.col("own") == F.size("w")
    places = F.when(exact, F.array().cast("array<struct<p:int,a:string,b:string>>")).otherwise(F.array_distinct(F.flatten("w")))
    windows = windows.withColumn("places", places).withColumn("values", F.array_distinct(F.transform("places", lambda x: x["a"])))

    def most(a: Column) -> Column:
        """The document's value at most places of the item's value ``a``, null where it has no more than half of them."""
        there = F.filter("places", lambda x: x["a"] == a)
        counts = F.transform(F.array_distinct(F.transform(there, lambda x: x["b"])), lambda b: F.struct(F.size(F.filter(there, lambda x: x["b"] == b)).alias("n"), b.alias("b")))
        return F.when(F.array_max(counts)["n"] * 2 > F.size(there), F.array_max(counts)["b"])

    windows = windows.withColumn("mapping", F.map_from_arrays("values", F.transform("values", most)))
    consistent = F.forall(F.map_values("mapping"), lambda b: b.isNotNull())
    follow = F.size(F.filter("w", lambda w: F.forall(w, lambda x: F.element_at("mapping", x["a"]) == x["b"])))
    judged = windows.withColumn("matched", F.when(~exact & consistent, F.greatest("own", follow)).otherwise(F.col("own")))
    best = judged.filter(F.col("matched") >= coverage * F.col("n_windows")).select(
        "id", "item", F.struct(
            (F.col("matched") / F.col("n_windows")).alias("coverage"), exact.alias("exact"), "matched", "n_windows", F.size("pairs").alias("slots")).alias("best"))
    return best.groupBy("id", "item").agg(F.max("best").alias("best")).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.matched").cast("bigint").alias("matched"),
        F.col("best.n_windows").cast("bigint").alias("n_windows"), F.col("best.coverage").alias("coverage"), F.col("best.exact").alias("exact"),
        F.col("best.slots").cast("bigint").alias("slots"))
