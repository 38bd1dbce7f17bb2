"""Chat formatting into budgeted windows, with column functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: the token axis is divided into cells of ``span``
tokens; turns that lie inside one cell make one window, a turn that crosses a cell border makes a window of its own. So no
window's new turns exceed the span unless a single turn does, and no window depends on another one's end. Every window
repeats the system turn and the latest turns before it that fit ``history`` tokens. The loss mask covers the assistant texts
of new turns alone.

A turn is written ``### role: text</turn>`` and a line break. Inside roles and texts a backslash goes before every backslash
and ``#``, and into ``</turn>`` after its ``<`` (in roles also before ``:``), so control strings never occur in content and
``unescape`` restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

START, END = "### ", "</turn>\n"
#: Turns of one conversation are summed in ranges of this many turn numbers, then range by range
_RANGE = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\#]|(?<=<)/(?=turn>)", r"\\$0")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\#:]|(?<=<)/(?=turn>)", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """Token estimate of a turn: its words and four for the template."""
    return F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")) + 4


def _placed(turns: DataFrame, system_role: str) -> DataFrame:
    """Adds _pos (0-based position), _system, _start and _end (token sums over the other turns)."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = turns.withColumn("_range", F.coalesce(F.floor(F.col("turn") / _RANGE), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "_range").orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(inside))
    # The first turn of the conversation is the first of its lowest range
    first_range = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.min("_range").alias("_r")).withColumn("_f", F.lit(True))
    marked = numbered.join(first_range, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")), "left")
    system = F.coalesce(F.col("_f") & (F.col("_at") == 1) & (F.col("role") == system_role), F.lit(False))
    marked = marked.withColumn("_system", system).drop("_c", "_r", "_f").withColumn(
        "_own", F.when(F.col("_system"), F.lit(0)).otherwise(F.col("tokens")).cast("bigint"))
    sums = marked.groupBy("conv_id", "_range").agg(F.sum("_own").alias("_sum"), F.count("*").alias("_rows"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("conv_id").alias("_c"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    run = F.sum("_own").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("_run", run).join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")))
        .withColumn("_end", F.col("_base") + F.col("_run")).withColumn("_start", F.col("_end") - F.col("_own"))
        .withColumn("_pos", F.col("_first") + F.col("_at") - 1)
        .drop("_c", "_r", "_base", "_first", "_run", "_range", "_at", "_own")
    )


def format_windows(
    turns: DataFrame, span: int = 512, history: int = 128, system_role: str = "system", target_role: str = "assistant"
) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, n_turns, loss_spans) per window of the rows (conv_id, turn, role, text).

    Turns go by turn number, equal or null numbers (first) by role and text; repeated rows are repeated turns. Null roles and
    texts are empty, null conv_ids are one conversation, an empty table gives no windows, other columns are ignored. ``window``
    orders a conversation's windows (position of the first new turn). The first ``n_repeated`` of its ``n_turns`` turns repeat
    earlier ones: the system turn, if the conversation starts with one, and history. ``loss_spans`` are (start, length) in
    code points of ``formatted``. A turn above ``span`` tokens stays whole, ``history`` counts at most ``span``.
    """
    history = min(history, span)
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    placed = _placed(rows, system_role)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit(": "))
    cell = F.floor(F.col("_start") / span)
    pieces = placed.select(
        "conv_id", F.col("_pos").alias("pos"), "_start", "_system", "tokens", cell.alias("cell"),
        F.coalesce(~F.col("_system") & (F.floor((F.col("_end") - 1) / span) > cell), F.lit(False)).alias("crossing"),
        F.length(head).alias("head"), (F.col("role") == target_role).alias("target"),
        F.concat(head, escape(F.col("text")), F.lit(END)).alias("piece"),
    )
    # Written, as four joins read them
    pieces = staged(pieces, "pieces")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    windows = staged(pieces.groupBy("conv_id", "cell", "crossing").agg(
        F.min("pos").alias("window"), F.min(F.when(~F.col("_system"), F.col("_start"))).alias("first")), "windows")
    fields = ["pos", "target", "head", "piece"]
    new = pieces.alias("p").join(
        windows.alias("w"), same("p", "w") & (F.col("p.cell") == F.col("w.cell")) & (F.col("p.crossing") == F.col("w.crossing"))
    ).select("p.conv_id", "w.window", F.lit(False).alias("repeated"), *[f"p.{c}" for c in fields])
    # A turn can be history of windows that begin in its own cell or the next one, as history <= span
    offered = pieces.filter(~F.col("_system")).withColumn("near", F.explode(F.array(F.col("cell"), F.col("cell") + 1)))
    past = offered.alias("p").join(
        windows.alias("w"), same("p", "w") & (F.col("p.near") == F.col("w.cell"))
    ).filter((F.col("p.pos") < F.col("w.window")) & (F.col("w.first") - F.col("p._start") <= history)).select(
        "p.conv_id", "w.window", F.lit(True).alias("repeated"), *[f"p.{c}" for c in fields])
    kept = pieces.filter("_system").alias("p").join(windows.filter("window > 0").alias("w"), same("p", "w")).select(
        "p.conv_id", "w.window", F.lit(True).alias("repeated"), *[f"p.{c}" for c in fields])
    held = F.array_sort(F.collect_list(F.struct("pos", "repeated", "target", "head", "piece")))
    grouped = new.unionByName(past).unionByName(kept).groupBy("conv_id", "window").agg(held.alias("turns"))
    sizes = F.transform("turns", lambda t: F.length(t["piece"]))
    start = lambda i: F.aggregate(F.slice(F.col("_sizes"), F.lit(1), i), F.lit(0), lambda a, b: a + b)
    spans = F.transform(F.col("turns"), lambda t, i: F.struct(
        (start(i) + t["head"]).alias("start"), (F.length(t["piece"]) - t["head"] - len(END)).alias("length"),
        (t["target"] & ~t["repeated"]).alias("on")))
    return grouped.withColumn("_sizes", sizes).select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"), F.size("turns").alias("n_turns"),
        F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["start"], s["length"])).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted window."""
    role = r"(?s)^### ((?:[^:\\]|\\.)*+): "
    return F.transform(
        F.filter(F.split(formatted, END, -1), lambda x: x != ""),
        lambda x: F.struct(unescape(F.regexp_extract(x, role, 1)).alias("role"), unescape(F.regexp_replace(x, role, "")).alias("text")))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """Unescaped texts under the loss mask."""
    return F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
