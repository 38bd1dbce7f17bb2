"""Text cleaning, chunking, masking and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def sanitize_markdown(text: Column) -> Column:
    no_fences = F.regexp_replace(strip_controls(text), r"(?s)```.*?```", "")
    return F.btrim(F.regexp_replace(no_fences, r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def sanitize_page(text: Column) -> Column:
    collapsed = F.regexp_replace(F.btrim(strip_controls(text), F.lit(" \n\t\r")), r"\n{3,}", "\n\n")
    return F.regexp_replace(collapsed, r"[ \t]{2,}", " ")


def _pack(pieces: Column, glue: str, limit: int, start: Column) -> Column:
    """Greedy packing of an array of strings into chunks."""

    def step(state, piece):
        joined = F.when(state.buf == "", piece).otherwise(F.concat(state.buf, F.lit(glue), piece))
        fits = F.length(state.buf) + F.length(piece) + 1 <= limit
        closed = F.when(state.buf == "", state.out).otherwise(F.concat(state.out, F.array(state.buf)))
        return F.struct(
            F.when(fits, state.out).otherwise(closed).alias("out"),
            F.when(fits, joined).otherwise(piece).alias("buf"),
        )

    return F.aggregate(pieces, start, step, _all_chunks)


def _all_chunks(state) -> Column:
    """Closed chunks and, if there is one, the open buffer."""
    return F.when(state.buf == "", state.out).otherwise(F.concat(state.out, F.array(state.buf)))


def chunk_text(text: Column, limit: int = fx.MAX_CHUNK_CHARS) -> Column:
    """Array of chunks: paragraphs packed greedily, over-long paragraphs cut at sentence ends."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
    blank = F.lit(" \n\t\r")
    paragraphs = F.filter(
        F.transform(F.split(text, r"\n\s*\n"), lambda p: F.btrim(p, blank)), lambda p: p != ""
    )

    def step(state, paragraph):
        joined = F.when(state.buf == "", paragraph).otherwise(F.concat(state.buf, F.lit("\n"), paragraph))
        fits = F.length(state.buf) + F.length(paragraph) + 1 <= limit
        closed = F.when(state.buf == "", state.out).otherwise(F.concat(state.out, F.array(state.buf)))
        cut = _pack(F.split(paragraph, r"(?<=[.!?다])\s+"), " ", limit, empty)
        long = F.length(paragraph) > limit
        return F.struct(
            F.when(fits, state.out).when(long, F.concat(closed, cut)).otherwise(closed).alias("out"),
            F.when(fits, joined).when(long, F.lit("")).otherwise(paragraph).alias("buf"),
        )

    packed = F.aggregate(paragraphs, empty, step, _all_chunks)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def scrub_pii(text: Column) -> Column:
    masked = F.regexp_replace(text, fx.PHONE_PATTERN, "[PHONE]")
    masked = F.regexp_replace(masked, fx.EMAIL_PATTERN, "[EMAIL]")
    return F.regexp_replace(masked, fx.COORD_PATTERN, "[COORD]")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def anonymous_id(identifier: Column) -> Column:
    digest = F.sha2(identifier.cast("string"), 256)
    return F.concat(F.lit("FARM_"), F.upper(F.substring(digest, 1, 8)))


def short_region(name: Column) -> Column:
    """Last word of a place name without its administrative suffix."""
    last = F.element_at(F.split(name, " "), -1)
    short = F.regexp_replace(last, "(시|군|구)$", "")
    return F.when(short == "", last).otherwise(short)


def zone_letters(index: Column) -> Column:
    """Zero-based index to A..Z, AA..ZZ, AAA.. (up to eight letters)."""

    def step(state, _):
        letter = F.chr(F.lit(65) + F.pmod(state.n - 1, F.lit(26)))
        more = state.n > 0
        return F.struct(
            F.when(more, F.floor((state.n - 1) / 26)).otherwise(state.n).cast("bigint").alias("n"),
            F.when(more, F.concat(letter, state.s)).otherwise(state.s).alias("s"),
        )

    start = F.struct((index.cast("bigint") + 1).alias("n"), F.lit("").alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda state: state.s)


def composite_id(*parts: Column) -> Column:
    return F.replace(F.concat_ws("-", *parts), F.lit(" "), F.lit("_"))


def key_value_summary(pairs: dict[str, Column]) -> Column:
    """'k=v, k=v' with missing values left out."""
    return F.concat_ws(
        ", ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in pairs.items()]
    )


def running_doc_id(position: Column) -> Column:
    """'doc_0000' style id from a zero-based position; wider numbers keep all digits."""
    digits = position.cast("string")
    return F.concat(F.lit("doc_"), F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0")))
