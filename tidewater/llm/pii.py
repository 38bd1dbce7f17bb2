"""Personal data in whole texts, with column functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for bank accounts, number ranges for
addresses), and words near a span raise or lower its score. Patterns are written with possessive loops and start only where a
run starts, so that long runs cost linear time and no stack; they find the same leftmost matches as the plain forms.

Positions come from the text cut at its matches: the lengths of the pieces add up to code point offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CUT, _OTHER = "\x01", "\x02"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: kind -> (pattern, score without context, context words that raise the score)
KINDS: dict[str, tuple[str, float, str]] = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, "ip|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", 0.8, "card|visa|credit|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|call|tel|fax|mobile"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.9, "iban|bank|account|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security"),
}
BASE = ("email", "ip", "card", "phone")
#: Code points looked at on each side of a span, what context adds or takes, and the score that added kinds must reach
NEAR, RAISE, LOWER, ACCEPT = 40, 0.3, 0.3, 0.6
_NOT_PERSONAL = "example|version|isbn|order|invoice|sample"
_CHUNK = 256
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For every element what ``join`` makes of 0 and all elements before it, in chunks so that none looks at the whole array."""
    total = lambda x: F.aggregate(x, F.lit(0), join)

    def chunked(s: Column) -> Column:
        last = F.floor((F.size(s) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(s, c * _CHUNK + 1, _CHUNK))

    def inside(chunk: Column, before: Column) -> Column:
        return F.transform(chunk, lambda _, i: join(before, total(F.slice(chunk, F.lit(1), i))))

    def every(held: Column, totals: Column) -> Column:
        return F.flatten(F.transform(held, lambda x, c: _let(total(F.slice(totals, F.lit(1), c)), lambda before: inside(x, before))))

    return _let(values, lambda s: _let(chunked(s), lambda held: _let(F.transform(held, total), lambda totals: every(held, totals))))


def _starts(sizes: Column) -> Column:
    """Exclusive running sums of an array."""
    return _before(sizes, lambda a, b: a + b)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.left(plain, F.lit(4)))
    digit = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda a, c: (a * F.when(F.ascii(c) >= 65, 100).otherwise(10) + digit(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def _sound(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")
    if kind == "card":
        return _let(_digits(value), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(value) == 1)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    pattern, base, words = KINDS[kind]
    rank = list(KINDS).index(kind)
    marked = F.regexp_replace(F.translate(text, _CUT, _OTHER), pattern, f"{_CUT}$0{_CUT}")
    pieces = F.split(marked, _CUT, -1)

    def span(parts: Column, starts: Column, i: Column) -> Column:
        at = lambda k: F.get(parts, k)
        near = F.lower(F.concat_ws(" ", F.right(at(i - 1), F.lit(NEAR)), F.left(at(i + 1), F.lit(NEAR))))
        score = _let(near, lambda x: F.lit(base) + F.when(x.rlike(rf"\b(?:{words})"), RAISE).otherwise(0.0)
                     - F.when(x.rlike(rf"\b(?:{_NOT_PERSONAL})"), LOWER).otherwise(0.0))
        return F.struct(
            F.get(starts, i).alias("start"), F.lit(rank).alias("rank"), (F.get(starts, i) + F.length(at(i))).alias("end"),
            F.lit(kind).alias("kind"), at(i).alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 2))).alias("score"))

    def all_spans(parts: Column) -> Column:
        odd = F.filter(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: _sound(kind, F.get(parts, i)))
        return _let(_starts(F.transform(parts, F.length)), lambda starts: F.transform(odd, lambda i: span(parts, starts, i)))

    found = _let(pieces, lambda parts: F.when(F.size(parts) >= 3, all_spans(parts)).otherwise(F.array().cast(_SPAN)))
    if kind not in BASE:
        found = F.filter(found, lambda s: s["score"] >= ACCEPT)
    sign = {"email": "@", "phone": "+", "ip": "."}.get(kind)
    return F.when(F.contains(text, F.lit(sign)), found).otherwise(F.array().cast(_SPAN)) if sign else found


def find_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Adds ``spans_col``: array of (start, rank, end, kind, value, score) by start, then kind as listed in KINDS.

    Offsets count code points of the whole text, the end is exclusive. Spans of the kinds in BASE are all valid leftmost
    matches whatever their score; further kinds must reach ACCEPT. A null or empty text gives an empty array. A column
    of that name is replaced; all others stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [f"_pii_{k}" for k in KINDS]
    each = docs.withColumns({c: _found(text, k) for c, k in zip(own, KINDS)})
    return each.withColumn(spans_col, F.array_sort(F.concat(*own))).drop(*own)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first.

    The text is cut once into chunks of equal length, and each stretch between spans is put together from the chunks that it lies in,
    so the work is linear in the text and the spans.
    """
    chunk = lambda at: F.floor(at / _CHUNK).cast("int")

    def stretch(chunks: Column, a: Column, b: Column) -> Column:
        inside = F.array_join(F.slice(chunks, chunk(a) + 1, chunk(b - 1) - chunk(a) + 1), "")
        return F.when(b > a, F.substring(inside, a % _CHUNK + 1, b - a)).otherwise("")

    def joined(held: Column, chunks: Column, reached: Column) -> Column:
        # What lies before a span has been reached where the spans before it end; a span that begins there or later is not part of them
        heads = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: F.get(held, i)["start"] >= F.get(reached, i))
        named = lambda i: F.concat(
            stretch(chunks, F.get(reached, i), F.get(held, i)["start"]), F.lit("["), F.upper(F.get(held, i)["kind"]), F.lit("]"))
        end = F.array_max(F.transform(held, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(heads, named), ""), _let(end, lambda e: stretch(chunks, e, F.length(text))))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    reached = lambda held: _before(F.transform(held, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    done = _let(spans, lambda held: _let(cut, lambda chunks: _let(reached(held), lambda r: joined(held, chunks, r))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
