"""Spans of matches: found, put in order, woven back into the text, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphveil.functions.kernels import once

SPAN = "struct<detector: string, value: string, offset: int, length: int>"
SPANS = f"array<{SPAN}>"
_FOUND = "array<struct<value: string, offset: int, length: int>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches with byte offset and byte length, in order; none for a null text.

    Spark's functions give no places, so the gaps between matches are split off too: gaps and matches
    in turn make up the text, and a running sum of their bytes gives each place. The pattern must not
    match the empty string.
    """
    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pieces = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("value"), F.octet_length(g).alias("gap")))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(_FOUND).alias("out"))

        def step(a: Column, p: Column) -> Column:
            begin, size = a["pos"] + p["gap"], F.octet_length(p["value"])
            return F.struct((begin + size).alias("pos"), F.array_append(a["out"], F.struct(p["value"].alias("value"), begin.alias("offset"), size.alias("length"))).alias("out"))

        return F.aggregate(pieces, start, step)["out"]

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(F.array().cast(_FOUND)))


def named(spans: Column, detector: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(detector).alias("detector"), x["value"].alias("value"), x["offset"].alias("offset"), x["length"].alias("length")))


def resolve(spans: Column) -> Column:
    """Spans without overlaps: by offset, the longer first, then as emitted; each is kept that begins at or after the last kept one's end."""
    def pick(all_: Column) -> Column:
        ranked = F.array_sort(F.transform(all_, lambda x, i: F.struct(x["offset"].alias("a"), (-x["length"]).alias("b"), i.alias("c"), x.alias("x"))))
        start = F.struct(F.lit(-1).alias("end"), F.array().cast(SPANS).alias("kept"))

        def step(a: Column, r: Column) -> Column:
            return F.when(r["a"] >= a["end"], F.struct((r["a"] - r["b"]).alias("end"), F.array_append(a["kept"], r["x"]).alias("kept"))).otherwise(a)

        return F.aggregate(ranked, start, step)["kept"]

    return once(spans, lambda s: F.when(F.size(s) > 1, pick(s)).otherwise(s))


def weave(text: Column, spans: Column, replace: Callable[[Column], Column], everywhere: bool = False) -> Column:
    """text with each of its disjoint, ordered spans replaced. Pieces are cut by bytes and joined once, so cost is linear in the text.

    everywhere: between the spans, every further occurrence of their values is replaced too, also within
    words and numbers. That is looked for once a value, so it costs values times text.
    """
    def cut(begin: Column, size: Column) -> Column:
        return F.substring(text.cast("binary"), begin + 1, size).cast("string")

    def joined(s: Column) -> Column:
        end = lambda x: x["offset"] + x["length"]
        before = lambda i: F.when(i > 0, end(F.get(s, i - 1))).otherwise(0)
        last = end(F.element_at(s, -1))
        tail = cut(last, F.octet_length(text) - last)
        if everywhere:
            gaps = F.concat(F.transform(s, lambda x, i: cut(before(i), x["offset"] - before(i))), F.array(tail))
            woven = lambda g: F.array_join(F.zip_with(g, s, lambda x, r: F.when(r.isNull(), x).otherwise(F.concat(x, replace(r)))), "")
            return once(_again(gaps, s, replace), woven)
        pieces = F.transform(s, lambda x, i: F.concat(cut(before(i), x["offset"] - before(i)), replace(x)))
        return F.concat(F.array_join(pieces, ""), tail)

    return once(spans, lambda s: F.when(F.size(s) > 0, joined(s)).otherwise(text))


def _again(gaps: Column, spans: Column, replace: Callable[[Column], Column]) -> Column:
    """gaps with the values of the spans replaced in them, in one pass each, so that nothing is looked for in a replacement; of values that begin at one place the longest."""
    ranked = F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda x: x["length"] > 0), lambda x: F.struct((-x["length"]).alias("a"), x["value"].alias("value")))))

    def pattern(g: Column) -> Column:
        """Of those values alone that occur, which are few or none."""
        quoted = lambda v: F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit(r"\E\\E\Q")), F.lit("\\E"))
        return once(F.array_join(g, "\0"), lambda t: F.array_join(F.transform(F.filter(ranked, lambda x: F.contains(t, x["value"])), lambda x: quoted(x["value"])), "|"))

    def replaced(g: Column, p: Column) -> Column:
        new = lambda m: replace(F.get(F.filter(spans, lambda x: x["value"] == m), F.lit(0)))
        woven = lambda found, rest: F.array_join(F.zip_with(rest, found, lambda x, m: F.when(m.isNull(), x).otherwise(F.concat(x, new(m)))), "")
        return once(F.regexp_extract_all(g, p, F.lit(0)), lambda found: F.when(F.size(found) > 0, woven(found, F.split(g, p, -1))).otherwise(g))

    return once(gaps, lambda all_: once(pattern(all_), lambda p: F.when(p != "", F.transform(all_, lambda g: replaced(g, p))).otherwise(all_)))
