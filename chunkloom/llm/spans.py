"""Spans of regular expressions in a text column, by DataFrame functions only.

A span is a struct (s, e, m): code points from s to e, end exclusive, and the text m.
Positions come from the pieces between the matches, so one pattern costs one pass over
texts without a match and two over the others. Positions and overlaps are running sums,
maxima and minima, taken in blocks, so a text with many spans costs in proportion to them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"
#: Values of a block of a running fold.
BLOCK = 256


def none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row however often the body needs it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The folds of all values before each value, and of all of them: one entry more than values.

    An accumulated array is copied at every step, so values are folded in blocks of 256, then
    the blocks' results.
    """

    def plain(xs):
        return F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(fold(F.element_at(acc, -1), x))))

    def blocks(xs):
        starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / BLOCK), F.lit(0)).cast("int"))
        return let(F.transform(starts, lambda b: plain(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))), joined_up)

    def joined_up(inner):
        def shifted(before):
            parts = F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda own, start: F.transform(F.slice(own, 1, F.size(own) - 1), lambda v: fold(start, v)))
            return F.concat(F.flatten(parts), F.array(F.element_at(before, -1)))

        return let(plain(F.transform(inner, lambda own: F.element_at(own, -1))), shifted)

    return let(values, blocks)


def located(text: Column, matches: Column, regex: str) -> Column:
    """The spans of `matches`, which are all of the pattern's in order (leftmost, not overlapping)."""

    def placed(pairs):
        def spans(ends):
            return F.zip_with(
                pairs,
                F.slice(ends, 1, F.size(pairs)),
                lambda x, at: F.struct((at + x["p"]).alias("s"), (at + x["p"] + F.length(x["m"])).alias("e"), x["m"].alias("m")),
            )

        return let(running(F.transform(pairs, lambda x: x["p"] + F.length(x["m"])), lambda a, b: a + b, F.lit(0)), spans)

    pairs = let(matches, lambda ms: F.zip_with(F.slice(F.split(text, regex, -1), 1, F.size(ms)), ms, lambda p, m: F.struct(F.length(p).alias("p"), m.alias("m"))))
    return F.when(F.size(matches) > 0, let(pairs, placed)).otherwise(none())


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df with a span column for each pattern. Two projections, so that the matches, which the
    positions need several times, are computed once."""
    found = df.select("*", *[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in patterns.items()])
    placed = found.select("*", *[located(F.col(text), F.col(f"_m_{k}"), p).alias(k) for k, p in patterns.items()])
    return placed.drop(*[f"_m_{k}" for k in patterns])


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans as structs that sort by start, then kind: (s, o, e, kind)."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def joined(tags: Column) -> Column:
    """kind:start:end, comma-joined, in order."""
    return F.array_join(F.transform(F.array_sort(tags), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def apart_from(spans: Column, others: Column) -> Column:
    """Those spans that overlap none of the others, sorted: none of the others that begin at or
    before a span's start ends beyond it, and none begins within it."""
    end, start = F.lit(-1), F.lit(2**31 - 1)

    def judged(every):
        def kept(ends, starts):
            n = F.size(every)
            rows = F.zip_with(
                every,
                F.zip_with(F.slice(ends, 1, n), F.slice(starts, 1, n), lambda a, b: F.struct(a.alias("to"), b.alias("next"))),
                lambda x, y: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), (x["own"] & (y["to"] <= x["s"]) & (y["next"] >= x["e"])).alias("ok")),
            )
            return F.transform(F.filter(rows, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))

        ends = running(F.transform(every, lambda x: F.when(x["own"], end).otherwise(x["e"])), F.greatest, end)
        back = running(F.reverse(F.transform(every, lambda x: F.when(x["own"], start).otherwise(x["s"]))), F.least, start)
        return let(ends, lambda a: let(back, lambda b: kept(a, F.reverse(F.slice(b, 1, F.size(every))))))

    mark = lambda xs, own: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), x["m"].alias("m")))
    every = F.array_sort(F.concat(mark(others, False), mark(spans, True)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(every, judged)).otherwise(spans)


#: A text is cut into parts of so many code points before pieces of it are taken.
CHUNK = 4096


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, a: Column, b: Column) -> Column:
    """The text from code point a to b, of which only the chunks that it touches are read."""
    first = F.floor(a / CHUNK).cast("int")
    few = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1), "")
    return F.when(b > a, F.substring(few, a - first * CHUNK + 1, b - a)).otherwise(F.lit(""))


def redacted(text: Column, tags: Column) -> Column:
    """The text with each tagged span replaced by [KIND]; overlapping spans are one, named by the first."""

    def replaced(every, ends, chunks):
        rows = F.zip_with(every, F.slice(ends, 1, F.size(every)), lambda x, to: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), to.alias("to")))
        fresh = F.filter(rows, lambda x: x["s"] >= x["to"])
        out = F.transform(fresh, lambda x: F.concat(cut(chunks, x["to"], x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(out, ""), cut(chunks, F.element_at(ends, -1), F.length(text)))

    def sorted_ones(every):
        ends = running(F.transform(every, lambda x: x["e"]), F.greatest, F.lit(0))
        return let(ends, lambda to: let(chunks_of(text), lambda chunks: replaced(every, to, chunks)))

    return F.when(F.size(tags) > 0, let(F.array_sort(tags), sorted_ones)).otherwise(text)


def brute_force(regex: str, text: str) -> list[tuple[int, int, str]]:
    """For tests: the same spans by Python's re (possessive quantifiers need Python 3.11; \\G is not there)."""
    return [(m.start(), m.end(), m[0]) for m in re.finditer(regex, text)]
