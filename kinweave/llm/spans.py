"""All matches of a pattern in a text with their places and surroundings, in built-in functions and linear time.

One regular-expression pass puts marks around the matches and a split at the marks gives gaps and matches in turn. Places
(code points) are running sums of lengths. A fold that appended them one by one would copy its array at each step, so
sums run within chunks of CHUNK parts and over the totals of the chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
_MARK, _STAND_IN = "\u0001", "\u0002"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(numbers: Column) -> Column:
    """The sums of the first 0, 1, ... numbers, up to all of them."""
    zero = F.array(F.lit(0))
    return F.aggregate(numbers, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def spans(text: Column, pattern: str, near: int, across: bool = False, needs: str = "") -> Column:
    """Array of (start, end, match, before, after) of the leftmost non-overlapping matches; empty if there are none.

    before and after are the at most near code points that touch the match, up to the neighbouring match; across: before
    may also hold the whole of the match before. needs: a character that every match has; texts without it are passed over.
    The pattern must match no empty string, and U+0001 and U+0002 must be alike to it.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_STAND_IN)), pattern, f"{_MARK}$0{_MARK}")
    parts = F.split(marked, _MARK, -1)

    def placed(p: Column) -> Column:
        lengths = F.transform(p, F.char_length)
        chunks = let(
            lengths,
            lambda n: F.transform(F.sequence(F.lit(0), ((F.size(n) - 1) / CHUNK).cast("int")), lambda c: _running(F.slice(n, c * CHUNK + 1, F.lit(CHUNK)))),
        )
        return let(chunks, lambda c: let(_running(F.transform(c, lambda x: F.element_at(x, -1))), lambda base: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: found(p, c, base, i))))

    def found(p: Column, chunks: Column, base: Column, i: Column) -> Column:
        at = (i / CHUNK).cast("int")
        start = F.get(base, at) + F.get(F.get(chunks, at), i % CHUNK)
        match, gap = F.get(p, i), F.get(p, i - 1)
        if across:
            gap = F.concat(F.coalesce(F.get(p, i - 2), F.lit("")), gap)
        return F.struct(
            start.cast("int").alias("start"), (start + F.char_length(match)).cast("int").alias("end"), match.alias("match"),
            F.substring(gap, -near, near).alias("before"), F.substring(F.get(p, i + 1), 1, near).alias("after"),
        )

    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    some = let(parts, lambda p: F.when(F.size(p) > 2, placed(p)).otherwise(F.array().cast(kind)))
    return F.when(text.contains(needs) & text.rlike(pattern), some).otherwise(F.array().cast(kind))
