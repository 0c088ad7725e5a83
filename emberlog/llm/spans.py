"""Spans of pattern matches as Columns, in code points, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: int, op) -> Column:
    """``op`` over all integers up to each place, in rounds that double the reach: n log n steps, where a fold that grows an array takes n * n.

    ``start`` is neutral for ``op``.
    """
    kind = "array<int>"

    def reach(acc: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= back, op(x, F.coalesce(F.get(acc, i - back), F.lit(start)))).otherwise(x)).cast(kind)

    def rounds(xs: Column) -> Column:
        return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(xs), F.lit(2)))).cast("int") - 1)

    return let(values.cast(kind), lambda xs: F.aggregate(rounds(xs), xs.cast(kind), lambda acc, k: reach(acc, k)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start int, stop int, value string>> of the leftmost non-overlapping matches.

    ``start``/``stop`` are of the whole match, ``value`` is the asked group.  Where a match ends follows from the
    lengths of the matches and of what lies between them.  The pattern mustn't match nothing.
    """
    between = F.split(text, pattern, -1)

    def spans(whole: Column) -> Column:
        value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        steps = F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda a, b: F.length(a) + F.length(b))
        stops = running(steps, 0, lambda x, y: x + y)
        places = F.zip_with(stops, whole, lambda e, w: F.struct((e - F.length(w)).alias("start"), e.alias("stop")))
        return F.zip_with(places, value, lambda p, v: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), v.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def apart(spans: Column, others: Column) -> Column:
    """Of ``spans``, those that overlap none of ``others``; both are of start, stop and value, and the spans don't overlap each other.

    All are sorted by their start; a span is met by an earlier one that ends after its start, or by a later one that starts before its end.
    """
    tagged = lambda xs, own: F.transform(xs, lambda m: F.struct(m["start"].alias("start"), F.lit(own).alias("own"), m["stop"].alias("stop"), m["value"].alias("value")))
    far = (1 << 31) - 1

    def kept(line: Column) -> Column:
        ends = running(F.transform(line, lambda m: F.when(m["own"] == 0, m["stop"]).otherwise(F.lit(0))), 0, lambda x, y: F.greatest(x, y))
        starts = F.reverse(running(F.reverse(F.transform(line, lambda m: F.when(m["own"] == 0, m["start"]).otherwise(F.lit(far)))), far, lambda x, y: F.least(x, y)))
        around = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        both = F.zip_with(line, around, lambda m, r: F.struct(m["own"].alias("own"), r["e"].alias("e"), r["s"].alias("s"), F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value")).alias("m")))
        return F.transform(F.filter(both, lambda x: (x["own"] == 1) & (x["e"] <= x["m"]["start"]) & (x["s"] >= x["m"]["stop"])), lambda x: x["m"])

    return let(F.array_sort(F.concat(tagged(others, 0), tagged(spans, 1))), kept)
