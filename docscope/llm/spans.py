"""Match positions and cut-outs with built-in functions only, in time near linear in the text and its matches.

Lambdas would evaluate an outer expression anew for each element, so what they read by index is bound first (``let``).
Running sums are made by doubling steps over whole arrays: n log n, where appending to an array in ``aggregate`` would
copy it for every match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of text that one piece holds where texts are cut at many places.
PIECE = 1024
_STEPS = [1 << k for k in range(31)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under the associative ``add``."""

    def widen(acc: Column, step: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= step, add(F.get(acc, i - step), x)).otherwise(x))

    return let(values, lambda v: F.aggregate(F.filter(F.array(*map(F.lit, _STEPS)), lambda p: p < F.size(v)), v, widen))


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start, stop, hit[, before]>>`` in code points, stop exclusive.

    The text between matches comes from ``split``, the matches from ``regexp_extract_all``; their running lengths are
    the positions. ``before`` holds up to ``context`` characters between the match before and this one. The pattern
    must not match the empty string. Null or unmatched text gives an empty array, after one scan of the text.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    names = {"start": "int", "stop": "int", "hit": "string"} | ({"before": "string"} if context else {})

    def found(h: Column, g: Column) -> Column:
        ends = running(F.transform(h, lambda x, i: F.length(x) + F.length(F.get(g, i))), lambda a, b: a + b)

        def one(e: Column) -> Callable[[Column, Column], Column]:
            fields = lambda x, i: [(F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("stop"), x.alias("hit")]
            more = lambda i: [F.right(F.get(g, i), F.lit(context)).alias("before")] if context else []
            return lambda x, i: F.struct(*fields(x, i), *more(i))

        return let(ends, lambda e: F.transform(h, one(e)))

    whole = let(hits, lambda h: let(gaps, lambda g: found(h, g)))
    empty = F.array().cast(f"array<struct<{','.join(f'{k}:{v}' for k, v in names.items())}>>")
    return F.when(text.rlike(pattern), whole).otherwise(empty)


def labelled(kind: str, order: int, found: Column) -> Column:
    """Spans as sortable structs ``(start, ord, kind, stop)``."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))


def digest(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


LABELLED = "array<struct<start:int,ord:int,kind:string,stop:int>>"


def _between(pieces: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` to ``stop`` of a text in pieces of PIECE code points."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
    head = F.coalesce(F.substr(F.get(pieces, a), start % PIECE + 1), F.lit(""))
    tail = F.coalesce(F.substr(F.get(pieces, b), F.lit(1), stop % PIECE), F.lit(""))
    inner = F.coalesce(F.substr(F.get(pieces, a), start % PIECE + 1, stop - start), F.lit(""))
    return F.when(a == b, inner).otherwise(F.concat(head, F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), tail))


def blank(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with its ``spans``, sorted by start, replaced by ``mark``; overlapping spans by one mark."""

    def built(pieces: Column, s: Column, tops: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(tops, i - 1)).otherwise(F.lit(0))
        part = lambda x, i: F.when(x["start"] >= before(i), F.concat(_between(pieces, before(i), x["start"]), F.lit(mark))).otherwise(F.lit(""))
        rest = _between(pieces, F.get(tops, F.size(tops) - 1), F.length(text))
        return F.concat(F.array_join(F.transform(s, part), ""), rest)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    tops = lambda s: running(F.transform(s, lambda x: x["stop"]), F.greatest)
    return let(cut, lambda p: let(spans, lambda s: let(tops(s), lambda t: built(p, s, t))))


def free_of(spans: Column, others: Column) -> Column:
    """Those ``spans`` that overlap none of ``others``, by start; both have ``start`` and ``stop``."""
    last = (1 << 31) - 1
    own, other = (lambda x, i: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), i.alias("at"))), (lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(-1).alias("at")))

    def judged(mine: Column, all_: Column) -> Column:
        # The furthest end of any other span before this one, and the first start of one after it.
        tops = running(F.transform(all_, lambda x: F.when(x["at"] < 0, x["stop"]).otherwise(F.lit(0))), F.greatest)
        nexts = F.reverse(running(F.reverse(F.transform(all_, lambda x: F.when(x["at"] < 0, x["start"]).otherwise(F.lit(last)))), F.least))
        ok = lambda t, n: lambda x, i: (x["at"] >= 0) & (F.get(t, i) <= x["start"]) & (F.get(n, i) >= x["stop"])
        free = let(tops, lambda t: let(nexts, lambda n: F.filter(all_, ok(t, n))))
        return F.transform(free, lambda x: F.get(mine, x["at"]))

    every = lambda m: F.array_sort(F.concat(F.transform(m, own), F.transform(others, other)))
    return let(spans, lambda m: F.when(F.size(m) == 0, m).otherwise(let(every(m), lambda a: judged(m, a))))
