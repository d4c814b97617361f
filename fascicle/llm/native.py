"""Spans of regular expressions with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often and wherever the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def offsets(lengths: Column) -> Column:
    """Where each element of a non-empty array starts if elements of these lengths follow one another.

    Sums within blocks of about sqrt(n) elements, then over the blocks: n ** 1.5 steps, where
    summing each element's whole prefix would take n ** 2.
    """

    def of(v: Column) -> Column:
        n, step = F.size(v["x"]), v["step"]
        blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / step).cast("int")), lambda b: F.slice(v["x"], b * step + 1, step))
        return let(F.struct(blocks.alias("b"), F.transform(blocks, _total).alias("t")), within)

    def within(v: Column) -> Column:
        block = lambda x, at: F.transform(x, lambda _, i: at + _total(F.slice(x, 1, i)))
        return F.flatten(F.transform(v["b"], lambda x, k: let(_total(F.slice(v["t"], 1, k)), lambda at: block(x, at))))

    return let(F.struct(lengths.alias("x"), F.ceil(F.sqrt(F.size(lengths))).cast("int").alias("step")), of)


#: Characters of a piece of text that contexts are cut from.
PIECE = 4096


def spans(text: Column, pattern: str, groups: tuple[int, ...] = (), context: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern that matches no empty string.

    An array of structs: lo and hi (code points, hi exclusive), m (the match), g1, g2 ... for the
    groups asked for and, with ``context``, before and after: up to that many characters of the
    text on either side, whatever they hold. They are cut from pieces of the text, so that their
    cost doesn't grow with where they stand.
    """
    found = {"m": 0} | {f"g{g}": g for g in groups}
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)) if context else F.array().cast("array<string>")
    parts = F.struct(F.split(text, pattern, -1).alias("p"), pieces.alias("t"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(k) for k, g in found.items()])

    def rows(v: Column) -> Column:
        pairs = F.arrays_zip(F.slice(v["p"], 1, F.size(v["m"])).alias("p"), *[v[k].alias(k) for k in found])
        lengths = F.flatten(F.transform(pairs, lambda z: F.array(F.length(z["p"]), F.length(z["m"]))))
        return let(F.struct(pairs.alias("z"), offsets(lengths).alias("at"), v["t"].alias("t")), lambda w: F.transform(w["z"], lambda z, i: row(w, z, F.element_at(w["at"], 2 * i + 2))))

    def cut(w: Column, lo: Column, n: Column) -> Column:
        """n characters of the text from lo on, of two pieces at most."""
        k = (lo / PIECE).cast("int")
        two = F.concat(F.coalesce(F.try_element_at(w["t"], k + 1), F.lit("")), F.coalesce(F.try_element_at(w["t"], k + 2), F.lit("")))
        return F.substring(two, (lo % PIECE + 1).cast("int"), n)

    def row(w: Column, z: Column, lo: Column) -> Column:
        hi = lo + F.length(z["m"])
        around = [cut(w, F.greatest(lo - context, F.lit(0)), F.least(lo, F.lit(context))).alias("before"), cut(w, hi, F.lit(context)).alias("after")] if context else []
        return F.struct(lo.alias("lo"), hi.alias("hi"), z["m"].alias("m"), *around, *[z[f"g{g}"].alias(f"g{g}") for g in groups])

    kind = "array<struct<lo:int,hi:int,m:string" + ",before:string,after:string" * bool(context) + "".join(f",g{g}:string" for g in groups) + ">>"
    return F.when(text.rlike(pattern), let(parts, rows)).otherwise(F.array().cast(kind)).cast(kind)


def joined(rows: Column, *order: str) -> Column:
    """kind:lo:hi of each struct, comma-joined, in the order of the named fields."""
    keyed = F.array_sort(F.transform(rows, lambda r: F.struct(*[r[f].alias(f"k{i}") for i, f in enumerate(order)], r["kind"].alias("kind"), r["lo"].alias("lo"), r["hi"].alias("hi"))))
    return F.array_join(F.transform(keyed, lambda r: F.concat_ws(":", r["kind"], r["lo"].cast("string"), r["hi"].cast("string"))), ",")
