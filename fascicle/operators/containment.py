"""Names within names: containment joins by the rarest q-gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.functions.keys import source_key, source_stem
from fascicle.operators.tables import materialised

Q = 3


def grams(text: Column, q: int) -> Column:
    """The distinct runs of q characters; none of a shorter text."""
    starts = F.when(F.length(text) >= q, F.sequence(F.lit(1), F.length(text) - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(q))))


def contained(inner: DataFrame, outer: DataFrame, q: int = Q) -> DataFrame:
    """(inner, outer): distinct texts of the one-column tables where inner stands in outer.

    A text can only hold what all its q-grams hold, so each inner text meets the outer texts of
    its rarest q-gram alone. Texts of fewer than q characters are a gram themselves; an empty
    one, which stands in all, is the gram of no characters.
    """
    i = inner.toDF("inner").where("inner IS NOT NULL").distinct()
    o = outer.toDF("outer").where("outer IS NOT NULL").distinct()
    short = F.length("inner") < q
    own = i.select("inner", F.explode(F.when(short, F.array("inner")).otherwise(grams(F.col("inner"), q))).alias("gram"))
    # Shorter grams of the outer texts only where an inner text asks for them.
    asked = own.where(F.length("gram") < q).select("gram").distinct()
    o_grams = o.select("outer", F.explode(grams(F.col("outer"), q)).alias("gram"))
    for n in range(1, q):
        o_grams = o_grams.unionByName(o.select("outer", F.explode(grams(F.col("outer"), n)).alias("gram")).join(asked.where(F.length("gram") == n), "gram", "left_semi").select("outer", "gram"))
    o_grams = materialised(o_grams.unionByName(o.select("outer", F.lit("").alias("gram")).join(asked.where("gram = ''"), "gram", "left_semi").select("outer", "gram")), "grams")
    counts = o_grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
    met = rarest.select("inner", F.col("g.gram").alias("gram")).join(o_grams, "gram")
    return met.where(F.contains("outer", F.col("inner"))).select("inner", "outer")


def fuzzy_matches(names: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, expected) of equal stems, or one key within the other; an empty key is within all.

    Null names match as empty ones; repeated names count once.
    """
    keyed = lambda df, as_: df.select(F.coalesce("name", F.lit("")).alias(as_)).distinct().withColumns({"key": source_key(F.col(as_)), "stem": source_stem(F.col(as_))})
    a, b = materialised(keyed(names, "name"), "names"), materialised(keyed(expected, "expected"), "expected-names")
    within = contained(a.select("key"), b.select("key")).select(F.col("inner").alias("ka"), F.col("outer").alias("kb"))
    around = contained(b.select("key"), a.select("key")).select(F.col("outer").alias("ka"), F.col("inner").alias("kb"))
    keys = within.unionByName(around).distinct()
    by_key = keys.join(a.select("name", F.col("key").alias("ka")), "ka").join(b.select("expected", F.col("key").alias("kb")), "kb").select("name", "expected")
    by_stem = a.select("name", "stem").join(b.select("expected", "stem"), "stem").select("name", "expected")
    return by_key.unionByName(by_stem).distinct()
