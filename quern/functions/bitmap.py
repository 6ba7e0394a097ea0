"""A bitmap of hashed ids, of one size whatever the number of ids: rows are marked or left out by it without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of the bitmap; its 131,072 words are what is broadcast, whatever the number of ids.
PLACES = 1 << 23


def marked(df: DataFrame, wanted: DataFrame, column: str, other: str | None = None, name: str = "hit") -> DataFrame:
    """``df`` with ``name``: true for all rows whose ``column`` is among the values of ``other`` in ``wanted``, false for most of the rest."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES))
    bits = wanted.select(place(other or column).alias("p")).groupBy(F.shiftright("p", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("__bits"))
    at = df.withColumn("__p", place(column)).join(F.broadcast(bits), F.shiftright("__p", 6) == F.col("__word"), "left")
    return at.select(*df.columns, F.coalesce(F.expr("shiftright(__bits, cast(__p & 63 as int)) & 1 = 1"), F.lit(False)).alias(name))


def maybe(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``df`` without most of the rows whose ``column`` is not in ``wanted``; rows with a wanted value all stay.

    A join on the column must follow. With very many wanted ids the bitmap
    fills up and lets all rows pass; its size stays the same.
    """
    return marked(df, wanted, column, name="__hit").where("__hit").drop("__hit")


def split_join(many: DataFrame, one: DataFrame, key: str, heavy: int = 100_000, pieces: int = 64) -> DataFrame:
    """``many`` joined with ``one``, which has a row for each value of ``key``.

    Values with more than ``heavy`` rows in ``many`` are split into ``pieces``
    by chance, and the row of ``one`` is repeated for each piece, so that no
    task gets all rows of a hot value. What is hot is told by a bitmap, so
    nothing that grows is broadcast; a value taken for hot by mistake only
    takes the longer way. ``many`` is read twice.
    """
    hot = many.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > heavy).select(key)
    if hot.isEmpty():
        return many.join(one, key)
    a = marked(many, hot, key, name="__hot").withColumn("__piece", F.when(F.col("__hot"), (F.rand(7) * pieces).cast("int")).otherwise(0)).drop("__hot")
    b = marked(one, hot, key, name="__hot").withColumn("__piece", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return a.join(b, [key, "__piece"]).drop("__piece")
