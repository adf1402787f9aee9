"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.session import scratch_path

#: The white-space class of the word and line contracts.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most keys that a join broadcasts; each is a few dozen bytes.
HOT_KEYS = 50_000
#: A key with more than one in SLICES of the rows is dealt to several tasks.
SLICES = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir``; returns the path."""
    path = os.path.join(scratch_path(df.sparkSession, "llm"), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and
    survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns named like an output or a working column of an
    operator; those of the operator replace them."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; texts that are all ASCII take the short way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(text: Column, separators: str) -> Column:
    """Maximal runs of characters outside ``separators`` (a class body); null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), lambda w: w != "")


def digest(c: Column) -> tuple[Column, Column]:
    """128 bits of a value as two longs."""
    return F.xxhash64(c), F.xxhash64(F.lit("second half"), c)


def join_unique(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner",
                hot_keys: int = HOT_KEYS) -> DataFrame:
    """Join ``left`` to ``right``, which is unique in ``on`` and whose ``weight``
    counts the left rows of each key.

    Keys that are few, or so heavy that at most ``hot_keys`` of them can exist,
    are broadcast, so that no task gathers the rows of a heavy key; the rest,
    each of bounded weight, is shuffled.  ``how``: inner or left.  ``left`` is
    read twice: pass a written table or a cheap scan.
    """
    n, total = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n <= hot_keys:
        return left.join(F.broadcast(right), on, how)
    hot_at = int(total) // hot_keys + 1
    hot, cold = right.filter(F.col(weight) >= hot_at), right.filter(F.col(weight) < hot_at)
    near = left.join(F.broadcast(hot), on, "inner")
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return near.unionByName(rest)


def join_salted(left: DataFrame, right: DataFrame, on: list[str], weight: str, spread: list[str],
                slices: int = SLICES) -> DataFrame:
    """Inner join of ``left`` to ``right``, whose rows may be of any size and share keys;
    ``weight`` counts the left rows of a key.

    Nothing but the names of heavy keys is broadcast, and at most ``slices`` of them can
    exist: their left rows are dealt by a hash of ``spread`` to as many tasks as their
    weight asks for, and the right rows are copied to each, at most ``slices`` copies in all.
    """
    total = right.select(*on, weight).distinct().agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    most = int(total) // slices + 1
    parts = F.ceil(F.col(weight) / most).cast("int")
    heavy = right.filter(F.col(weight) > most).select(*on, parts.alias("_parts")).distinct()
    dealt = left.join(F.broadcast(heavy), on, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = right.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copied, [*on, "_slice"]).drop("_slice")
