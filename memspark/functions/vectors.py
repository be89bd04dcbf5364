"""Vector expressions over ``ARRAY<FLOAT>`` columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions.text import EMBED_CHARS, chunk_text


def norm(v: Column) -> Column:
    d = v.cast("array<double>")
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, unequal-length or zero vectors."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0)
    return F.when(usable, dot(a, b) / F.when(scale > 0, scale)).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v.cast("array<double>"), lambda x: x / n)).otherwise(v.cast("array<double>"))


def pad(v: Column, dimensions: int) -> Column:
    """Short vectors filled with zeros at the right."""
    missing = F.greatest(F.lit(0), F.lit(dimensions) - F.size(v))
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), missing))


def vector_mean(df: DataFrame, keys: list[str], vector: str, dimensions: int) -> DataFrame:
    """Element-wise mean per key: one averaged column per element, combined before the shuffle."""
    parts = [F.avg(F.col(vector)[i].cast("double")).alias(f"_m{i}") for i in range(dimensions)]
    means = df.groupBy(*keys).agg(*parts)
    return means.select(*keys, F.array(*[F.col(f"_m{i}") for i in range(dimensions)]).alias("mean"))


def embed_texts(df: DataFrame, keys: list[str], text: Column, embed: Callable[[Column], Column], name: str) -> DataFrame:
    """``df`` with ``name``, the vector of the whole ``text``: texts longer than the model takes are embedded
    in pieces and their vectors averaged. ``keys`` tell the rows of long texts apart."""
    rows = df.withColumn("_text", text)
    long = F.coalesce(F.length("_text") > EMBED_CHARS, F.lit(False))
    short = rows.filter(~long).withColumn(name, embed(F.col("_text"))).drop("_text")
    rest = rows.filter(long)
    pieces = rest.select(*keys, F.explode(chunk_text(F.col("_text"), EMBED_CHARS)).alias("_piece")).select(*keys, embed(F.col("_piece")).alias("_v"))
    places = pieces.select(*keys, F.posexplode("_v").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    means = places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda r: r["_x"]).cast(short.schema[name].dataType).alias(name))
    return short.unionByName(rest.drop("_text").join(means, keys))


def hash_embed(dimensions: int = 64):
    """Deterministic stand-in for an embedding service: signed token counts in hashed places."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        import re
        import zlib

        import numpy as np

        word = re.compile(r"[^\W_]{2,}")
        places: dict[str, tuple[int, float]] = {}

        def one(s):
            v = np.zeros(dimensions, dtype=np.float32)
            for w in word.findall((s or "").lower()):
                at = places.get(w)
                if at is None:
                    h = zlib.crc32(w.encode())
                    at = places[w] = ((h >> 1) % dimensions, 1.0 if h & 1 else -1.0)
                v[at[0]] += at[1]
            return v

        return text.map(one)

    return embed
