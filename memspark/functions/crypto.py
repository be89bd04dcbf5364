"""Field encryption with one key per scope and key version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encrypt(text: Column, key: Column) -> Column:
    return F.aes_encrypt(text.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"))


def decrypt(secret: Column, key: Column) -> Column:
    return F.aes_decrypt(secret, key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def with_key(df: DataFrame, keys: DataFrame, version: str = "key_version", alias: str = "key") -> DataFrame:
    """Attach the key of each row's scope and version. ``keys``: scope, key_version, key."""
    k = keys.select("scope_kind", "scope_owner", F.col("key_version").alias(version), F.col("key").alias(alias))
    return df.join(k, ["scope_kind", "scope_owner", version], "inner")
