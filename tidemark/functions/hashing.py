"""Keyed hashes: Spark's Murmur3 and a portable md5 form other engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def murmur_bucket(buckets: int, *keys: Column) -> Column:
    """Murmur3 bucket in 0..buckets-1; no ``abs``, which overflows on the smallest INT."""
    return F.pmod(F.hash(*keys), F.lit(buckets))


def murmur_abs_bucket(buckets: int, key: Column) -> Column:
    """Bucket of the absolute Murmur3 hash, widened to BIGINT so that it cannot overflow."""
    return F.pmod(F.abs(F.hash(key).cast("bigint")), F.lit(buckets)).cast("int")


def portable_hash(*keys: Column) -> Column:
    """First 32 bits of the md5 of the keys' text, as BIGINT."""
    text = F.concat(*[key.cast("string") for key in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def portable_bucket(buckets: int, *keys: Column) -> Column:
    return (portable_hash(*keys) % buckets).cast("int")
