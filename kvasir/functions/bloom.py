"""Bloom filters of bounded size over BIGINT keys, built and tested inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12  # about 0.3 % false positives
LEAST_BITS, MOST_BITS = 1 << 13, 1 << 26  # at most 8 MB are broadcast, whatever the number of keys


def bloom_bits(keys: int) -> int:
    """The size of a filter for so many keys; beyond the bound, at 5.6 million keys, it only gets less sharp.

    The number of hashes follows the number of keys, so that a filter at its bound isn't full: of keys that aren't there
    it lets pass 0.3 % at 5.6 million keys, a third at 28 million and three quarters at 100 million.
    """
    return min(MOST_BITS, max(LEAST_BITS, keys * BITS_PER_KEY))


def bloom_filter(df: DataFrame, column: str) -> bytes | None:
    """The serialised filter of the non-null values of a BIGINT column, or None if there are none."""
    keys = df.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("key"))
    n = keys.count()
    if not n:
        return None
    jvm = df.sparkSession._jvm
    built = keys._jdf.stat().bloomFilter("key", n, bloom_bits(n))
    out = jvm.java.io.ByteArrayOutputStream()
    built.writeTo(out)
    return bytes(out.toByteArray())


def might_contain(df: DataFrame, bloom: bytes | None, key: Column) -> Column:
    """False if the key is surely not in the filter; null for a null key.

    The filter is the value of a subquery: as a literal its 8 MB would be written out in hexadecimal in each text that Spark
    makes of a plan, once for every place where it is tested, and the driver keeps many of these.
    """
    if bloom is None:
        return F.when(key.isNotNull(), F.lit(False))
    spark = df.sparkSession
    utils = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = spark._jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain
    held = spark.createDataFrame([(bytearray(bloom),)], "held binary").scalar()
    return Column(utils.column(test(utils.expression(held._jc), utils.expression(key.cast("bigint")._jc))))
