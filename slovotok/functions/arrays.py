"""Array expressions that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements in a chunk of a running sum: appending copies at most so many at a time.
CHUNK = 256


def running_sum(lengths: Column) -> Column:
    """For each element of an integer array the sum of the elements before it.

    An accumulator array is appended to within chunks only, so the work stays near linear for very long arrays."""
    zero = F.struct(F.lit(0).alias("off"), F.array().cast("array<int>").alias("out"))

    def prefixes(arr: Column, base: Column) -> Column:
        start = F.struct(base.alias("off"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(arr, start, lambda a, x: F.struct((a["off"] + x).alias("off"), F.array_append(a["out"], a["off"]).alias("out")), lambda a: a["out"])

    starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))
    chunks = F.transform(starts, lambda c: F.slice(lengths, c * CHUNK + 1, CHUNK))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    bases = F.aggregate(sums, zero, lambda a, x: F.struct((a["off"] + x).alias("off"), F.array_append(a["out"], a["off"]).alias("out")), lambda a: a["out"])
    short = prefixes(lengths, F.lit(0))
    long = F.flatten(F.zip_with(chunks, bases, prefixes))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).when(F.size(lengths) <= CHUNK, short).otherwise(long)


def shifted(arr: Column, by: int) -> Column:
    """The array whose element i is element i + by of `arr`; null beyond the ends."""
    if by == 0:
        return arr
    n = F.size(arr)
    if by > 0:
        return F.slice(arr, by + 1, n)  # arrays_zip pads the shorter array with nulls.
    return F.concat(F.array_repeat(F.lit(None).cast("string"), -by), F.slice(arr, F.lit(1), F.greatest(n + by, F.lit(0))))
