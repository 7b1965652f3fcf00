"""Bucket, profile and partition keys: bit fields over bucketed dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SCALE


def bucket(d: str, n: int) -> Column:
    v = F.col(d)
    return F.when(v <= 0, 0).otherwise(F.least(F.floor(v * n / (SCALE + 1)), F.lit(n - 1))).cast("int")


def bit(condition: Column) -> Column:
    return condition.cast("int")


def fields(*parts: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(c, at) for c, at in parts))


def bucket_key() -> Column:
    return fields((bucket("d0", 8), 0), (bucket("d2", 8), 3), (bucket("d7", 8), 6), (bucket("d3", 4), 9), (bit(F.col("d5") < 0), 11))


def fine_key() -> Column:
    return fields((bucket_key(), 3), (bit(F.col("d9") > 0), 0), (bit(F.col("d10") > 0), 1), (bit(F.col("d11") > 0), 2))


def profile_key() -> Column:
    return fields(
        (bucket("d2", 16), 0), (bucket("d7", 8), 4), (bucket("d8", 4), 7), (bucket("d12", 4), 9), (bucket("d0", 4), 11), (bit(F.col("d5") < 0), 13),
        (bit(F.col("d9") > 0), 14), (bit(F.col("d10") > 0), 15), (bit(F.col("d11") > 0), 16), (bucket("d6", 4), 17), (bit(F.col("d1") > 1000), 19), (bucket("d13", 4), 20),
    )


#: Fixed: the dimension that a profile tests in bit 7, or adds in bits 6 and 7.
KD_THRESHOLD = 3500
KD_TOP = {0: "d8", 1: "d2", 7: "d7", 8: "d3", 9: "d12", 10: "d13"}
KD_PAIR = {2: "d2", 3: "d7", 4: "d3", 5: "d12", 6: "d13"}


def kd_key(profile: int = 0) -> Column:
    flags = [(bit(F.col("d5") < 0), 0), (bit(F.col("d9") > 0), 1), (bit(F.col("d10") > 0), 2), (bit(F.col("d11") > 0), 3)]
    if profile in KD_PAIR:
        return fields(*flags, (bucket("d0", 4), 4), (bucket(KD_PAIR[profile], 4), 6))
    return fields(*flags, (bucket("d0", 8), 4), (bit(F.col(KD_TOP.get(profile, KD_TOP[0])) >= KD_THRESHOLD), 7))
