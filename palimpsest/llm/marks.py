"""A bounded bitmap of keys that tells every task which rows can matter, so that the others are never shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 28
BITS_PER_KEY = 16


class Marks:
    """A bounded bitmap of 64-bit keys, built by Spark and sent to every task; ``may_hold`` has no misses."""

    def __init__(self, keys: DataFrame, column: str, max_bits: int = MAX_BITS) -> None:
        count = keys.count()
        self.bits = 1 << 12
        while self.bits < min(max_bits, BITS_PER_KEY * count):
            self.bits *= 2
        slot = F.pmod(F.col(column), F.lit(self.bits))
        words = (
            keys.select((slot / 64).cast("long").alias("word"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("bit"))
            .groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("set")).toPandas()
        )
        held = np.zeros(self.bits // 64, np.int64)
        held[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64)
        self.sent = keys.sparkSession.sparkContext.broadcast(held)

    def may_hold(self, key: Column) -> Column:
        sent, bits = self.sent, self.bits

        @F.pandas_udf("boolean")
        def test(keys: pd.Series) -> pd.Series:
            slot = keys.to_numpy(np.int64) % bits
            return pd.Series((sent.value[slot >> 6] >> (slot & 63)) & 1 == 1)

        return test(key)
