"""A set of 64-bit hashes in a fixed number of bits, for tests inside tasks.

Its size is a parameter, not a matter of the data: ``2**bits`` bits go to the
executors.  Members are always found; a value that shares the slot of a member
is found too, so callers check hits exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.llm.words import U64


class Bitmap:
    def __init__(self, cells: np.ndarray, bits: int):
        self.cells, self.shift = cells, 64 - bits

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> U64(self.shift)
        return (self.cells[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1

    def __or__(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.cells | other.cells, 64 - self.shift)

    def without(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.cells & ~other.cells, 64 - self.shift)


def bitmap_of(df: DataFrame, bits: int, column: str = "h1") -> Bitmap:
    """The hashes (long) in ``column``, gathered by Spark; at most 2**bits / 64
    numbers reach the driver."""
    slot = F.shiftrightunsigned(column, 64 - bits)
    rows = (df.select(F.shiftright(slot, 6).alias("cell"), F.expr("1L").alias("one"),
                      slot.bitwiseAND(63).cast("int").alias("at"))
            .groupBy("cell").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("word")).toArrow())
    cells = np.zeros(1 << (bits - 6), dtype=np.int64)
    cells[rows.column("cell").to_numpy()] = rows.column("word").to_numpy()
    return Bitmap(cells.view(U64), bits)
