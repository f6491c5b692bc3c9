"""A reproducible shuffle into shards: a keyed permutation of row numbers.

Rows are numbered in a fixed order. A Feistel network permutes the numbers 0 to 4^b - 1; cycle walking
(applying it again until the result is below the number of rows) makes of it a permutation of the row
numbers. The permuted number gives shard and slot, so either can be computed from the other, in both directions,
without a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.storage import numbered

ROUNDS = 6
_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (xor-shifts and odd multiplications)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 to ``n`` - 1 fixed by ``seed``."""

    n: int
    seed: int = 0

    @property
    def half(self) -> int:
        """Bits of either half; the network permutes twice as many."""
        return max(1, (max(1, self.n - 1).bit_length() + 1) // 2)

    def _keys(self) -> list[np.uint64]:
        with np.errstate(over="ignore"):
            start = np.array([self.seed % (1 << 64)], np.uint64)
            return [_mixed(start + np.uint64((k + 1) * _GOLDEN % (1 << 64)))[0] for k in range(ROUNDS)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & low
        with np.errstate(over="ignore"):
            for key in reversed(self._keys()) if back else self._keys():
                if back:
                    left, right = right ^ (_mixed(left + key) & low), left
                else:
                    left, right = right, left ^ (_mixed(right + key) & low)
        return left << bits | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(numbers).astype(np.uint64), back)
        outside = out >= self.n
        while outside.any():
            out[outside] = self._once(out[outside], back)
            outside = out >= self.n
        return out.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def inverse(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, True)


def place_of(number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    at = int(Permutation(n, seed).forward(np.array([number]))[0])
    return at % shards, at // shards


def number_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number at a shard and slot."""
    return int(Permutation(n, seed).inverse(np.array([slot * shards + shard]))[0])


def assign(docs: DataFrame, order: tuple[str, ...] = ("doc_id",), shards: int = 24, seed: int = 0) -> DataFrame:
    """``docs`` with row_number, shard and slot (long, int, long); columns of these names are replaced.

    Rows are numbered in the order of the columns ``order`` (short ones: samples of them reach the driver), nulls first, then of a hash of
    all columns; rows alike in all of them are interchangeable. Shards differ by one row at most, and slots run from 0 without
    gaps. The result depends on the rows and the seed alone, not on files, partitions or cores.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("row_number", "shard", "slot")]
    keys = [F.col(f"doc.`{c}`").asc_nulls_first() for c in order]
    rows, n = numbered(docs.select(F.struct(*own).alias("doc")), *keys, F.xxhash64("doc"), name="row_number")

    @F.arrow_udf("long")
    def permuted(numbers: pa.Array) -> pa.Array:
        return pa.array(Permutation(n, seed).forward(numbers.to_numpy(zero_copy_only=False)))

    return (
        rows.withColumn("_at", permuted("row_number"))
        .withColumn("shard", (F.col("_at") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_at DIV {shards}"))
        .select("doc.*", "row_number", "shard", "slot")
    )
