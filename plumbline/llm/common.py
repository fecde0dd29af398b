"""What the corpus operators share: shared-folder tables, Arrow text buffers, a fixed-size set sketch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scratch import written as materialize

#: Bits of the set sketch: 8 MB whatever the size of the input.
SKETCH_BITS = 1 << 26
#: The six ASCII white-space bytes: \t \n \v \f \r and blank.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Bytes of an Arrow batch. The JVM and a Python worker hold a few batches of each task at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end at BATCH_BYTES, unless they do sooner: their rows may be long texts."""
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(*names: str):
    """Null-safe equality of the named columns of tables aliased a and b."""
    cond: Column | None = None
    for n in names:
        c = F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
        cond = c if cond is None else cond & c
    return cond


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(col) else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], most: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the rows of each hold about `most` bytes in a column (one row at least)."""
    for b in batches:
        start, size = 0, 0
        if not b.num_rows:
            continue
        for i, n in enumerate(_lengths(b.column(column))):
            if size and size + n > most:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        yield b.slice(start)
    give_back()


def give_back() -> None:
    """Return what batches took to the system: a Python worker lives on, idle, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _lengths(col: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(col), 0).to_pylist()


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document and the total) of the words `[^\\x20\\x09-\\x0D]+` of each document."""
    ink = np.zeros(len(data) + 1, bool)
    ink[:-1] = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = ink[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[off[:-1]] = True
    starts = np.flatnonzero(ink & (~before | edge))
    ends = np.flatnonzero(before & (~ink | edge))
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prints:
    """Fingerprints of substrings of a buffer: polynomial prefix sums modulo 2**64."""

    #: Powers of a base up to KEPT of them stay for the next buffer; a longer one's are its own.
    KEPT = 1 << 22
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = 0x9E3779B97F4A7C15, bytes_as: np.ndarray | None = None):
        n = len(data) + 1
        up, down = self._powers.get(base, (np.zeros(0, np.uint64),) * 2)
        if len(up) < n:
            size = max(n, 1 << 16)
            inverse = pow(base, -1, 1 << 64)
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]).astype(np.uint64)) for b in (base, inverse))
            if size <= self.KEPT:
                self._powers[base] = up, down
        table = mix(np.arange(256, dtype=np.uint64) + np.uint64(base & 0xFFFF))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(table[data] * up[: n - 1], out=self.sums[1:])
        self.down = down

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def sketch(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of SKETCH_BITS bits in which the bit of each 64-bit key of a table is set.

    Its size is fixed, so it may be broadcast. Further keys may share a bit: callers use it
    only to leave work out early, and settle what passes exactly.
    """
    bit = F.col(column).bitwiseAND(F.lit(SKETCH_BITS - 1))
    rows = keys.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63L as int))")).alias("bits")).toPandas()
    out = np.zeros(SKETCH_BITS // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_sketch(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64) & np.uint64(SKETCH_BITS - 1)
    return (bits[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1) != 0
