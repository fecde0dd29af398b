"""Suffix-array dedup: every byte covered by a LENGTH-byte string that starts elsewhere too is removed.

The difference cover is content-defined: of each LENGTH-byte string the sample holds the position
whose GRAM bytes hash lowest, so equal strings hold their sample at the same place (a fixed residue
cover needs all positions sorted, which is more than the input's size several times over). Samples
are named by the fingerprint of what follows; samples whose name is unique can't lie in a repeat and
drop out. The remaining suffixes are merged by (bytes up to the sample, name): those of
neighbouring offsets at first together, in STEPS of fewer and fewer. If the strings around all of them are repeated, all are; if
what they have in common isn't, none is; only what is left goes on, at last to single suffixes,
which are brought together over LENGTH bytes by their 96-bit fingerprints.

Defined results: null counts as empty; texts under LENGTH bytes stay; repeated rows are documents of
their own, so they remove each other; a null doc_id is a document; an empty table gives an empty
one. Of the input only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Prints, in_sketch, materialize, mix, pieces, same, sketch, text_buffer

LENGTH, GRAM = 400, 32
#: Offsets that are settled together, level by level.
STEPS = (64, 8, 1)
#: Possible distances of a string's start to its sample.
SPAN = LENGTH - GRAM + 1
_SECOND = 0xC2B2AE3D27D4EB4F


def samples(data: np.ndarray, off: np.ndarray, prints: Prints, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first and last start that it is the sample of, name) of each sample of the texts of a buffer."""
    n, span = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n - gram + 1)
    h = prints.of(at, at + gram)
    # Hash above, position below: one minimum finds the lowest hash, the leftmost of equal ones.
    bits = np.uint64(n.bit_length())
    low, width = (h >> bits << bits) | at.astype(np.uint64), 1
    while width < span:
        move = min(width, span - width)
        low = np.minimum(low[:-move], low[move:])
        width += move
    where = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(low)]
    starts = np.flatnonzero(np.arange(len(low)) + length <= off[doc + 1])
    where, doc = where[starts], doc[starts]
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return where[first], starts[first], starts[np.append(first[1:], len(starts)) - 1], h[where[first]]


def _doc_keys(raw: bytes, off: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(raw[s:e]) - (1 << 63) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)


def _sample_names(docs: DataFrame) -> DataFrame:
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20):
            data, off = text_buffer(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(samples(data, off, Prints(data))[3].view(np.int64))], ["name"])

    return docs.select("text").mapInArrow(names, "name long")


def _ranges(data: np.ndarray, off: np.ndarray, prints: Prints, bits: np.ndarray, opened: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of samples that the bitmap passes, the ranges of offsets of level len(opened): those of each level before that are still open, cut up.

    (sample's position, text, nearest and farthest offset, lowest and highest offset whose string lies in the text).
    """
    pos, first, last, name = samples(data, off, prints)
    keep = in_sketch(bits, name)
    p, low, high = pos[keep], (pos - last)[keep], (pos - first)[keep]  # the offsets that the sample is for
    cell_low, cell_high = low // STEPS[0], high // STEPS[0]
    for level, step in enumerate(STEPS[: len(opened) + 1]):
        n = cell_high - cell_low + 1
        at = np.repeat(np.arange(len(p)), n)
        cell = np.repeat(cell_low - np.cumsum(n) + n, n) + np.arange(n.sum())
        p, low, high = p[at], low[at], high[at]
        doc = np.searchsorted(off, p, "right") - 1
        near, far = cell * step, np.minimum(cell * step + step, SPAN) - 1
        # The nearest offset's string must end, and the farthest must start, inside the text.
        lowest, highest = np.maximum(near, p + LENGTH - off[doc + 1]), np.minimum(far, p - off[doc])
        if level == len(opened):
            return p, doc, near, far, lowest, highest
        keep = in_sketch(opened[level], _row_names(keys[doc], p - highest - off[doc], near))
        p, low, high, near, far = (x[keep] for x in (p, low, high, near, far))
        cell_low, cell_high = np.maximum(near, low) // STEPS[level + 1], np.minimum(far, high) // STEPS[level + 1]
    raise ValueError("more levels than steps")


def shared_part(prints: Prints, p: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Fingerprint of what the strings of a range all hold, and of its place to the sample. It lies inside each of them, and so inside the text."""
    return prints.of(p - near, p - far + LENGTH) ^ _mark(near, far)


def _mark(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a.astype(np.uint64) << np.uint64(20)) + b.astype(np.uint64) + np.uint64(1 << 50))


def _row_names(keys: np.ndarray, lo: np.ndarray, near: np.ndarray) -> np.ndarray:
    """A name for a range of a text, by which one of equal ranges stands for all."""
    return mix(keys.view(np.uint64) + _mark(lo, near)).view(np.int64)


RANGE = "c long, w1 long, w2 int, doc_id long, key int, lo int, hi int, row long"


def _range_rows(docs: DataFrame, bits, opened: list) -> DataFrame:
    """Each range of starts [lo, hi] of a text with fingerprints of what its strings share (c) and of all they cover (w1, w2)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20):
            data, off = text_buffer(b.column("text"))
            one, two = Prints(data), Prints(data, _SECOND)
            keys = _doc_keys(data.tobytes(), off) ^ mix(np.array(b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)).view(np.uint64)).view(np.int64)
            p, doc, near, far, lowest, highest = _ranges(data, off, one, bits.value, [x.value for x in opened], keys)
            start, end, own = p - highest, p - lowest + LENGTH, _mark(highest, lowest)
            w1, w2 = (x.of(start, end) ^ own for x in (one, two))
            ids, key = b.column("doc_id").take(pa.array(doc)), keys[doc]
            lo, hi = (start - off[doc]).astype(np.int32), (p - lowest - off[doc]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shared_part(one, p, near, far).view(np.int64)), pa.array(w1.view(np.int64)), pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), ids, pa.array((key >> 32).astype(np.int32)), pa.array(lo), pa.array(hi), pa.array(_row_names(key, lo.astype(np.int64), near))], ["c", "w1", "w2", "doc_id", "key", "lo", "hi", "row"])

    return docs.mapInArrow(rows, RANGE)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated (whether any byte went) for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = repeat_spans(docs)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data, off = text_buffer(b.column("text"))
            raw, out = data.tobytes(), []
            lists = b.column("spans")
            n = np.diff(np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))) if len(lists) else ()
            flat, at = lists.flatten(), 0
            low, high = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for s, e, k in zip(off[:-1].tolist(), off[1:].tolist(), map(int, n), strict=True):
                spans = _merged(low[at : at + k], high[at : at + k])
                at += k
                kept, last, gone = [], s, 0
                for lo, hi in spans:
                    kept.append(raw[last : s + lo])
                    last, gone = s + hi, gone + hi - lo
                kept.append(raw[last:e])
                out.append((e - s, gone, len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
            n, gone, spans, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    d = docs.withColumn("key", _key_of(docs))
    joined = d.alias("a").join(cut.alias("b"), same("doc_id", "key"), "left").select("a.doc_id", "text", "spans")
    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("repeated", F.col("n_removed") > 0)


def _key_of(docs: DataFrame):
    @F.pandas_udf("int")
    def key(doc_id, text):
        own = np.array([xxhash.xxh3_64_intdigest((t or "").encode()) - (1 << 63) for t in text], np.int64) ^ mix(doc_id.fillna(-1).to_numpy(np.int64).view(np.uint64)).view(np.int64)
        return (doc_id * 0).fillna(0).astype(np.int32) + (own >> 32).astype(np.int32)

    return key(F.col("doc_id"), F.col("text"))


def repeat_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans (lo, hi: byte offsets, perhaps overlapping) of the documents that hold repeats."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    repeated = _sample_names(docs).groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    bits = sc.broadcast(sketch(repeated, "name"))
    opened, spans = [], None
    for level in range(len(STEPS)):
        rows = materialize(_range_rows(docs, bits, opened), "suffix-ranges")
        kinds = rows.groupBy("c", "w1", "w2").agg(F.count("*").alias("n"), F.min("row").alias("row"))
        if level < len(STEPS) - 1:
            kinds = materialize(kinds, "suffix-classes")
            still = kinds.groupBy("c").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("c")
            # Of equal ranges one goes on for all: they are settled, but others may repeat a part of them.
            opened.append(sc.broadcast(sketch(kinds.join(still, "c").select("row"), "row")))
        twice = rows.join(kinds.where("n > 1").select("c", "w1", "w2"), ["c", "w1", "w2"]).select("doc_id", "key", "lo", (F.col("hi") + LENGTH).alias("hi"))
        spans = twice if spans is None else spans.unionByName(twice)
    return spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.append(True, lo[1:] > hi[:-1])
    return list(zip(lo[first].tolist(), hi[np.append(np.flatnonzero(first)[1:], len(lo)) - 1].tolist(), strict=True))
