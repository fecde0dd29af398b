"""MinHash near-duplicates by a multi-index Hamming join.

Documents with equal shingle sets form a class. A class has a signature of SYMBOLS b-bit values,
one for each minimum; the share of unequal values estimates 1 - similarity. By the pigeonhole
principle, of two signatures at most `distance` values apart, cut into CHUNKS parts, one of the
first parts differs in at most `distance // CHUNKS` values or one of the others in fewer. The
allowed errors are enumerated by leaving values out, so that all pairs under the distance share a
key. Candidates are confirmed on the full sets.

Inside a bucket of one key, classes are first compared with one centre; once links have become
components, only members of different components are still compared, so a large group of copies
doesn't yield all its pairs and no link between different components is lost. That last comparison
runs inside tasks on blocks of a bucket's members, so a large bucket is many small groups; what
leaves a task are pairs under the signature distance whose sketches (the lowest hashes of their
sets) don't rule the similarity out, each from the first key that it shares.

Defined results: documents without words link with nothing; with fewer words than a shingle the
whole sequence is the one shingle; repeated rows get a row each; a null doc_id takes part like any
other document, also as a bridge, and a component of null ids alone has a null component_id; texts under
one doc_id are documents of their own; an empty table gives an empty one. Of the input only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, Prints, bounded_batches, in_sketch, materialize, mix, pieces, sketch, text_buffer, words_of
from plumbline.llm.components import components

SYMBOLS, BITS, CHUNKS = 64, 16, 16
#: Share of pairs at the threshold itself that may be further apart than the signature distance.
LOSS = 4e-4
#: Rounds in which a bucket's members are compared with one centre before all that is left is.
STAR_ROUNDS = 2
#: Members of a bucket that are compared in one group, and pairs that are compared at a time.
BLOCK, PAIRS_AT_ONCE = 512, 1 << 15
#: Groups that the pairs of one class are confirmed in.
SPREAD = 256
#: Lowest set hashes in a sketch, and the deviations by which it must fall short to rule a pair out.
SKETCH, DEVIATIONS = 512, 4.0
_PAD = np.uint32(0xFFFFFFFF)
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(1, 1 << 32, SYMBOLS, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, SYMBOLS, np.uint64).astype(np.uint32)
_C1, _C2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(texts: list[bytes] | tuple[np.ndarray, np.ndarray], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8)."""
    if isinstance(texts, list):
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
    else:
        data, off = texts
    data = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    starts, ends, first = words_of(data, off)
    h = Prints(data).of(starts, ends)
    n = len(h)
    grams = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        grams = mix(grams * _C1 + h[j : n - k + 1 + j] + _C2)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            x = np.uint64(hi - lo)
            for w in h[lo:hi]:
                x = mix(np.array([x], np.uint64) * _C2 + w + _C1)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS 16-bit values for each set; sets aren't empty."""
    if not sets:
        return np.zeros((0, SYMBOLS), np.uint16)
    x = (np.concatenate(sets) >> np.uint64(29)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for j in range(SYMBOLS):
        y = x * _A[j] + _B[j]
        y ^= y >> np.uint32(16)
        m = np.minimum.reduceat(y * np.uint32(0x7FEB352D), at)
        out[:, j] = (m * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return out


def distance_for(similar: int) -> int:
    """The least signature distance that loses at most LOSS of the pairs of that similarity (hundredths): values differ independently, each with chance 1 - similarity."""
    p = 1 - similar / 100
    left, d = 1.0, -1
    while left > LOSS and d < SYMBOLS:
        d += 1
        left -= math.comb(SYMBOLS, d) * p**d * (1 - p) ** (SYMBOLS - d)
    return d


def index_keys(sig: np.ndarray, distance: int, chunks: int = CHUNKS) -> np.ndarray:
    """The keys of each signature (a row of 64-bit numbers) under which any other within `distance` meets it."""
    errors, rest = divmod(distance, chunks)
    size = sig.shape[1] // chunks
    keys = []
    for c in range(chunks):
        part = sig[:, c * size : (c + 1) * size].astype(np.uint64)
        allowed = errors if c <= rest else errors - 1
        if allowed < 0:
            continue
        for left in combinations(range(size), size - allowed):  # values left out are the allowed errors
            key = np.full(len(sig), c * 64 + sum(1 << i for i in left), np.uint64)
            for i in left:
                key = mix(key * _C1 + part[:, i])
            keys.append(key)
    return np.stack(keys, 1)


def sketch_of(s: np.ndarray) -> bytes:
    """The sketch of a sorted set: the upper halves of its lowest hashes."""
    return np.minimum(s[:SKETCH] >> np.uint64(32), np.uint64(_PAD - 1)).astype(np.uint32).tobytes()


def _sketches(col: pa.Array) -> np.ndarray:
    """A row of SKETCH values for each sketch; sets of fewer are filled up."""
    out = np.full((len(col), SKETCH), _PAD, np.uint32)
    for i, low in enumerate(col.to_pylist()):
        out[i, : len(low) // 4] = np.frombuffer(low, np.uint32)
    return out


def may_be_similar(x: np.ndarray, y: np.ndarray, similar: int) -> np.ndarray:
    """Of rows of sketches x and y, whether the similarity of the sets may reach `similar` hundredths.

    Up to the lower of both last values a sketch holds all of its set: the share of common values
    there is exact for sets smaller than a sketch and else an estimate with a known deviation.
    """
    keep = np.zeros(len(x), bool)
    for at in range(0, len(x), 4096):
        a, b = x[at : at + 4096], y[at : at + 4096]
        both = np.sort(np.concatenate([a, b], 1), 1)
        top = np.minimum(a[:, -1], b[:, -1])[:, None]
        inside = (both <= top) & (both < _PAD)
        common = ((both[:, 1:] == both[:, :-1]) & inside[:, 1:]).sum(1)
        union = inside.sum(1) - common
        share = similar / 100
        slack = np.where(top[:, 0] == _PAD, 0.0, DEVIATIONS * np.sqrt(union * share * (1 - share)))
        keep[at : at + 4096] = common + 1 >= share * (union - 1) - slack  # one value may be two hashes
    return keep


def _signature_rows(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def class_texts(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id and text of the classes ids; a bitmap of fixed size keeps nearly all other texts out of the exchange. classes: id and rep, one document's doc_id and digest (xxhash64 of its text)."""
    wanted = materialize(ids.distinct().join(classes.select("id", "rep"), "id").select("id", F.col("rep.doc_id").alias("doc_id"), F.col("rep.digest").alias("digest")), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(sketch(wanted, "digest"))

    @F.pandas_udf("boolean")
    def maybe(x: pd.Series) -> pd.Series:
        return pd.Series(in_sketch(bits.value, x.to_numpy(np.int64)))

    # Rows alike are made one before they are sent, and texts are sent once: both sides are dealt by the same plain keys.
    key = {"digest": F.col("digest"), "known": F.col("doc_id").isNotNull(), "number": F.coalesce("doc_id", F.lit(0).cast("long"))}
    texts = docs.withColumn("digest", F.xxhash64("text")).where(maybe("digest"))
    texts = texts.groupBy(*[c.alias(k) for k, c in key.items()]).agg(F.first("text").alias("text"))
    return materialize(texts.join(wanted.select("id", *[c.alias(k) for k, c in key.items()]), list(key)).select("id", "text"), "pair-texts")


def representative() -> Column:
    """Of a class: the doc_id and digest of its first document, one without a doc_id last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))


def _open_sketches(ids: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id and sketch (`low`) of each of the classes ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20):
            sets = shingle_sets(text_buffer(b.column("text")), k)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([sketch_of(x) for x in sets], pa.binary())], ["id", "low"])

    return materialize(class_texts(ids.select("id"), reps, docs).mapInArrow(scan, "id long, low binary"), "open-sketches")


def _block_pairs(open_: DataFrame, reps: DataFrame, docs: DataFrame, k: int, similar: int) -> DataFrame:
    """The candidates (a, b) among members (key, id, root) of each bucket that lie in different components.

    Members are dealt to blocks of about BLOCK; each two blocks of a bucket are one group.
    """
    blocks = open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = open_.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("key", "id", "root", "block", other.alias("other")).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    carried = _open_sketches(open_, reps, docs, k).join(reps.select("id", "sig"), "id")
    dealt = dealt.join(carried, "id").select("key", "lo", "hi", "block", "id", "root", "sig", "low")
    grouped = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    distance = distance_for(similar)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*rest, b]).combine_chunks()
            edges = _group_edges(t)
            rest = t.slice(edges[-2]).to_batches()
            yield from _compared(t.slice(0, edges[-2]), edges[:-1], similar, distance)
        if rest:
            t = pa.Table.from_batches(rest).combine_chunks()
            yield from _compared(t, _group_edges(t), similar, distance)

    return grouped.mapInArrow(compare, "a long, b long")


def _group_edges(t: pa.Table) -> np.ndarray:
    """Where the groups of a sorted table start, and its end."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("key", "lo", "hi"):
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def _compared(t: pa.Table, edges: np.ndarray, similar: int, distance: int) -> Iterator[pa.RecordBatch]:
    if not t.num_rows:
        return
    key, lo, hi, block, ids, root = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "id", "root"))
    sig, low = _signature_rows(t.column("sig")), _sketches(t.column("low"))
    left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(ids)) - 1  # members after each in its group
    ends, at = np.cumsum(left), 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = left[at:to]
        x = np.repeat(np.arange(at, to), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        at = to
        keep = (root[x] != root[y]) & ((block[x] != block[y]) | (lo[x] == hi[x]))
        x, y = x[keep], y[keep]
        keep = (sig[x] != sig[y]).sum(1) <= distance
        x, y = x[keep], y[keep]
        kx, ky = index_keys(sig[x], distance), index_keys(sig[y], distance)
        keep = kx[np.arange(len(x)), (kx == ky).argmax(1)].view(np.int64) == key[x]
        x, y = x[keep], y[keep]
        keep = may_be_similar(low[x], low[y], similar)
        x, y = ids[x[keep]], ids[y[keep]]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, set1, set2 (a digest of the shingle set), sig (bytes; null without shingles)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20):
            sets = shingle_sets(text_buffer(b.column("text")), k)
            sig, at = signatures([s for s in sets if len(s)]), 0
            rows = []
            for i, digest, s in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), sets, strict=True):
                one = two = None
                if len(s):
                    one, two = (int(np.bitwise_xor.reduce(mix(s * c)).view(np.int64) if len(s) > 1 else mix(s * c)[0].view(np.int64)) for c in (_C1, _C2))
                    at += 1
                rows.append((i, digest, len(s), one, two, sig[at - 1].tobytes() if len(s) else None))
            kinds = (*[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "digest", "n_shingles", "set1", "set2", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(scan, "doc_id long, digest long, n_shingles long, set1 long, set2 long, sig binary")


def _close(pairs: DataFrame, reps: DataFrame, distance: int) -> DataFrame:
    """Those of pairs (a, b: class ids) under the signature distance."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = (_signature_rows(b.column("sa")) != _signature_rows(b.column("sb"))).sum(1) <= distance
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    one, two = (reps.select(F.col("id").alias(x), F.col("sig").alias(f"s{x}")) for x in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long")


def confirm(close: DataFrame, texts: DataFrame, k: int, similar: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets, of texts (id, text), are similar.

    The pairs of one a are dealt to SPREAD groups. A group holds a's text once, ahead of the texts it is
    compared with, so that a centre of a million pairs isn't sent a million times, nor to one task.
    """
    dealt = close.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int"))
    members = dealt.select("a", "deal", F.col("b").alias("id"), F.lit(1).alias("turn")).unionByName(dealt.select("a", "deal", F.col("a").alias("id"), F.lit(0).alias("turn")).distinct())
    rows = members.join(texts, "id").select("a", "deal", "turn", "id", "text").repartition("a", "deal").sortWithinPartitions("a", "deal", "turn")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for b in pieces(batches, 1 << 18):
            found = []
            sets = shingle_sets(text_buffer(b.column("text")), k)
            for a, turn, i, x in zip(b.column("a").to_pylist(), b.column("turn").to_pylist(), b.column("id").to_pylist(), sets, strict=True):
                if not turn:
                    own = x
                    continue
                both = len(np.intersect1d(own, x, assume_unique=True))
                if 100 * both >= similar * (len(own) + len(x) - both):
                    found.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in (0, 1)], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, similar: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, digest (xxhash64 of the text) and first for each row of docs. similar: least similarity in hundredths.

    kept: the row has its component's id. first: it is that one document (doc_id, digest) of its component that stands for all.
    """
    bounded_batches(docs.sparkSession)
    docs, distance = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), distance_for(similar)
    every = materialize(_classes(docs, k), "shingled")
    full, of_set = every.where("n_shingles > 0"), ["set1", "set2", "n_shingles"]
    reps = materialize(full.groupBy(*of_set).agg(representative().alias("rep"), F.first("sig").alias("sig")).withColumn("id", F.monotonically_increasing_id()), "set-classes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = index_keys(np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS), distance)
                ids = np.repeat(b.column("id").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    keyed = reps.select("id", "sig").mapInArrow(spread, "key long, id long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("centre")).where("n > 1").select("key", "centre")
    buckets = materialize(keyed.join(shared, "key"), "buckets")
    links = None
    roots = reps.select(F.col("id").alias("node"), F.col("id").alias("root")).limit(0)
    for turn in range(STAR_ROUNDS + 1):
        if turn == 0:
            pairs = buckets.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))
        else:
            known = buckets.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
            split = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("id").alias("last")).where("lo <> hi")
            open_ = known.join(split.select("key", "last"), "key")
            ends = open_.where("id = last").select("key", F.col("root").alias("r2"))
            pairs = open_.join(ends, "key").where("root <> r2").select(F.col("last").alias("a"), F.col("id").alias("b"))
        if turn < STAR_ROUNDS:
            pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
            close = materialize(_close(pairs, reps, distance), "close-pairs")
        else:
            close = materialize(_block_pairs(open_.select("key", "id", "root"), reps, docs, k, similar), "close-pairs")
        texts = class_texts(close.select(F.col("a").alias("id")).union(close.select("b")), reps, docs)
        found = materialize(confirm(close, texts, k, similar), "near-links")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    return with_components(every, reps, roots).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "digest", "first")


def with_components(every: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """every (doc_id, digest, n_shingles, set1, set2) with component_id and first: classes (id, rep) of one root are one component."""
    of_set = ["set1", "set2", "n_shingles"]
    named = classes.select("id", *of_set, "rep").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("lead")), "root").select(*of_set, "lead")
    # A group of copies with a third of all rows meets one row here, which Spark may split.
    out = every.select("doc_id", "digest", *of_set).join(named, of_set, "left")
    alone = F.col("n_shingles") == 0
    first = alone | (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("digest") == F.col("lead.digest")))
    return out.select("doc_id", "digest", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("component_id"), F.coalesce(first, F.lit(False)).alias("first"))
