"""N-gram Jaccard join by grouped prefixes.

A document's word shingles are put in one order that holds for all documents: rare ones first. Two sets of
that similarity share one of their first n - ceil(similar * n) + 1 shingles, their prefixes. Equal
sets form a class; classes with the same size and the same prefix form a group, which stands for them in the
search. Groups that share a prefix shingle meet under it; a pair of groups goes on if its sizes and the places
of the shingle leave room for the overlap. Only then are groups expanded into their members, and those are verified on full sets.

Under one shingle, groups are first compared with one centre; once links have become components, only
members of different components are compared any more, so many near copies don't give all their pairs and no link
between components is lost. That last comparison runs inside tasks on blocks of a shingle's members.

The order rests on a table of LEVELS counters, each for the shingles that hash to it, of fixed size and so
broadcast. Sharing a counter makes an order less good, never a result different: any order that is the same for all documents
finds all pairs. A shingle whose counter is one is in one document and meets no other.

Defined results: without words a document links with nothing; with fewer words than a shingle the sequence
is its one shingle; repeated rows get a row each; a null doc_id takes part like any other document, also as a
bridge, and a component of null ids alone has a null component_id; texts under one doc_id are
documents of their own; an empty table gives an empty one. Of the input only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches, give_back, materialize, mix, pieces, text_buffer
from plumbline.llm.components import components
from plumbline.llm.near_dup import class_texts, confirm, representative, shingle_sets, with_components

#: Counters of the order, and those that travel in one row.
LEVELS, SLICE = 1 << 26, 1 << 16
#: Rounds in which a shingle's groups are compared with one centre before all that is left is.
STAR_ROUNDS = 2
#: Centres that a shingle has in each round after the first.
CENTRES = 8
#: Members of a shingle that are compared in one group, and pairs that are compared at a time.
BLOCK, PAIRS_AT_ONCE = 512, 1 << 15
#: 64-bit words of a prefix's bitmap.
WORDS = 8
_C1, _C2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_SHIFT = np.uint64(64 - LEVELS.bit_length() + 1)


def shingle_levels(docs: DataFrame, k: int) -> np.ndarray:
    """For each counter about the logarithm of how many documents hold a shingle of its own: 1 for one document, 15 at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS, np.uint8)
        for b in pieces(batches, 1 << 20):
            sets = shingle_sets(text_buffer(b.column("text")), k)
            at, n = np.unique(np.concatenate(sets) >> _SHIFT, return_counts=True)
            seen[at] = np.minimum(seen[at] + n, 255)
        for i in range(0, LEVELS, SLICE):
            if (part := seen[i : i + SLICE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], ["slice", "counts"])
        del seen
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if i not in sums and sums:  # rows come sorted
                    yield told(*sums.popitem())
                sums.setdefault(i, np.zeros(SLICE, np.int64))
                sums[i] += np.frombuffer(pa.decompress(x, SLICE, "zstd", asbytes=True), np.uint8)
        if sums:
            yield told(*sums.popitem())

    def told(i: int, n: np.ndarray) -> pa.RecordBatch:
        level = np.minimum(np.frexp(n.astype(np.float64))[1], 15).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pa.compress((level[::2] | level[1::2] << 4).tobytes(), "zstd", asbytes=True)], pa.binary())], ["slice", "levels"])

    parts = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition("slice").sortWithinPartitions("slice")
    out = np.zeros(LEVELS // 2, np.uint8)
    for r in parts.mapInArrow(add, "slice int, levels binary").toLocalIterator():  # LEVELS / SLICE rows
        at = r["slice"] * SLICE // 2
        out[at : at + SLICE // 2] = np.frombuffer(pa.decompress(bytes(r["levels"]), SLICE // 2, "zstd", asbytes=True), np.uint8)
    return out


def level_of(levels: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    at = (shingles >> _SHIFT).astype(np.int64)
    return (levels[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & np.uint8(15)


def prefix_of(shingles: np.ndarray, levels: np.ndarray, similar: int) -> np.ndarray:
    """The prefix of a sorted set: its first shingles by (level, hash)."""
    n = len(shingles)
    key = (level_of(levels, shingles).astype(np.uint64) << np.uint64(60)) | (shingles >> np.uint64(4))
    return shingles[np.argsort(key, kind="stable")[: prefix_size(n, similar)]]


def prefix_size(n, similar: int):
    return n - -(-similar * n // 100) + 1


def bitmap_of(prefix: np.ndarray) -> np.ndarray:
    """A bit for each shingle of a prefix, by its hash."""
    at = (prefix & np.uint64(64 * WORDS - 1)).astype(np.int64)
    out = np.zeros(WORDS, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def _enough(n1, bits1, n2, bits2, similar: int) -> np.ndarray:
    """Whether sets of sizes n1 and n2 may be similar by what their prefixes share.

    Bits in common, and shingles that share a bit with others, bound the common prefix shingles. Of the set whose prefix ends
    first in the order, all other common shingles lie behind its prefix.
    """
    p1, p2 = prefix_size(n1, similar), prefix_size(n2, similar)
    common = np.bitwise_count(bits1 & bits2).sum(1).astype(np.int64)
    hidden = np.minimum(p1 - np.bitwise_count(bits1).sum(1).astype(np.int64), p2 - np.bitwise_count(bits2).sum(1).astype(np.int64))
    return (common + hidden + np.maximum(n1 - p1, n2 - p2)) * (100 + similar) >= similar * (n1 + n2)


def _digests(x: np.ndarray) -> tuple[int, int]:
    return tuple(int(np.bitwise_xor.reduce(mix(x * c)).view(np.int64)) for c in (_C1, _C2))


def _shingled(docs: DataFrame, levels, k: int, similar: int) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, digests of the set and of its prefix, the prefix."""
    names = ["doc_id", "digest", "n_shingles", "set1", "set2", "pre1", "pre2", "prefix"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20):
            rows = []
            for x in shingle_sets(text_buffer(b.column("text")), k):
                if len(x):
                    p = prefix_of(x, levels.value, similar)
                    rows.append((len(x), *_digests(x), *_digests(p), p.tobytes()))
                else:
                    rows.append((0, None, None, None, None, None))
            kinds = (*[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), *[pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names)

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(scan, "doc_id long, digest long, n_shingles long, set1 long, set2 long, pre1 long, pre2 long, prefix binary")


def _with_bitmaps(groups: DataFrame) -> DataFrame:
    """groups with `bits`, the bitmap of their prefix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20, "prefix"):
            bits = [bitmap_of(np.frombuffer(x, np.uint64)).tobytes() for x in b.column("prefix").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits, pa.binary())], [*b.schema.names, "bits"])

    return groups.mapInArrow(add, "gid long, n long, members long, pre1 long, pre2 long, prefix binary, bits binary")


def _bitmaps(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, WORDS)


def _likely(pairs: DataFrame, groups: DataFrame, similar: int) -> DataFrame:
    """Those of pairs (a, gid: groups) whose prefixes share enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = _enough(b.column("na").to_numpy(), _bitmaps(b.column("bits_a")), b.column("n").to_numpy(), _bitmaps(b.column("bits")), similar)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("gid")], ["a", "gid"]).filter(pa.array(keep))

    one = groups.select(F.col("gid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    return pairs.join(one, "a").join(groups.select("gid", "n", "bits"), "gid").select("a", "gid", "na", "n", "bits_a", "bits").mapInArrow(compare, "a long, gid long")


def _prefix_rows(groups: DataFrame, levels) -> DataFrame:
    """A row (key, gid, n, pos, members) for each prefix shingle of each group that more than one document may hold."""
    names = ["key", "gid", "n", "pos", "members"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20, "prefix"):
            parts = [np.frombuffer(x, np.uint64) for x in b.column("prefix").to_pylist()]
            keys, size = np.concatenate(parts), np.array([len(p) for p in parts])
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
            more = level_of(levels.value, keys) > 1
            per = [np.repeat(b.column(c).to_numpy(), size)[more] for c in ("gid", "n", "members")]
            yield pa.RecordBatch.from_arrays([pa.array(keys[more].view(np.int64)), pa.array(per[0]), pa.array(per[1]), pa.array(pos[more], pa.int64()), pa.array(per[2])], names)

    return groups.select("gid", "n", "members", "prefix").mapInArrow(spread, "key long, gid long, n long, pos long, members long")


def _room(n1, p1, n2, p2, similar: int):
    """Whether sets of sizes n1 and n2 whose first common shingle stands at p1 and p2 may be similar: whole numbers, columns or arrays."""
    least = F.least if isinstance(n1, Column) else np.minimum
    return (least(n1 - p1, n2 - p2) * (100 + similar) >= similar * (n1 + n2)) & (n1 * 100 >= similar * n2) & (n2 * 100 >= similar * n1)


def _blocks(open_: DataFrame, groups: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) of members (key, gid, n, pos, id, root) that share a shingle, lie in different components and have room for the overlap, as far as their prefixes tell."""
    blocks = open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = open_.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("*", other.alias("other")).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    rows = dealt.join(groups.select("gid", "bits"), "gid").select("key", "lo", "hi", "gid", "n", "pos", "block", "id", "root", "bits")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "gid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*rest, b]).combine_chunks()
            edges = _edges(t)
            for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
                yield from _compared(t.slice(lo, hi - lo), similar)
            rest = t.slice(edges[-2]).to_batches()
        if rest:
            yield from _compared(pa.Table.from_batches(rest).combine_chunks(), similar)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _edges(t: pa.Table) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for c in ("key", "lo", "hi"):
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def _compared(t: pa.Table, similar: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one block or of two: groups are compared, then what is left of them is expanded into members."""
    gid, n, pos, block, ids, root = (t.column(c).to_numpy() for c in ("gid", "n", "pos", "block", "id", "root"))
    same = bool(t.column("lo")[0] == t.column("hi")[0])
    first = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
    size = np.diff(np.r_[first, len(gid)])
    n, pos, lo, hi = n[first], pos[first], np.minimum.reduceat(root, first), np.maximum.reduceat(root, first)
    whole, every = lo == hi, np.arange(len(first))
    if lo.min() == hi.max():
        return
    bits = _bitmaps(t.column("bits").take(first))
    step = max(1, PAIRS_AT_ONCE // len(first))
    for at in range(0, len(first), step):
        a = every[at : at + step, None]
        room = _room(n[a], pos[a], n[None, :], pos[None, :], similar) & (every[None, :] >= a)
        room &= ~(whole[a] & whole[None, :] & (lo[a] == lo[None, :]))
        g, o = np.nonzero(room)
        g += at
        keep = _enough(n[g], bits[g], n[o], bits[o], similar)
        g, o = g[keep], o[keep]
        count = size[g] * size[o]
        ends, done = np.cumsum(count), 0
        while done < len(g):  # a pair of groups has BLOCK * BLOCK pairs of members at most
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
            c = count[done:to]
            pair = np.repeat(np.arange(done, to), c)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(c) - c, c)
            x, y = first[g[pair]] + k // size[o[pair]], first[o[pair]] + k % size[o[pair]]
            done = to
            keep = (x < y) & (root[x] != root[y]) & (same | (block[x] != block[y]))
            x, y = ids[x[keep]], ids[y[keep]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def similar_documents(docs: DataFrame, k: int = 5, similar: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs. similar: least Jaccard similarity in hundredths, of sets of k-word shingles."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, k))
    every = materialize(_shingled(docs, levels, k, similar), "shingled")
    of_set = ["set1", "set2", "n_shingles"]
    full, of_group = every.where("n_shingles > 0"), ["pre1", "pre2", "n_shingles"]
    classes = full.groupBy(*of_set).agg(representative().alias("rep"), F.first("pre1").alias("pre1"), F.first("pre2").alias("pre2"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "set-classes")
    # A prefix is as long as a seventh of its document: it is sent once for each group and task.
    prefixes = full.groupBy(*of_group).agg(F.first("prefix").alias("prefix"))
    groups = classes.groupBy(*of_group).agg(F.min("id").alias("gid"), F.count("*").alias("members")).join(prefixes, of_group)
    groups = materialize(_with_bitmaps(groups.select("gid", F.col("n_shingles").alias("n"), "members", "pre1", "pre2", "prefix")), "groups")
    members = materialize(classes.select("id", *of_group).join(groups.select("gid", "pre1", "pre2", F.col("n").alias("n_shingles")), of_group).select("gid", "id"), "members")
    keyed = _prefix_rows(groups, levels).repartition("key")  # sent once: for what a shingle's groups have in common, and for the groups that it has
    shared = keyed.groupBy("key").agg(F.sum("members").alias("all"), F.min(F.struct("gid", "n", "pos")).alias("centre")).where(F.col("all") > 1).select("key", "centre")
    buckets = materialize(keyed.join(shared, "key"), "buckets")
    links = roots = None
    for turn in range(STAR_ROUNDS + 1):
        if roots is None:
            meet = buckets.select("centre", "gid", "n", "pos", "members")
        else:
            node = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("gid", "id", F.coalesce("root", "id").alias("root"))
            node = materialize(node, "rooted")
            span = node.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
            known = buckets.drop("centre").join(span, "gid")
            split = known.groupBy("key").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least <> most").select("key")
            open_ = materialize(known.join(split, "key"), "open")
        if turn and turn < STAR_ROUNDS:
            drawn = [F.min(F.struct(F.xxhash64("gid", "key", F.lit(i)).alias("turn"), "gid", "n", "pos", F.col("lo").alias("root"))) for i in range(turn * CENTRES, (turn + 1) * CENTRES)]
            meet = open_.join(open_.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("centres")), "key").withColumn("centre", F.explode("centres"))
            meet = meet.where("lo <> hi or lo <> centre.root or members > 1").select("centre", "gid", "n", "pos", "members")
        if turn < STAR_ROUNDS:
            meet = meet.where("gid <> centre.gid or members > 1").where(_room(F.col("n"), F.col("pos"), F.col("centre.n"), F.col("centre.pos"), similar))
            pairs = _likely(meet.select(F.col("centre.gid").alias("a"), "gid").distinct(), groups, similar)  # the centre stands for its group by its first member
            pairs = pairs.join(members, "gid").where("a <> id").select("a", F.col("id").alias("b"))
            if roots is not None:  # what is one component already isn't compared again
                at = node.select("id", "root")
                pairs = pairs.join(at.withColumnsRenamed({"id": "a", "root": "ra"}), "a").join(at.withColumnsRenamed({"id": "b", "root": "rb"}), "b").where("ra <> rb").select("a", "b")
            pairs = materialize(pairs, "pairs")
        else:
            inside = open_.select("key", "gid", "n", "pos").join(node, "gid")
            pairs = materialize(_blocks(inside, groups, similar), "pairs")
        texts = class_texts(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), classes, docs)
        found = materialize(confirm(pairs, texts, k, similar), "links")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    return with_components(every, classes, roots).select("doc_id", "n_shingles", "component_id")
