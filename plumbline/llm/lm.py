"""LM scoring by prediction by partial matching (PPM) over bytes.

A trie of byte contexts up to ORDER bytes is counted over all training documents. A byte's chance in
a context is its count against the total and the number of different bytes seen there (the escape,
method C); after an escape the shorter context is asked, less the symbols that the longer one held
(exclusion). Texts are scored with the trained trie: the sum of log10 over their bytes, in lower
case, and an end mark.

The trie's counts are tables over all training documents. The chances of its most frequent grams, a
number fixed beforehand, are broadcast; a text's other grams are joined with the full tables, so that
every chance is exact whatever their number. Orders below two are bounded by the alphabet.

Beside it stands a unigram word model with add-one smoothing. Counts of the most frequent words, a
number fixed beforehand, are broadcast; those of all others are joined, so that all are exact.

Defined results: null counts as empty, which has the end mark alone; repeated rows get a row each
and count each; a null doc_id isn't held out; without training documents every chance is that of an
unseen symbol; an empty table gives an empty one. Of the input only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, materialize, pieces, same, text_buffer

ORDER = 3
#: Leaves of the trie (grams of the longest contexts and a symbol) that are broadcast: the most frequent, ties by value. All others are joined.
TRIE_LEAVES = 1 << 20
#: Words whose counts are broadcast, and the longest such word in bytes.
BROADCAST_WORDS, LONGEST = 1 << 18, 64
#: Starts and ends a text; no byte of UTF-8.
MARK = 0xFF
_FLUSH = 400_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def grams_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts and their end marks with the three before it as one number, and where each text's begin."""
    n, docs = len(data), len(off) - 1
    gap = ORDER + 1
    buf = np.full(n + docs * gap, MARK, np.uint32)
    at = off[:-1] + np.arange(docs) * gap  # three marks before each text, one after it
    place = np.repeat(at + ORDER - off[:-1], np.diff(off)) + np.arange(n)
    buf[place] = data
    g = (buf[:-3] << 24) | (buf[1:-2] << 16) | (buf[2:-1] << 8) | buf[3:] if docs else buf
    use = np.ones(len(buf), bool)
    for k in range(ORDER):
        use[at + k] = False
    return g[use[3:]] if docs else g, off[:-1] + np.arange(docs)


def _lower(b: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    data, off = text_buffer(b.column("text"))
    return data.tobytes().translate(LOWER), off


def count_grams(docs: DataFrame) -> DataFrame:
    """gram, n: how often each byte follows each ORDER bytes, over all of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for b in pieces(batches):
            raw, off = _lower(b)
            g = np.sort(grams_of(np.frombuffer(raw, np.uint8), off)[0])
            first = np.flatnonzero(np.diff(g, prepend=g[:1] + 1))
            held = np.concatenate([held[0], g[first]]), np.concatenate([held[1], np.diff(first, append=len(g))])
            if len(held[0]) > 4_000_000:
                held = _summed(*held)
                if len(held[0]) > 2_000_000:
                    yield _gram_batch(held)
                    held = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        yield _gram_batch(_summed(*held))

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _summed(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(g, kind="stable")
    g = g[order]
    first = np.flatnonzero(np.diff(g, prepend=g[:1] + 1)) if len(g) else np.zeros(0, int)
    return g[first], np.add.reduceat(n[order], first) if len(g) else n


def _gram_batch(held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int64)), pa.array(held[1])], ["gram", "n"])


def gram_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gram, n), (gram2, n2) and (context, total, kinds, mass) of all training grams.

    gram2 is a gram's last three bytes; a context is its first three. mass: the count, one order
    below, of the symbols that the context holds, which an escape from it excludes.
    """
    three = materialize(counts, "gram-counts")
    gram2 = F.col("gram").bitwiseAND(F.lit((1 << 8 * ORDER) - 1)).alias("gram2")
    two = materialize(three.groupBy(gram2).agg(F.sum("n").alias("n2")), "gram-counts")
    below = three.select("gram", "n", gram2).join(two, "gram2")
    contexts = below.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("n2").alias("mass"))
    return three, two, materialize(contexts, "gram-contexts")


class Lower:
    """Counts of the orders below two and totals of contexts up to two bytes: their number is bounded by the alphabet."""

    def __init__(self, two: DataFrame):
        """two: (gram2, n2) of all training grams."""
        pair = F.col("gram2").bitwiseAND(F.lit(0xFFFF)).alias("pair")
        ones = two.groupBy(pair).agg(F.sum("n2").alias("n1"))
        rows = ones.toArrow()
        self.n1 = _dense(rows["pair"], rows["n1"], 1 << 16)
        twos = two.select(F.shiftright("gram2", 8).alias("context"), "n2", pair).join(F.broadcast(ones), "pair")
        rows = twos.groupBy("context").agg(F.sum("n2").alias("total"), F.count("*").alias("kinds"), F.sum("n1").alias("mass")).toArrow()
        self.total2, self.kinds2, self.mass2 = (_dense(rows["context"], rows[c], 1 << 16) for c in ("total", "kinds", "mass"))
        table = self.n1.reshape(256, 256)  # context, symbol
        self.n0 = table.sum(0)
        self.total1, self.kinds1, self.mass1 = table.sum(1), (table > 0).sum(1).astype(np.float64), (table > 0) @ self.n0
        self.total0, self.kinds0 = self.n0.sum(), float((self.n0 > 0).sum())

    def log10(self, grams: np.ndarray, n3: np.ndarray, total3: np.ndarray, kinds3: np.ndarray, mass3: np.ndarray, n2: np.ndarray) -> np.ndarray:
        """log10 of the chance of each gram's last byte after the three before it; the counts of the longer orders are given, 0 where there are none."""
        pair, two, one, last = grams & 0xFFFF, grams >> 8 & 0xFFFF, grams >> 8 & 0xFF, grams & 0xFF
        none = np.zeros(len(grams))
        orders = [
            (n3, total3, kinds3),
            (n2, self.total2[two] - mass3, self.kinds2[two] - kinds3),
            (self.n1[pair], self.total1[one] - self.mass2[two], self.kinds1[one] - self.kinds2[two]),
            (self.n0[last], self.total0 - self.mass1[one], self.kinds0 - self.kinds1[one]),
        ]
        out, todo = none, np.ones(len(grams), bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            for n, t, d in orders:
                live = todo & (d > 0)  # else every symbol of the context is excluded: no choice is made here
                hit = live & (n > 0)
                out = np.where(live, out + np.log10(np.where(hit, n, d) / (t + d)), out)
                todo &= ~hit
        return np.where(todo, out - np.log10(np.maximum(1, 256 - self.kinds0)), out)


def _dense(key: pa.ChunkedArray, value: pa.ChunkedArray, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[key.to_numpy()] = value.to_numpy()
    return out


class Trie:
    """log10 chances of the most frequent training grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, logs: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.n, self.logs = grams[order].astype(np.uint32), counts[order].astype(np.float64), logs[order]
        self._table: np.ndarray | None = None

    def _fill(self) -> None:
        """A table of the grams whose halves are frequent."""
        pairs = np.zeros(1 << 16, np.uint16)
        high, low = self.grams >> np.uint32(16), self.grams & np.uint32(0xFFFF)
        share = np.bincount(high, self.n, 1 << 16) + np.bincount(low, self.n, 1 << 16)
        best = np.argsort(-share, kind="stable")[:2047]
        best = best[share[best] > 0]
        pairs[best] = np.arange(1, len(best) + 1)
        table = np.full((len(best) + 1, len(best) + 1), np.nan, np.float64)
        hi, lo = pairs[high], pairs[low]
        both = (hi > 0) & (lo > 0)
        table[hi[both], lo[both]] = self.logs[both]
        self._pairs, self._table = pairs, table

    def sums(self, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
        """Of each text: the sum of its grams' log10 chances, and its grams that aren't held, with how often each stands there."""
        if self._table is None:
            self._fill()
        g, begin = grams_of(np.frombuffer(raw, np.uint8), off)
        docs = len(off) - 1
        x = self._table[self._pairs[g >> np.uint32(16)], self._pairs[g & np.uint32(0xFFFF)]]
        rest = np.flatnonzero(np.isnan(x))
        values, inverse = np.unique(g[rest], return_inverse=True)
        at = np.searchsorted(self.grams, values)
        at[at == len(self.grams)] = 0
        logs = np.where(self.grams[at] == values, self.logs[at], np.nan) if len(self.grams) else np.full(len(values), np.nan)
        x[rest] = logs[inverse]
        rest = rest[np.isnan(x[rest])]
        x[rest] = 0
        text = np.searchsorted(begin, rest, "right") - 1
        other, times = np.unique(text.astype(np.uint64) << np.uint64(32) | g[rest], return_counts=True)
        lists = np.searchsorted(other >> np.uint64(32), np.arange(docs + 1, dtype=np.uint64)).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array((other & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(times.astype(np.int64))], ["gram", "times"])
        return np.add.reduceat(x, begin) if len(g) else np.zeros(docs), pa.ListArray.from_arrays(pa.array(lists), entries)


def other_chances(rest: DataFrame, three: DataFrame, two: DataFrame, contexts: DataFrame, lower: Lower) -> DataFrame:
    """gram, log: the exact chance of each gram of rest, by the full counts."""
    model = rest.sparkSession.sparkContext.broadcast(lower)
    u = rest.select("gram").distinct().withColumn("context", F.shiftright("gram", 8)).withColumn("gram2", F.col("gram").bitwiseAND(F.lit((1 << 8 * ORDER) - 1)))
    u = u.join(three, "gram", "left").join(contexts, "context", "left").join(two, "gram2", "left")
    u = u.select("gram", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("n", "total", "kinds", "mass", "n2")])

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.log10(*[c.to_numpy(zero_copy_only=False) for c in b.columns]))], ["gram", "log"])

    return u.mapInArrow(chance, "gram long, log double")


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes), c: how often each word occurs in docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in pieces(batches):
            held.update(_lower_words(b))
            if len(held) > _FLUSH:
                yield _word_batch(held)
                held.clear()
        yield _word_batch(held)

    def _lower_words(b: pa.RecordBatch) -> Iterator[bytes]:
        raw, off = _lower(b)
        for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            yield from raw[s:e].split()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _word_batch(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs. train: which rows to learn from."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("train", train)
    learn = docs.where("train")
    words = materialize(count_words(learn), "word-counts")
    facts = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).collect()[0]
    ends = learn.count()
    n, v = facts[0] + ends, facts[1] + (ends > 0)
    top = words.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(BROADCAST_WORDS).toArrow()
    three, two, contexts = gram_tables(count_grams(learn))
    leaves = three.orderBy(F.desc("n"), "gram").limit(TRIE_LEAVES).withColumn("context", F.shiftright("gram", 8)).join(contexts, "context")
    leaves = leaves.select("gram", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("log")).toArrow()
    frequent = dict(zip(top["word"].to_pylist(), np.log10(top["c"].to_numpy() + 1.0).tolist(), strict=True))
    trie = Trie(*(leaves[c].to_numpy() for c in ("gram", "n", "log")))
    model = spark.sparkContext.broadcast((frequent, trie))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, trie = model.value
        for b in pieces(batches):
            raw, off = _lower(b)
            rows = []
            for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                w = raw[s:e].split()
                known = [x for x in map(frequent.get, w) if x is not None]
                rows.append((len(w), len(known), float(np.sum(known)), hash_key(raw[s:e])))
            cols = list(zip(*rows, strict=True))
            sums, rest = trie.sums(raw, off)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[3], pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(sums), rest], ["doc_id", "key", "words", "known", "logs", "score", "rest"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, _ = model.value
        for b in pieces(batches, 2 << 20):
            raw, off = _lower(b)
            ids, keys, out, tf = [], [], [], []
            for i, s, e in zip(b.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                c = Counter(x for x in raw[s:e].split() if x not in frequent)
                ids += [i] * len(c)
                keys += [hash_key(raw[s:e])] * len(c)
                out += c.keys()
                tf += c.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(out, pa.binary()), pa.array(tf, pa.int32())], ["doc_id", "key", "word", "tf"])

    seen = docs.select("doc_id", "text").mapInArrow(rare, "doc_id long, key long, word binary, tf int")
    hit = seen.join(words, "word").groupBy("doc_id", "key").agg(F.sum("tf").alias("rare_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    # Repeated rows are counted together above: each has its share.
    mine = docs.select("doc_id", "text").mapInArrow(own, "doc_id long, key long, words long, known long, logs double, score double, rest array<struct<gram:long,times:long>>")
    mine = materialize(mine, "lm-scores")
    times = mine.groupBy("doc_id", "key").agg(F.count("*").alias("times")).where("times > 1")
    hit = hit.alias("a").join(times.alias("b"), same("doc_id", "key"), "left").select("a.doc_id", "a.key", (F.col("rare_known") / F.coalesce("times", F.lit(1))).alias("rare_known"), (F.col("rare_logs") / F.coalesce("times", F.lit(1))).alias("rare_logs"))
    rest = mine.where(F.size("rest") > 0).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.inline("rest"))
    others = rest.join(other_chances(rest, three, two, contexts, Lower(two)), "gram").groupBy("doc_id", "key").agg(F.sum(F.col("times") * F.col("log")).alias("rest_score"))
    out = mine.drop("rest").alias("a").join(hit.alias("b"), same("doc_id", "key"), "left")
    out = out.select("a.*", "rare_known", "rare_logs").alias("a").join(others.alias("b"), same("doc_id", "key"), "left")
    known = F.col("known") + F.coalesce("rare_known", F.lit(0)) + (1 if ends else 0)
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + float(np.log10(ends + 1))
    tokens = F.col("words") + 1
    return out.select("a.doc_id", held_out(F.col("a.doc_id")).alias("held_out"), tokens.alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (logs - tokens * float(np.log10(n + v + 1))).alias("base_score"), (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"))


def hash_key(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)
