"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled documents: one on windows of
ordinary text, one on the same followed by what sets toxic text apart. A text's windows are its
words; each is compressed under both. What the toxic dictionary saves, against what there was to
save, is the window's distance; a window counts if it passes a threshold chosen on the sample, and
the score is the share of toxic documents among those with as many such windows, made monotone.

zstandard's matches cost about three bytes, more than short words can save, so windows and
dictionaries are written in a wide form: each run of three bytes as four fixed, unrelated ones.

Defined results: null and empty texts and texts without words have no such window, and their score;
labels that are null or neither 0 nor 1 aren't used; with labels of one class only, or none, every
score is that class's share (0 without labels); repeated rows get a row each; an empty table gives
an empty one. Of the input only doc_id and text are read; doc_id only splits the labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, materialize, mix, pieces, text_buffer

#: Bounds of what is fitted on: labelled documents of each class, windows of ordinary text, toxic words.
SAMPLE_DOCS, SAMPLE_WINDOWS, TOXIC_WORDS = 2000, 20_000, 256
#: Least log-likelihood ratio of a word of the toxic dictionary, and how much rarer it is in ordinary documents.
LEAST_RATIO, RARER = 20.0, 10
#: Dictionary bytes before they are widened.
ORDINARY_BYTES = 8192
#: Least bytes that a window saves, and what a window takes that is one match.
LEAST_SAVING, FRAME = 6, 13
_EDGE = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_MEMO_WORDS = 400_000
_memo: dict = {}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _wide(raw: bytes) -> bytes:
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    return mix((x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]) + np.uint64(1 << 40)).astype("<u4").tobytes()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    wide = _wide(content)
    d = zstandard.ZstdCompressionDict(wide, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(3, source_size=100, dict_size=len(wide), strategy=zstandard.STRATEGY_BTOPT, min_match=4, target_length=32, search_log=5, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


class Distances:
    """Of each word: the share of what it costs under the ordinary dictionary that the toxic one saves."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.of = _compressor(ordinary), _compressor(ordinary + toxic), {}
        self.runs = {toxic[i : i + 4] for i in range(len(toxic) - 3)}

    def __call__(self, words: list[bytes]) -> list[float]:
        new = {w for w in words if w not in self.of}  # a set less a dictionary's keys would walk all of them
        if len(self.of) + len(new) > _MEMO_WORDS:
            self.of.clear()
            new = set(words)
        for w in new:
            raw = b" " + w + b" "
            if not any(raw[i : i + 4] in self.runs for i in range(len(raw) - 3)):
                self.of[w] = 0.0  # no two units in a row in common: what sets the toxic dictionary apart can't save LEAST_SAVING
                continue
            window = _wide(raw)
            a, b = len(self.ordinary.compress(window)), len(self.toxic.compress(window))
            self.of[w] = (a - b) / max(1, a - FRAME) if a - b >= LEAST_SAVING else 0.0
        return list(map(self.of.__getitem__, words))


def distances(ordinary: bytes, toxic: bytes) -> Distances:
    """One for each Python worker and pair of dictionaries."""
    if _memo.get("of") != (ordinary, toxic):
        _memo.update(of=(ordinary, toxic), it=Distances(ordinary, toxic))
    return _memo["it"]


def windows(raw: bytes) -> list[bytes]:
    """A text's words in lower case, without ASCII punctuation around them."""
    return [x for w in raw.translate(LOWER).split() if (x := w.strip(_EDGE))]


def _rows(b: pa.RecordBatch) -> list[bytes]:
    data, off = text_buffer(b.column("text"))
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def train(sample: DataFrame) -> tuple[bytes, bytes]:
    """Dictionary contents (ordinary, what toxic text adds) from sample: text, toxic (0 or 1)."""

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = [sorted({w.decode(errors="replace") for w in windows(t) if len(w) <= 64}) for t in _rows(b)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(words, pa.list_(pa.string()))], ["toxic", "words"])

    n = dict(sample.groupBy("toxic").count().collect())
    nt, no = n.get(1, 0), n.get(0, 0)
    if not nt or not no:
        return b"", b""
    df = sample.select("toxic", "text").mapInArrow(vocabulary, "toxic int, words array<string>").select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    share = (F.col("t") + F.col("o")) / (nt + no)

    def part(x: Column, mean: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / mean)).otherwise(0.0)

    t, o = F.col("t"), F.col("o")
    ratio = 2 * (part(t, nt * share) + part(o, no * share) + part(nt - t, nt * (1 - share)) + part(no - o, no * (1 - share)))
    typical = df.where((t >= 3) & (share < 1) & (RARER * o / no <= t / nt)).withColumn("g", ratio).where(F.col("g") >= LEAST_RATIO)
    picked = [r["w"].encode() for r in typical.orderBy(F.desc("g"), "w").limit(TOXIC_WORDS).collect()]

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for t in _rows(b):
                w = t.translate(LOWER).split()
                out += [b" ".join(w[i : i + 3])[:200] for i in range(0, len(w), 3)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["w"])

    some = sample.where("toxic = 0").select("text").mapInArrow(triples, "w binary").orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WINDOWS)
    texts = [bytes(r["w"]) for r in some.collect()]
    try:
        ordinary = zstandard.train_dictionary(2 * ORDINARY_BYTES, texts, d=6, k=32).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer
        ordinary = b" ".join(texts)
    return ordinary[-ORDINARY_BYTES:], b" " + b" ".join(picked) + b" "


def _hits(docs: DataFrame, ordinary: bytes, toxic: bytes, cuts: list[float], keep: list[str]) -> DataFrame:
    """keep and `hits`: for each cut the number of windows at or above it."""
    kinds = dict(docs.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = distances(ordinary, toxic)
        for b in pieces(batches):
            found = []
            for t in _rows(b):
                x = np.array(of(windows(t)), np.float64)
                found.append([int((x >= c).sum()) for c in cuts])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(found, pa.list_(pa.int64()))], [*keep, "hits"])

    return docs.select(*keep, "text").mapInArrow(count, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", hits array<long>")


CUTS = [0.5, 0.6, 0.7, 0.8, 0.9]


def toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. labels: doc_id, toxic."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).distinct()
    totals = dict(known.groupBy("toxic").count().collect())
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for t in (0, 1)]
    sample = materialize(docs.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id"), "labelled")
    ordinary, toxic = train(sample)
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    cut, table = CUTS[0], [prior]
    if toxic:
        seen = _hits(sample, ordinary, toxic, CUTS, ["toxic"]).groupBy("toxic", F.transform("hits", lambda x: F.least(x, F.lit(8))).alias("hits")).count().collect()
        drawn = {t: sum(r["count"] for r in seen if r["toxic"] == t) for t in (0, 1)}
        weight = {t: totals[t] / max(1, drawn[t]) for t in (0, 1)}
        best = -math.inf
        for i, c in enumerate(CUTS):
            counts = np.zeros((2, 9))
            for r in seen:
                counts[r["toxic"], r["hits"][i]] += r["count"] * weight[r["toxic"]]
            shares = _monotone(counts, prior)
            kinds = counts.sum(0)
            gain = float((counts[1] * np.log(shares) + counts[0] * np.log(1 - shares)).sum()) / max(1.0, kinds.sum())
            if gain > best:
                best, cut, table = gain, c, shares.tolist()

    scores = F.array(*[F.lit(float(x)) for x in table])
    out = _hits(docs, ordinary, toxic or b" ", [cut], ["doc_id"]).withColumn("score", F.get(scores, F.least(F.get("hits", 0), F.lit(len(table) - 1))))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _monotone(counts: np.ndarray, prior: float) -> np.ndarray:
    """Share of toxic documents for each number of windows, not falling; two documents of the prior smooth it."""
    blocks: list[list[float]] = []
    for o, t in counts.T:
        blocks.append([t + 2 * prior * (o + t > 0), o + t + 2 * (o + t > 0), 1])
        while len(blocks) > 1 and (not blocks[-1][1] or blocks[-2][1] and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    shares = np.concatenate([[b[0] / b[1] if b[1] else prior] * int(b[2]) for b in blocks])
    return np.clip(shares, 1e-4, 1 - 1e-4)
