"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks, at places that depend on content alone. Chunks
that occur more than once are encoded once and joined to the documents that hold them; what lies
between them is encoded in place. Pieces rarely meet between two words, so each join is repaired:
the words around it are encoded again, in a window that widens until its outer tokens agree with
the pieces' own.

Which chunks may be shared is first told by a bitmap of fixed size; a chunk that it passes wrongly
only takes the shared path. Defined results: null counts as empty (no ids, empty decoded text);
repeated rows get a row each; a null doc_id is a document; an empty table gives an empty one. Of
the input only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, in_sketch, materialize, pieces, same, sketch, text_buffer
from plumbline.llm.tokens import WordTokenizer, tokenizer

#: Mean distance of cuts in bytes (a power of two), and the least length of a chunk.
MEAN_CHUNK, LEAST_CHUNK = 1024, 256
_REACH = 16
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions whose hash over the 16 bytes before them ends in zeros and which start a character."""
    h = data.astype(np.uint32) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    step, m = 1, 0x01000193
    while step < _REACH:
        h[step:] = h[step:] + np.uint32(m) * h[:-step]
        m, step = m * m & 0xFFFFFFFF, step * 2
    h ^= h >> np.uint32(13)
    at = np.flatnonzero(h * np.uint32(0x9E3779B1) >> np.uint32(7) & np.uint32(MEAN_CHUNK - 1) == 0) + 1
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def chunks(data: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """For each document the bounds of its chunks, from its start to its end (the start alone if it is empty)."""
    cuts, out = cut_points(data).tolist(), []
    k = 0
    for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        bounds = [s]
        while k < len(cuts) and cuts[k] < e:
            if cuts[k] - bounds[-1] >= LEAST_CHUNK:
                bounds.append(cuts[k])
            k += 1
        out.append([*bounds, e] if e > s else bounds)
    return out


def chunk_key(raw: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(raw)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _ends(tok: WordTokenizer, raw: bytes) -> tuple[bytes, int, int]:
    """ids of a piece, and how many of their bytes its first and its last, perhaps cut, word take (-1: it is one word)."""
    ids = tok.encode([raw])[0]
    words = raw.split()
    if len(words) < 2 and not (raw[:1].isspace() or raw[-1:].isspace()):
        return ids, -1, -1
    head = 0 if raw[:1].isspace() else len(tok.encode([words[0]])[0])
    tail = 0 if raw[-1:].isspace() else len(tok.encode([words[-1]])[0])
    return ids, head, tail


def splice(tok: WordTokenizer, raw: bytes, bounds: list[int], parts: list[tuple[bytes, int, int]]) -> bytes:
    """ids of raw from those of its pieces between bounds, with every join repaired."""
    out: list[bytes] = []
    begin = 0  # where in raw the last piece's still open word begins
    for k, (ids, head, tail) in enumerate(parts):
        last = k == len(parts) - 1
        if head < 0:  # no end of a word in it: the open word goes on
            continue
        if k:
            first = next((i for i in range(bounds[k], bounds[k + 1]) if SPACE[raw[i]]), bounds[k + 1])
            out.append(_repaired(tok, raw, begin, first))
        else:
            head = 0
        out.append(ids[head : len(ids) - (0 if last else tail)])
        begin = bounds[k + 1]
        while begin > bounds[k] and not SPACE[raw[begin - 1]]:
            begin -= 1
    if parts and parts[-1][1] < 0:
        out.append(_repaired(tok, raw, begin, bounds[-1]))
    return b"".join(out)


def _repaired(tok: WordTokenizer, raw: bytes, start: int, end: int) -> bytes:
    """ids of raw[start:end], which a join cuts. The window widens by a word to each side until its outer tokens are those of the words alone."""
    while True:
        lo, hi = raw[max(0, start - 66) : start].split()[-1:], raw[end : end + 66].split()[:1]
        lo, hi = ([x.decode(errors="ignore").encode() for x in side] for side in (lo, hi))  # a long word may be cut here
        left, mid, right = tok.encode([b"".join(lo), raw[start:end], b"".join(hi)])
        if tok.encode([b" ".join([*lo, raw[start:end], *hi])])[0] == left + mid + right:
            return mid
        start, end = start - 66, end + 66
        while start > 0 and not SPACE[raw[start - 1]]:
            start -= 1
        while end < len(raw) and not SPACE[raw[end]]:
            end += 1
        start, end = max(0, start), min(len(raw), end)


def _digests(tok: WordTokenizer, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tok.decode(ids).encode()).hexdigest()


def _batch(docs: list, found: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def chunk_keys(docs: DataFrame) -> DataFrame:
    """h1, h2 of every chunk of every document."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data, off = text_buffer(b.column("text"))
            raw = data.tobytes()
            found = [chunk_key(raw[s:e]) for x in chunks(data, off) for s, e in zip(x, x[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.int64()) for i in (0, 1)], ["h1", "h2"])

    return docs.select("text").mapInArrow(keys, "h1 long, h2 long")


def _parted(docs: DataFrame, bits, path: str, shared: bool) -> DataFrame:
    """shared: doc_id, key, text and chunks of the documents with a chunk that may be shared. Else the results of the others."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, table = None if shared else tokenizer(path), bits.value
        for b in pieces(batches, 2 << 20):
            data, off = text_buffer(b.column("text"))
            raw, ids = data.tobytes(), b.column("doc_id").to_pylist()
            bounds = chunks(data, off)
            keys = [[chunk_key(raw[s:e]) for s, e in zip(x, x[1:], strict=False)] for x in bounds]
            flat = np.array([k[0] for x in keys for k in x], np.int64)
            hit, at = in_sketch(table, flat).tolist(), 0
            rows, own = [], []
            for i, (x, k) in enumerate(zip(bounds, keys, strict=True)):
                mine = hit[at : at + len(k)]
                at += len(k)
                if not any(mine):
                    own.append(i)
                elif shared:
                    text = raw[x[0] : x[-1]]
                    rows.append({"doc_id": ids[i], "key": xxhash.xxh3_64_intdigest(text) - (1 << 63), "text": text, "chunks": [{"seq": j, "h1": k[j][0], "h2": k[j][1], "s": x[j] - x[0], "e": x[j + 1] - x[0]} for j in range(len(k)) if mine[j]]})
            if shared:
                yield pa.RecordBatch.from_pylist(rows, _MARKED)
            else:
                yield _batch([ids[i] for i in own], [_digests(tok, x) for x in tok.encode([raw[bounds[i][0] : bounds[i][-1]] for i in own])])

    return docs.select("doc_id", "text").mapInArrow(part, "doc_id long, key long, text binary, chunks array<struct<seq:int,h1:long,h2:long,s:int,e:int>>" if shared else RESULT)


_CHUNK = pa.struct([("seq", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
_MARKED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("text", pa.binary()), ("chunks", pa.list_(_CHUNK))])


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = chunk_keys(docs).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    bits = docs.sparkSession.sparkContext.broadcast(sketch(repeated, "h1"))
    plain = _parted(docs, bits, tokenizer_path, shared=False)
    marked = materialize(_parted(docs, bits, tokenizer_path, shared=True), "chunked")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's text, once for each task at most."""
        seen: set[tuple[int, int]] = set()
        for b in pieces(batches):
            rows = []
            for text, x in zip(b.column("text").to_pylist(), b.column("chunks").to_pylist(), strict=True):
                for c in x:
                    if (c["h1"], c["h2"]) not in seen:
                        seen.add((c["h1"], c["h2"]))
                        rows.append({"h1": c["h1"], "h2": c["h2"], "chunk": text[c["s"] : c["e"]]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("chunk", pa.binary())]))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for b in pieces(batches, 2 << 20, "chunk"):
            found = [_ends(tok, x) for x in b.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), pa.array([x[0] for x in found], pa.binary()), *(pa.array([x[i] for x in found], pa.int32()) for i in (1, 2))], ["h1", "h2", "ids", "head", "tail"])

    texts = marked.select("text", "chunks").mapInArrow(first, "h1 long, h2 long, chunk binary").groupBy("h1", "h2").agg(F.first("chunk").alias("chunk"))
    ids = texts.mapInArrow(encoded, "h1 long, h2 long, ids binary, head int, tail int")
    uses = marked.select("doc_id", "key", F.inline("chunks")).join(ids, ["h1", "h2"])
    uses = uses.groupBy("doc_id", "key").agg(F.collect_set(F.struct("seq", "s", "e", "ids", "head", "tail")).alias("parts"))
    joined = marked.alias("a").join(uses.alias("b"), same("doc_id", "key")).select("a.doc_id", "text", "parts")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for b in pieces(batches, 2 << 20):
            texts, found = b.column("text").to_pylist(), []
            for raw, given in zip(texts, b.column("parts").to_pylist(), strict=True):
                bounds, parts = [0], []
                for p in sorted(given, key=lambda p: p["s"]):
                    if p["s"] > bounds[-1]:
                        parts.append(_ends(tok, raw[bounds[-1] : p["s"]]))
                        bounds.append(p["s"])
                    parts.append((p["ids"], p["head"], p["tail"]))
                    bounds.append(p["e"])
                if bounds[-1] < len(raw):
                    parts.append(_ends(tok, raw[bounds[-1] :]))
                    bounds.append(len(raw))
                found.append(_digests(tok, splice(tok, raw, bounds, parts)))
            yield _batch(b.column("doc_id").to_pylist(), found)

    return plain.unionByName(joined.mapInArrow(assemble, RESULT))
