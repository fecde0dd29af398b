"""Benchmark decontamination: CGK walks and bit-sampling LSH for candidates, exact edit distance for the verdict.

Texts and items are compared in lower case with white space as single blanks. The random walk of
Chakraborty, Goldenberg and Koucky turns edit distance into Hamming distance: two strings that
differ by few edits walk to much the same bytes. An item is walked from each of its bytes, a text from
every STRIDE-th, so wherever a text holds an item, several of its starts face the item's own byte for
byte. Two walks meet if in one of the draws all of its sampled steps agree; a draw is a pair of SETS by SETS
sampled sets of steps, whose hashes are worked out once. WALKS walks are tried, as one that an edit throws off may stay off. The item-sized window that a meeting lines up, as much
longer on both sides as the edits allowed, is a candidate.

Candidates are freed of those that can't be (too few of the item's 4-byte runs are left for the edits
allowed) and verified by exact edit distance: at most floor((1 - similar) * item bytes) to some
substring of the text. What the walks miss is measured in the tests: at most a few per cent at the
limit itself. Nothing else is left out: every window that a meeting lines up is looked at.

Items under LEAST bytes have no room for a walk that starts anywhere in the first STRIDE bytes. They are
searched by counted runs instead (see Parts), which lose no match.

Items are taken in blocks of BLOCK_BYTES at most, one pass over the documents a block. A worker builds a
block's index from its texts, some 1,500 bytes for each byte of the items; only the texts are broadcast.

Defined results: null and empty texts and items match nothing; items shorter than SEED bytes match
as they stand only; an item or text repeated gives its rows again; rows with a null doc_id or
item_id are reported with null; empty tables give an empty one. Clashing columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, SPACE, pieces, text_buffer

SEED, LEAST = 12, 64
#: Longest part of an item (bits of a word), diagonals whose windows are compared as one, and positions of a text looked up at a time.
PART, GROUP, STEP = 63, 16, 1 << 15
WIDTH = STEP + 8 * (PART + 1)
#: Bytes between a text's starts, steps of a walk, walks, sets of either half of a draw and sampled steps of each half.
STRIDE, STEPS, WALKS, SETS, SAMPLED = 32, 56, 8, 5, (6, 7)
#: Bits of the hash of an item's 4-byte run.
_RUN = 14
#: Bits of the table that tells early which of a draw's hashes no item has.
_EARLY = 20
_BIT = (1 << np.arange(8)).astype(np.uint8)
BLOCK_BYTES = 64 << 10
_RNG = np.random.default_rng(618)
_MOVES = _RNG.integers(0, 2, (WALKS, STEPS, 256), np.int64)
#: Of each walk the sampled sets of both halves of its draws; the halves share no step.
_PLACES = [[[_RNG.choice(steps, n, replace=False) for _ in range(SETS)] for steps, n in zip(np.split(_RNG.permutation(STEPS), 2), SAMPLED, strict=True)] for _ in range(WALKS)]
LEAK = "doc_id long, item_id long, start long, edit_distance int"
FOUND = "digest long, " + LEAK

def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, runs of white space as one blank."""
    low = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    white = SPACE[low]
    keep = ~white
    keep[1:] |= white[1:] & ~white[:-1]
    keep[:1] = True
    starts = off[:-1]
    keep[starts[starts < len(low)]] = True
    out = np.where(white, np.uint8(32), low)[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[off]


def edit_distance_within(item: bytes, text: bytes, most: int) -> int:
    """Least edit distance of item to any substring of text (Myers' bit vectors); some number above `most` if it is above."""
    return _scan(item, text, most, -1)[0]


def last_start(item: bytes, text: bytes, n: int) -> int:
    """The last place of text where a substring within n edits of the item begins; there is one. Read backwards, it is where the first ends."""
    return len(text) - _scan(item[::-1], text[::-1], n, n)[1]


def _scan(item: bytes, text: bytes, most: int, stop: int) -> tuple[int, int]:
    """(least distance, bytes read): up to the end, to where it can't come down to `most` any more, or to where it is `stop`."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, now, best, read = full, 0, m, m, 0
    for c in text:
        if now - (len(text) - read) > most and best > most:
            break
        read += 1
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        now += bool(ph & top) - bool(mh & top)
        best = min(best, now)
        if now <= stop:
            break
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return best, read


def within(part: np.ndarray, size: np.ndarray, most: np.ndarray, peq: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of parts of PART bytes at most, by their row in peq: whether a substring of the window is within `most` edits (Myers, all side by side)."""
    one = np.uint64(1)
    pv, mv = np.full(len(part), ~np.uint64(0)), np.zeros(len(part), np.uint64)
    top, now = (size - 1).astype(np.uint64), size.astype(np.int64)
    best, flat, base = now.copy(), peq.ravel(), part.astype(np.int64) * 256
    for c in windows.T:
        e = flat[base + c]
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv), pv & xh
        now += (ph >> top & one).astype(np.int64) - (mh >> top & one).astype(np.int64)
        np.minimum(best, now, out=best)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    return best <= most


def least_distances(texts: list[bytes], which: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each window [a, b) of data the least edit distance of texts[which] to any substring of it: Myers' bit vectors, windows side by side, several words an item."""
    best = np.zeros(len(which), np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    words = -(-size // 64)
    order = np.lexsort((b - a, words[which]))
    for at in range(0, len(order), 1024):
        part = order[at : at + 1024]
        for n in np.unique(words[which[part]]).tolist():
            own = part[words[which[part]] == n]
            if len(own) < 100:  # too few for arrays to pay
                best[own] = [edit_distance_within(texts[which[i]], data[a[i] : b[i]].tobytes(), int(size[which[i]])) for i in own.tolist()]
                continue
            kinds, row = np.unique(which[own], return_inverse=True)
            eq = np.zeros((n, len(kinds), 256), np.uint64)
            for i, k in enumerate(kinds.tolist()):
                t = np.frombuffer(texts[k], np.uint8)
                place = np.arange(len(t), dtype=np.uint64)
                np.bitwise_or.at(eq, ((place >> np.uint64(6)).astype(np.int64), i, t), np.uint64(1) << (place & np.uint64(63)))
            best[own] = _side_by_side(eq.reshape(n, -1), row.astype(np.int64) * 256, size[which[own]], data, a[own], b[own])
    return best


def _side_by_side(eq: np.ndarray, base: np.ndarray, size: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    one, n = np.uint64(1), len(eq)
    pv, mv = np.full((n, len(a)), ~np.uint64(0)), np.zeros((n, len(a)), np.uint64)
    top = ((size - 1) & 63).astype(np.uint64)
    now, length = size.copy(), int((b - a).max()) if len(a) else 0
    best = now.copy()
    for j in range(length):
        at = a + j
        c = np.where(at < b, data.take(at, mode="clip"), np.uint8(0)).astype(np.int64) + base  # no item holds a zero byte: past its end a window only gets worse
        up = down = np.uint64(0)
        for w in range(n):
            e, p, m = eq[w].take(c), pv[w], mv[w]
            xv = e | m
            e |= down
            xh = (((e & p) + p) ^ p) | e
            ph, mh = m | ~(xh | p), p & xh
            last = top if w == n - 1 else np.uint64(63)
            up_next, down_next = ph >> last & one, mh >> last & one
            ph, mh = ph << one | up, mh << one | down
            pv[w], mv[w] = mh | ~(xv | ph), ph & xv
            up, down = up_next, down_next
        now += up.astype(np.int64)
        now -= down.astype(np.int64)
        np.minimum(best, now, out=best)
    return best


class Parts:
    """Items cut into parts of PART bytes at most, one of which a match holds with its share of the edits; an index of their 4-byte runs.

    A part with k edits keeps size - 3 - 4k of its runs, on k + 1 neighbouring diagonals of text
    and part: where sorted diagonals have as many so close together, and no match has fewer, the part
    is compared with the text there.
    """

    def __init__(self, texts: list[bytes], limit: list[int], which: list[int]):
        rows = []
        for k in which:
            n = len(texts[k])
            cuts = np.linspace(0, n, -(-n // PART) + 1).astype(int).tolist()
            rows += [(k, a, b - a, limit[k] * (b - a) // n) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.item, self.at, self.size, self.most = np.array(rows, np.int64).reshape(-1, 4).T
        self.texts = [texts[k][a : a + n] for k, a, n, _ in rows]
        self.least = self.size - 3 - 4 * self.most
        grams = [_grams(np.frombuffer(t, np.uint8)) for t in self.texts]
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
        order = np.argsort(g, kind="stable")
        self.start = np.searchsorted(g[order], np.arange((1 << 20) + 1)).astype(np.int32)
        part = np.repeat(np.arange(len(rows)), [len(x) for x in grams])
        place = np.concatenate([np.arange(len(x)) for x in grams]) if grams else np.zeros(0, np.int64)
        # of each run: where the diagonals of its part begin, which leaves gaps between those of two parts
        self.key = (part * WIDTH + PART - place)[order].astype(np.int32 if (len(rows) + 1) * WIDTH < 1 << 31 else np.int64)

    def candidates(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last start of the item): every match in the buffer has its start in one of these, give or take the item's edits."""
        g = _grams(data)
        step = min(STEP, max(1 << 10, (1 << 31) // max(1, len(self.key))))
        for s in range(0, len(g), step):
            # the blocks overlap by what a part's match may take
            h = g[s : s + step + 4 * PART]
            first = self.start[h]
            n = self.start[h + 1] - first
            if not n.any():
                continue
            key = self.key[np.repeat((first - np.cumsum(n, dtype=np.int32) + n), n) + np.arange(n.sum(), dtype=np.int32)]
            key += np.repeat(np.arange(len(h), dtype=np.int32), n)
            key.sort()
            size = np.diff(np.searchsorted(key, np.arange(len(self.texts) + 1, dtype=key.dtype) * key.dtype.type(WIDTH)))
            last = np.arange(len(key), dtype=np.int32) + np.repeat((self.least - 1).astype(np.int32), size)
            near = key[np.minimum(last, len(key) - 1)] - key <= np.repeat(self.most.astype(np.int32), size)
            key = np.unique(key[near & (last < len(key))].astype(np.int64) // GROUP * GROUP)
            for at in range(0, len(key), 1 << 15):
                p, d = key[at : at + (1 << 15)] // WIDTH, key[at : at + (1 << 15)] % WIDTH
                lo = s + d - PART - self.most[p]
                kinds, row = np.unique(p, return_inverse=True)
                peq = np.zeros((len(kinds), 256), np.uint64)
                for i, k in enumerate(kinds.tolist()):
                    t = np.frombuffer(self.texts[k], np.uint8)
                    np.bitwise_or.at(peq[i], t, np.uint64(1) << np.arange(len(t), dtype=np.uint64))
                length = int((GROUP + self.size + 3 * self.most)[kinds].max())
                windows = data[np.clip(lo[:, None] + np.arange(length), 0, len(data) - 1)]
                ok = within(row, self.size[p], self.most[p], peq, windows)
                first = lo[ok] - self.at[p[ok]]
                yield from zip(self.item[p[ok]].tolist(), first.tolist(), (first + length).tolist(), strict=True)


def _grams(data: np.ndarray) -> np.ndarray:
    """A 20-bit hash of the 4 bytes from each position on."""
    if len(data) < 4:
        return np.zeros(0, np.int64)
    d = data.astype(np.uint32)
    return ((d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24) * np.uint32(0x9E3779B1) >> np.uint32(12)).astype(np.int64)


def draws(data: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each draw of each walk the hash of the sampled steps of the walks from starts."""
    padded = np.concatenate([data, np.zeros(STEPS + 1, np.uint8)])
    rows = np.empty((STEPS, len(starts)), np.uint32)
    c = np.empty(len(starts), np.uint8)
    for moves, places in zip(_MOVES, _PLACES, strict=True):
        at = starts.astype(np.int64)
        for j in range(STEPS):
            padded.take(at, out=c, mode="clip")
            rows[j] = c
            at += moves[j].take(c, mode="clip")
        left, right = ([_folded(rows, own, n) for n, own in enumerate(sets)] for sets in places)
        for x in left:
            for y in right:
                h = x ^ y
                h *= np.uint32(0x85EBCA6B)
                yield h


def _folded(rows: np.ndarray, own: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(rows.shape[1], seed + 1, np.uint32)
    for k in own:
        h ^= rows[k]
        h *= np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(13)
    return h


class Index:
    """The draws of walks from every byte of items: for each draw the sorted hashes and where in the items they start."""

    def __init__(self, texts: list[bytes]):
        size = [len(t) for t in texts]
        data, self.begin = np.frombuffer(b"".join(t + bytes(STEPS) for t in texts), np.uint8), np.cumsum([0, *[n + STEPS for n in size]])
        starts = np.concatenate([np.arange(b, b + max(1, n - STEPS // 2 + 1)) for b, n in zip(self.begin.tolist(), size, strict=False)])
        kind = np.uint16 if len(data) < 1 << 16 else np.uint32
        self.hashes, self.starts, self.early = [], [], []
        for h in draws(data, starts):
            order = np.argsort(h, kind="stable")
            self.hashes.append(h[order])
            self.starts.append(starts[order].astype(kind))
            early = np.zeros(1 << (_EARLY - 3), np.uint8)
            bit = h >> np.uint32(32 - _EARLY)
            np.bitwise_or.at(early, bit >> np.uint32(3), _BIT[bit & np.uint32(7)])
            self.early.append(early)

    def meetings(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start in the buffer, item, start in the item) of each pair of walks that meet, each once."""
        pairs = [np.zeros(0, np.int64)]
        for h, known, at, early in zip(draws(data, starts), self.hashes, self.starts, self.early, strict=True):
            bit = h >> np.uint32(32 - _EARLY)
            maybe = np.flatnonzero(early.take(bit >> np.uint32(3), mode="clip") & _BIT.take(bit & np.uint32(7), mode="clip"))
            asked = h[maybe]
            lo = np.searchsorted(known, asked, "left")
            there = known.take(lo, mode="clip") == asked
            maybe, lo = maybe[there], lo[there]
            n = np.searchsorted(known, asked[there], "right") - lo
            which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs.append(np.repeat(maybe, n) << 32 | at[which].astype(np.int64))
        both = np.sort(np.concatenate(pairs))
        both = both[np.diff(both, prepend=-1) != 0]
        place = both & 0xFFFFFFFF
        item = np.searchsorted(self.begin, place, "right") - 1
        return starts[both >> 32], item, place - self.begin[item]


class Items:
    """Benchmark items as they are compared, and what each worker builds to find them."""

    def __init__(self, ids: list, texts: list[bytes], similar: float):
        data, off = normalised(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        raw = data.tobytes()
        kept = [(i, t) for i, s, e in zip(ids, off[:-1].tolist(), off[1:].tolist(), strict=True) if (t := raw[s:e].strip())]
        self.ids, self.texts = [x[0] for x in kept], [x[1] for x in kept]
        self.limit = [int((1 - similar) * len(t) + 1e-9) for t in self.texts]
        self.walked = [k for k, t in enumerate(self.texts) if len(t) >= LEAST]
        self.short = [k for k, t in enumerate(self.texts) if len(t) < SEED]
        self.counted = [k for k, t in enumerate(self.texts) if SEED <= len(t) < LEAST]
        self.index: Index | None = None

    def _build(self) -> None:
        self.index = Index([self.texts[k] for k in self.walked]) if self.walked else None
        self.parts = Parts(self.texts, self.limit, self.counted)
        # Those whose parts need not keep a run are compared with every text.
        self.loose = sorted(set(self.parts.item[self.parts.least < 1].tolist()))
        if self.loose:
            self.parts = Parts(self.texts, self.limit, sorted(set(self.counted) - set(self.loose)))
        # Of each walked item: its 4-byte runs by _RUN bits of their hash, how many of them are alike, and where in the item they stand.
        runs = [_grams(np.frombuffer(self.texts[k], np.uint8)) >> 20 - _RUN | i << _RUN for i, k in enumerate(self.walked)]
        flat, place = (np.concatenate(x) if self.walked else np.zeros(0, np.int64) for x in (runs, [np.arange(len(x)) for x in runs]))
        self.longest = max([len(x) for x in runs], default=0)
        order = np.argsort(flat, kind="stable")
        kinds, begin, self.alike = np.unique(flat[order], return_index=True, return_counts=True)
        self.places, self.holds, self.begin = place[order], np.zeros(len(self.walked) << _RUN, bool), np.zeros(len(self.walked) << _RUN, np.int32)
        self.holds[kinds], self.begin[kinds], self.kind_begin = True, np.arange(len(kinds)), begin
        self.built = True

    built = False

    def leaks(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, start, edit distance) for the texts of a buffer; the best window of each pair."""
        if not self.built:
            self._build()
        data, off = normalised(data, off)
        raw, best = data.tobytes(), {}
        windows = [*self._walked(data, off), *self._counted(data, off)]
        docs, items, lo, hi = np.array(windows, np.int64).reshape(-1, 4).T
        for doc, k, a, b, n in zip(docs.tolist(), items.tolist(), lo.tolist(), hi.tolist(), least_distances(self.texts, items, data, lo, hi).tolist(), strict=True):
            item = self.texts[k]
            if n > self.limit[k] or n >= best.get((doc, k), (1 << 30, 0))[0]:
                continue
            if not n:
                best[doc, k] = 0, raw.find(item, a, b) - int(off[doc])
                continue
            best[doc, k] = n, a + last_start(item, raw[a:b], n) - int(off[doc])
        for k in self.short:
            for doc, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                if (at := raw.find(self.texts[k], s, e)) >= 0:
                    best[doc, k] = 0, at - s
        return [(doc, k, start, found) for (doc, k), (found, start) in sorted(best.items())]

    def _walked(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, from, to) of the windows that meetings line up and that keep enough of the item's runs; overlapping ones as one."""
        if self.index is None or not len(data):
            return []
        # Each text has its own starts, so that what is found doesn't depend on the texts beside it.
        n = -(-np.diff(off) // STRIDE)
        starts = np.repeat(off[:-1] - (np.cumsum(n) - n) * STRIDE, n) + np.arange(n.sum()) * STRIDE
        p, item, o = self.index.meetings(data, starts)
        doc = np.searchsorted(off, p, "right") - 1
        size, limit = (np.array([f(k) for k in self.walked], np.int64) for f in (lambda k: len(self.texts[k]), lambda k: self.limit[k]))
        # Windows that begin within GROUP bytes of each other are looked at as one that spans them all.
        cell = (p - o) // GROUP
        order = np.lexsort((cell, item, doc))
        doc, item, cell = doc[order], item[order], cell[order]
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(cell) != 0)
        doc, item, first = doc[new], item[new], cell[new] * GROUP
        a, b = np.maximum(first - limit[item], off[doc]), np.minimum(first + GROUP + size[item] + limit[item], off[doc + 1])
        keep = self._keeps(data, item, first + GROUP // 2, a, b, size[item] - 3 - 4 * limit[item], limit[item] + GROUP // 2)
        out: list[tuple[int, int, int, int]] = []
        for d, i, lo, hi in zip(doc[keep].tolist(), item[keep].tolist(), a[keep].tolist(), b[keep].tolist(), strict=True):
            k = self.walked[i]
            if out and out[-1][:2] == (d, k) and lo <= out[-1][3]:
                out[-1] = d, k, out[-1][2], max(hi, out[-1][3])
            else:
                out.append((d, k, lo, hi))
        return out

    def _keeps(self, data: np.ndarray, item: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether windows [a, b) of the buffer hold at least so many of the item's 4-byte runs as any match must, since an edit breaks four at most.

        At first runs count wherever they stand, then each of the item's own once and only within as many diagonals of the meeting as there may be edits.
        """
        g, keep = _grams(data) >> 20 - _RUN, np.zeros(len(a), bool)
        n = np.maximum(np.minimum(b - 3, len(g)) - a, 0)
        ends, at = np.cumsum(n), 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), "right")))
            m = n[at:to]
            where = np.repeat(a[at:to] - np.cumsum(m) + m, m) + np.arange(m.sum())
            key = np.repeat(item[at:to] << _RUN, m)
            key |= g.take(where, mode="clip")
            hit = np.flatnonzero(self.holds.take(key, mode="clip"))
            own = np.searchsorted(np.cumsum(m), hit, "right")
            many = np.bincount(own, minlength=to - at) >= least[at:to]
            own, hit = own[many[own]], hit[many[own]]
            where, kind = where[hit], self.begin.take(key[hit])
            m = self.alike[kind]
            place = self.places[np.repeat(self.kind_begin[kind] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            own, where = np.repeat(own, m), np.repeat(where, m)
            near = np.abs(where - place - first[at + own]) <= limit[at + own]
            seen = np.zeros((to - at, self.longest), bool)
            seen[own[near], place[near]] = True
            keep[at:to] = seen.sum(1) >= least[at:to]
            at = to
        return keep

    def _counted(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The same for items that are searched by counted runs."""
        found = set()
        for k, first, last in self.parts.candidates(data) if self.parts.texts else ():
            a, b = max(0, first - self.limit[k]), min(len(data), last + len(self.texts[k]) + self.limit[k])
            docs = range(int(np.searchsorted(off, a, "right")) - 1, int(np.searchsorted(off, b, "left")))
            found |= {(doc, k, max(a, int(off[doc])), min(b, int(off[doc + 1]))) for doc in docs}
        found |= {(doc, k, int(off[doc]), int(off[doc + 1])) for k in self.loose for doc in range(len(off) - 1)}
        return sorted(found)


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = 0.8) -> DataFrame:
    """doc_id, item_id, start (in the normalised text) and edit_distance: a row for each document and item it holds."""
    return found_in(docs, benchmark, similar).drop("digest")


def found_in(docs: DataFrame, benchmark: DataFrame, similar: float = 0.8) -> DataFrame:
    """The rows of `leaks` with the xxhash64 of the document's text, which tells texts under one doc_id apart."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and text <> ''")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    blocks = -(-size // BLOCK_BYTES)
    out = spark.createDataFrame([], FOUND)
    for block in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        items = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"].encode() for r in rows], similar))

        def find(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            of = items.value
            for b in pieces(batches, 6 << 20):
                ids, digests = b.column("doc_id").to_pylist(), b.column("digest").to_pylist()
                found = of.leaks(*text_buffer(b.column("text")))
                cols = [[digests[x[0]] for x in found], [ids[x[0]] for x in found], [of.ids[x[1]] for x in found], [x[2] for x in found], [x[3] for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["digest", "doc_id", "item_id", "start", "edit_distance"])

        out = out.unionByName(docs.mapInArrow(find, FOUND)) if block else docs.mapInArrow(find, FOUND)
    return out
