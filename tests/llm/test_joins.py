"""Source divergence, clustering, the n-gram join and the near-dedup stage against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import clustering, divergence, near_dup, ngram_join
from plumbline.llm import queries as corpus_queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_centroid_clusters"])
def test_oracle(spark, name):
    assert compare(spark, connect(SF), SF, corpus_queries.QUERIES[name], corpus_queries.SQL[name]).startswith("ok")


# ---- source divergence


def brute_divergence(rows):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOW))) for text, lang, source in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        n[lang, source].update(words)
    kept = {lang: [t for t, c in df[lang].items() if c >= 10] for lang, _, _ in docs}
    out = []

    def p(count, total, v):
        return 1 + 1_000_000_000 * (count + 2) // (total + 2 * v)

    def apart(a, b):
        return (a - b) ** 2 // (a + b)

    total = {g: sum(n[g][t] for t in kept[g[0]]) for g in n}
    for lang, source in n:
        v = len(kept[lang])
        of = {g: {t: p(n[g][t], total[g], v) for t in kept[lang]} for g in n if g[0] == lang}
        mine = of[lang, source]
        pairs = [(g[1], sum(apart(mine[t], q[t]) for t in kept[lang])) for g, q in of.items() if g[1] != source]
        everywhere = {t: p(sum(n[g][t] for g in of), sum(total[g] for g in of), v) for t in kept[lang]}
        terms = [(t, apart(mine[t], everywhere[t])) for t in kept[lang] if n[lang, source][t] and mine[t] > everywhere[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < 10]
    return sorted(out)


def divergence_rows(n=400):
    rng = random.Random(7)
    words = ["alpha", "Beta", "GAMMA", "ÉTÉ", "été", "naïve", "x1y", "don't", "a_b", "Ω", "é", "longer-word", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, ""])) for _ in range(n)]
    rows += [("same words here", "en", "s1")] * 30  # repeated rows, a hot group
    return rows + [(None, "en", "silent"), ("", "fr", "one"), ("12 34 !!", "fr", "two"), (("huge " * 50_000) + "Tail", "en", "s2"), (None, None, None)]


def test_divergence(spark, monkeypatch):
    rows = divergence_rows()
    d = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("rank", F.lit(3))
    found = lambda: sorted(tuple(r) for r in divergence.divergence(d).select("lang", "source", "part", "item", "value", "rank").collect())
    want = brute_divergence(rows)
    assert found() == want and {r[0] for r in want} == {"", "en", "de", "fr"}
    # Many spilled blocks and short pieces of text give the same.
    whole, monkeypatched = divergence.runs, lambda docs: whole(docs, most=20)
    monkeypatch.setattr(divergence, "runs", monkeypatched)
    assert found() == want
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_terms_of_long_texts():
    text = ("Ab1cD é " * 3000).encode()
    assert [w for part in divergence.terms_of(text, piece=100) for w in part] == [w.encode() for w in TERM.findall(text.decode().translate(LOW))]


# ---- clustering


def brute_clusters(rows, k, rounds, size, seed=1):
    vec = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(vec, key=mark)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c)) for _, v in vec]

    for _ in range(rounds):
        of = [j for _, j in assign()]
        for j in range(len(c)):
            if mine := [v for (_, v), x in zip(vec, of, strict=True) if x == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    got = assign()
    total, per = sum(d for d, _ in got), Counter()
    for d, j in got:
        per[j] += d
    return Counter((i, j, d, per[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(vec, got, strict=True))


@pytest.mark.parametrize("size,k,n", [(64, 16, 300), (4, 16, 500), (4, 16, 9), (3, 1, 40)])
def test_clusters(spark, size, k, n):
    rng = random.Random(size * n)
    step = 0.5 if size < 64 else 0.01  # few distinct values: equal vectors, equal centroids, ties
    rows = [(i, [round(rng.gauss(0, 1) / step) * step for _ in range(size)]) for i in range(n)]
    rows += [(None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (n + 1, None), (n + 2, [1.0] * (size + 1)), (n + 3, [None] * size), (n + 4, [float("nan")] * size), (n + 5, [float("inf")] * size), (n + 6, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("x", F.lit(1)).repartition(5)
    got = Counter(tuple(r) for r in clustering.cluster(d, k, 3, size=size).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == brute_clusters(rows, k, 3, size)


def test_shallot_search_is_exact_and_looks_at_few():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (16, 8)).round().astype(np.int64)
    x = (centres[rng.integers(0, 16, 4000)] + rng.normal(0, 3, (4000, 8))).round().astype(np.int64)
    near, second, above, below = np.zeros(4000, int), np.ones(4000, int), np.full(4000, np.inf), np.zeros(4000)
    near, second, dist, above, below, n = clustering.search(x, near, second, above, below, clustering.Centroids(centres))
    exact = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (near == exact.argmin(1)).all() and (dist == exact.min(1)).all() and n < 0.8 * exact.size
    after = centres + rng.integers(-2, 3, centres.shape)
    own, others = clustering.moved(centres, after)
    near, second, dist, _, _, n = clustering.search(x, near, second, above + own[near], np.maximum(below - others[near], 0), clustering.Centroids(after))
    exact = ((x[:, None, :] - after[None]) ** 2).sum(2)
    assert (near == exact.argmin(1)).all() and (dist == exact.min(1)).all() and n < 0.3 * exact.size


def test_clusters_of_nothing_and_of_the_too_large(spark):
    assert clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="absolute value"):
        clustering.cluster(spark.createDataFrame([(1, [3e30] * 64)], "vec_id long, embedding array<float>"))


# ---- the n-gram join and near-duplicates


def brute_components(rows, k, similar):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), [find(i) for i in range(len(rows))]


def near_rows():
    """Copies, chains of near copies, a null id that bridges two documents, unlike texts under one id, sets under the threshold."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [word() for _ in range(120)]
    rows = [(None, None), (None, ""), (1, ""), (2, None), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (6, "word " * 20_000)]
    for i in range(60):  # a group of near copies whose links lie about the threshold
        w = list(base)
        for j in rng.sample(range(120), rng.randint(0, 3)):
            w[j] = word()
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i % 4, " ".join(base)) for i in range(12)]  # repeated rows
    chain = [word() for _ in range(100)]
    for i in range(6):
        chain = chain[3:] + [word() for _ in range(3)]
        rows.append((None if i == 2 else 300 + i, " ".join(chain)))
    rows += [(7, " ".join(word() for _ in range(50))), (7, " ".join(word() for _ in range(50)))]
    one = rows[-1][1]
    rows.append((400, one + " more"))
    return rows


@pytest.mark.parametrize("op,k,similar", [("join", 4, 85), ("join", 2, 50), ("minhash", 5, 80)])
def test_near_documents(spark, op, k, similar):
    rows = near_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("component_id", F.lit(1)).repartition(3)
    f = ngram_join.similar_documents if op == "join" else near_dup.near_duplicates
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in f(d, k, similar).collect())
    assert got == brute_components(rows, k, similar)[0]


def test_blocks_of_a_shingle(spark, monkeypatch):
    """With no rounds of centres all pairs are compared in blocks, here small ones."""
    rows = near_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 4, 85)[0]
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 50)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(d, 4, 85).collect()) == want
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "PAIRS_AT_ONCE", 50)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(d, 3, 85).collect()) == brute_components(rows, 3, 85)[0]


def test_prefixes_meet():
    """Any two similar sets share a prefix shingle, at places that leave room."""
    rng = np.random.default_rng(5)
    levels = rng.integers(0, 256, ngram_join.LEVELS // 2).astype(np.uint8)
    for similar in (50, 80, 85):
        for _ in range(200):
            x = rng.integers(0, 1 << 63, rng.integers(1, 40)).astype(np.uint64)
            y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.93], rng.integers(0, 1 << 63, rng.integers(0, 4)).astype(np.uint64)]))
            x = np.unique(x)
            both = len(np.intersect1d(x, y))
            if both and 100 * both >= similar * (len(x) + len(y) - both):
                p, q = (ngram_join.prefix_of(s, levels, similar).tolist() for s in (x, y))
                common = [s for s in p if s in q]
                bits = [ngram_join.bitmap_of(ngram_join.prefix_of(z, levels, similar))[None] for z in (x, y)]
                assert ngram_join._enough(np.array([len(x)]), bits[0], np.array([len(y)]), bits[1], similar)[0]
                assert common and ngram_join._room(np.array(len(x)), np.array(p.index(common[0])), np.array(len(y)), np.array(q.index(common[0])), similar)


def test_joins_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_documents(empty).count() == 0


def test_near_dedup_stage(spark):
    """One document of each component stays, unlike texts under one id both do, repeated rows are one document."""
    rows = near_rows()
    d = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in rows], "doc_id long, text string, first string, n_chars int")
    got = corpus_pipeline.near_dedup(spark, d, SF)
    assert got.columns == d.columns
    _, root = brute_components(rows, 5, 80)
    left = Counter((r.doc_id, r.text) for r in got.collect())
    place = {x: n for n, x in enumerate(rows)}
    worded = [x for x in left if WORD.search(x[1] or "")]
    assert all(n == 1 for n in left.values()) and len(worded) == len({root[n] for n, (_, t) in enumerate(rows) if WORD.search(t or "")})
    assert len({root[place[x]] for x in worded}) == len(worded)
    assert {x for x in left if not WORD.search(x[1] or "")} == {(None, None), (None, ""), (1, ""), (2, None)}
    assert all((7, t) in left or any(root[place[w]] == root[place[7, t]] for w in worded) for i, t in rows if i == 7)
    assert corpus_pipeline.near_dedup(spark, d.limit(0), SF).count() == 0


def test_prefix_rows_are_sent_once(spark, monkeypatch):
    """What finds the shared shingles and what it is joined with read one exchange."""
    seen = {}
    whole = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag: seen.setdefault(tag, df._jdf.queryExecution().executedPlan().toString()) and None or whole(df, tag))
    docs = spark.createDataFrame([(i, " ".join(f"w{j + i % 3}" for j in range(60))) for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs, 4, 85).collect()}
    assert got == {i: 0 for i in range(6)}
    plan = seen["buckets"]
    assert "REPARTITION_BY_COL" in plan and "Exchange hashpartitioning(key" in plan and "ENSURE_REQUIREMENTS" not in "".join(x for x in plan.split("\n") if "hashpartitioning(key" in x)
