"""Source divergence audit: term frequencies of sources by single-pass in-memory indexing, and how far they are apart.

A task reads its documents once into a block of postings: for each (lang, source) the occurrences and the
documents of each term. When a block holds BLOCK_POSTINGS of them it is spilled: it leaves the task as a run sorted by term,
and a new block begins. Runs are dealt by a hash of (lang, term); in each shard Spark merges the sorted runs
and adds them up into frequencies. A block is bounded by its postings, a run has each term once for a
source, so neither a hot source nor a very frequent term sends more than a row for each block.

The divergence of two sources of a lang is a sum over all terms that the lang keeps. Most terms are missing
from most sources, so the sum starts from what it would be if each term were missing from one side, which
a histogram of counts tells, and only terms that both have are streamed as corrections.

Terms are matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. Defined results: null text, lang
and source are ''; each row is a document, repeated rows count each time; a document without terms still
makes its group occur; a lang without kept terms has pairs of value 0 and no term rows; equal values are
ranked by item (UTF-8); an empty table gives an empty one. Of the input only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, materialize, pieces

#: Postings that a block holds before it is spilled.
BLOCK_POSTINGS = 500_000
#: Bytes of a text whose words are held at a time.
PIECE = 4 << 20
#: A kept term is in at least so many documents of its lang; terms are reported to this rank.
LEAST_DOCS, TOP_TERMS = 10, 10
#: What a byte of a text becomes: terms keep theirs, letters in lower case, all others part terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RUN = "lang string, term string, postings array<struct<source string, n long, docs long>>"
_RUN_TYPE = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]))


def terms_of(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8) in order, those of about `piece` bytes at a time."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        to = text.find(b" ", at + piece)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to + 1


class Block:
    """Postings of the documents read since the last spill."""

    def __init__(self) -> None:
        self.n: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}
        self.groups: Counter = Counter()

    def add(self, lang: str, source: str, text: bytes) -> int:
        """The change in the number of postings."""
        g = lang, source
        n, docs = self.n.setdefault(g, Counter()), self.docs.setdefault(g, Counter())
        self.groups[g] += 1
        before, found = len(n), set()
        for words in terms_of(text):
            n.update(words)
            found.update(words)
        docs.update(found)
        return len(n) - before

    def run(self) -> Iterator[pa.RecordBatch]:
        """The run: for each lang its groups under a null term, then its terms in order with their postings."""
        for lang in sorted({g[0] for g in self.n}):
            held = sorted(g for g in self.n if g[0] == lang)
            yield self._rows(lang, [None], [[(s, 0, self.groups[lang, s]) for _, s in held]])
            postings: dict[bytes, list] = {}
            for g in held:
                docs = self.docs[g]
                for t, n in self.n[g].items():
                    postings.setdefault(t, []).append((g[1], n, docs[t]))
            terms = sorted(postings)
            for at in range(0, len(terms), 20_000):
                part = terms[at : at + 20_000]
                yield self._rows(lang, [t.decode() for t in part], [postings[t] for t in part])

    @staticmethod
    def _rows(lang: str, terms: list[str | None], postings: list[list[tuple]]) -> pa.RecordBatch:
        flat = [p for x in postings for p in x]
        values = pa.StructArray.from_arrays([pa.array([p[i] for p in flat], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["source", "n", "docs"])
        at = [0]
        for x in postings:
            at.append(at[-1] + len(x))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values).cast(_RUN_TYPE)], ["lang", "term", "postings"])


def runs(docs: DataFrame, most: int = BLOCK_POSTINGS) -> DataFrame:
    """lang, term, postings (source, occurrences n, documents docs): the sorted runs of each task's blocks. Rows of a null term tell the groups."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = Block(), 0
        for b in pieces(batches):
            for text, lang, source in zip(b.column("text").cast(pa.binary()), b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
                held += block.add(lang, source, text.as_py())
                if held >= most:
                    yield from block.run()
                    block, held = Block(), 0
        yield from block.run()
        give_back()

    whole = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return whole.mapInArrow(index, _RUN)


def frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, source, n, docs over all documents, merged from the runs; a null term tells a group's documents."""
    # Both dealing and merging are by (lang, term): adding up by source needs no further exchange.
    merged = runs(docs).repartition("lang", "term").sortWithinPartitions("lang", "term")
    return merged.select("lang", "term", F.inline("postings")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _scaled(n, total, terms):
    """p: a smoothed share in thousand millionths, in whole numbers; decimal, as n * 10^9 may pass a long."""
    share = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + 2 * terms).cast("decimal(20,0)"))
    return F.expr("1L") + share.cast("long")


def _apart(p, q):
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` ranks the other sources of the lang, `term` the terms a source has more of than its lang."""
    all_ = materialize(frequencies(docs), "frequencies")
    words = all_.where("term is not null")
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    freq = words.select("lang", "term", "source", "n").join(kept, ["lang", "term"])
    freq = materialize(freq, "kept-frequencies")
    langs = freq.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    sums = freq.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("has"))
    groups = all_.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "has", "v", "total_lang"])
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, _scaled(F.lit(0), F.col("total"), F.col("v")))), "groups")
    shares = freq.join(groups.drop("has"), ["lang", "source"])
    shares = materialize(shares.select("lang", "term", "source", "n", "p0", _scaled(F.col("n"), F.col("total"), F.col("v")).alias("p"), _scaled(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q")), "shares")
    return _pairs(groups, shares).unionByName(_terms(shares))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    a = groups.select("lang", *[F.col(c).alias(f"{c}_a") for c in ("source", "has", "p0")], "v")
    b = groups.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("source", "has", "p0")])
    both = a.join(b, "lang").where("source_a <> source_b")
    # One side: each term of a against what b has without it, from the counts' histogram.
    hist = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    one = hist.select("lang", F.col("source").alias("source_a"), "p", "terms").join(b, "lang").where("source_a <> source_b")
    one = one.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("terms") * _apart(F.col("p"), F.col("p0_b"))).alias("one"))
    # Terms that both have, counted on either side above: what they truly add, less that.
    x = shares.select("lang", "term", *[F.col(c).alias(f"{c}_a") for c in ("source", "p", "p0")])
    y = shares.select("lang", "term", *[F.col(c).alias(f"{c}_b") for c in ("source", "p", "p0")])
    p, q, p0, q0 = (F.col(c) for c in ("p_a", "p_b", "p0_a", "p0_b"))
    mend = _apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)
    shared = x.join(y, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(mend).alias("mend"))
    keys = ["lang", "source_a", "source_b"]
    turned = lambda d: d.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), *[c for c in d.columns if c not in keys])
    missing = (F.col("v") - F.col("has_a") - F.col("has_b")) * _apart(F.col("p0_a"), F.col("p0_b"))
    zero = F.lit(0).cast("long")
    d = both.join(one, keys, "left").join(turned(one).withColumnRenamed("one", "other"), keys, "left").join(shared.unionByName(turned(shared)), keys, "left")
    value = F.coalesce(missing, zero) + F.coalesce("one", zero) + F.coalesce("other", zero) + F.coalesce("mend", zero)
    return _ranked(d.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value")))


def _terms(shares: DataFrame) -> DataFrame:
    d = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    return _ranked(d).where(F.col("rank") <= TOP_TERMS)


def _ranked(d: DataFrame) -> DataFrame:
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


DIVERGENCE_SQL = f"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n_lang from w group by lang, term having count(distinct k) >= {LEAST_DOCS}),
groups as (select distinct lang, source from d),
langs as (select lang, count(*) as v, sum(n_lang) as total from kept group by lang),
counts as (select lang, source, term, count(*) as n from w group by all),
cells as (select g.lang, g.source, k.term, k.n_lang, coalesce(c.n, 0) as n from groups g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select c.lang, source, term, n, 1 + (cast(1000000000 as hugeint) * (n + 2)) // (sum(n) over (partition by c.lang, source) + 2 * v) as p, 1 + (cast(1000000000 as hugeint) * (n_lang + 2)) // (total + 2 * v) as q from cells c join langs l on l.lang = c.lang),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, (select coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) from p x join p y on x.term = y.term and x.lang = y.lang where x.lang = a.lang and x.source = a.source and y.source = b.source) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from pairs
union all select * from (select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from terms) t where rank <= {TOP_TERMS}
"""
