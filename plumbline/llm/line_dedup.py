"""Line dedup: lines inside a window of three consecutive lines that occurred earlier are removed.

Lines are what lies between \\n. A window's first occurrence is the smallest (doc_id, digest of the
text, line number); all others are later ones, and every line that a later occurrence covers goes. Windows of blank
lines alone don't count. Built-in functions only.

Defined results: documents of fewer than three lines and null texts stay as they are (null stays
null); a document is a doc_id and a text, so that texts under one doc_id, null too, are told apart by
a digest, and rows alike in both are one document, of whose rows none is later than another; a null
doc_id sorts first; an empty table gives an empty one. Other columns pass unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import same

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, digest and `cover`: the sorted line numbers that later occurrences of repeated windows cover."""
    d = docs.select("doc_id", F.xxhash64("text").alias("digest"), _lines(F.col("text")).alias("l")).where(F.size("l") >= window)
    at = lambda i: [F.get("l", i + k) for k in range(window)]
    blank = lambda i: F.trim(F.translate(F.concat(*at(i)), "\t\x0b\f\r", "    ")) == ""
    rows = F.transform(F.sequence(F.lit(0), F.size("l") - window), lambda i: F.struct(F.xxhash64(*at(i)).alias("h1"), F.xxhash64(F.lit("second"), *at(i)).alias("h2"), i.alias("pos"), blank(i).alias("blank")))
    w = d.select("doc_id", "digest", F.inline(rows)).where(~F.col("blank")).select("doc_id", "digest", "h1", "h2", "pos")
    repeated = w.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "digest", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = w.join(repeated, ["h1", "h2"]).where(~F.struct("doc_id", "digest", "pos").eqNullSafe(F.col("first")))
    spread = F.flatten(F.transform(F.collect_set("pos"), lambda p: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: p + k)))
    return later.groupBy("doc_id", "digest").agg(F.array_sort(F.array_distinct(spread)).alias("cover"))


def drop_repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text freed of covered lines, plus n_lines and n_removed; clashing columns are replaced."""
    cover = covered_lines(docs, window)
    kept = F.array_join(F.filter(_lines(F.col("a.text")), lambda x, i: F.coalesce(~F.array_contains("b.cover", i), F.lit(True))), "\n")
    other = [F.col(f"a.`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    mine = F.xxhash64("a.text") == F.col("b.digest")
    return docs.alias("a").join(cover.alias("b"), same("doc_id") & mine, "left").select(
        *other, F.when(F.col("b.cover").isNull(), F.col("a.text")).otherwise(kept).alias("text"),
        F.coalesce(F.size(_lines(F.col("a.text"))), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.size("b.cover"), F.lit(0)).cast("long").alias("n_removed"),
    )


#: DuckDB; needs a view documents(doc_id, text).
LINE_DEDUP_SQL = r"""
with l as (select doc_id, text, string_split(text, chr(10)) as l from documents),
w as (select doc_id, i as pos, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] as k
      from (select doc_id, l, unnest(range(0, len(l) - 2)) as i from l where len(l) >= 3)),
w2 as (select * from w where regexp_replace(k, '[\x20\x09-\x0D]', '', 'g') <> ''),
f as (select k, min((doc_id, pos)) as first from w2 group by k having count(*) > 1),
later as (select w2.doc_id, w2.pos from w2 join f using (k) where (w2.doc_id, w2.pos) <> f.first),
cov as (select distinct doc_id, pos + d as pos from later, (values (0), (1), (2)) as v(d)),
e as (select doc_id, unnest(range(0, len(l))) as pos, unnest(l) as line from l where text is not null),
kept as (select e.doc_id, string_agg(e.line, chr(10) order by e.pos) as text
         from e left join cov on cov.doc_id = e.doc_id and cov.pos = e.pos where cov.pos is null group by e.doc_id),
n as (select doc_id, count(*) as n from cov group by doc_id)
select l.doc_id, case when l.text is null then null else coalesce(kept.text, '') end as text,
       cast(coalesce(len(l.l), 0) as bigint) as n_lines, cast(coalesce(n.n, 0) as bigint) as n_removed
from l left join kept on kept.doc_id = l.doc_id left join n on n.doc_id = l.doc_id
"""
