"""Centroid clustering of integer vectors by Shallot search: exact k-means that looks at few centroids a vector.

Each vector remembers its nearest and second-nearest centroid, an upper bound of the first distance and a
lower bound of all others. When centroids have moved, the bounds move with them; a vector whose bounds
still tell its nearest centroid apart is done. Another one computes its distance to both remembered
centroids and starts from the closer: centroids are scanned in the order of their distance from that one, and
none that is further from it than the sum of the vector's two lowest distances so far can be nearest or second, so the
ball shrinks as the scan finds nearer ones. What survives is compared by whole-number squared distances; ties go
to the smaller number. Bounds are floating-point square roots with a margin, used only to leave work out.

The state of a round is written to the shared folder, so a lost executor costs that round's share; the state before it goes
once the next is written. Tasks send one row of sums for each centroid and batch; only centroids (k rows) reach the driver.

Defined results: vectors with another number of components than `size`, or with null or non-finite ones, are
left out; repeated rows are vectors of their own; a null vec_id hashes as an empty text; with fewer than k
vectors each starts a centroid; an empty table gives an empty one. A component beyond 2**21 is an error,
since squared distances would pass a long. Of the input only vec_id and the vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scratch import new_path

#: A component becomes floor(SCALE * component).
SCALE = 64
#: Components are lower than this in absolute value once scaled.
MOST = 1 << 27
#: Vectors whose distances are computed at a time.
AT_ONCE = 8192
_STATE = "vec_id long, x binary, near int, second int, dist long, above double, below double"
_FIELDS = ["vec_id", "x", "near", "second", "dist", "above", "below"]


def _up(x):
    return x * (1 + 1e-12) + 1e-9


def _down(x):
    return np.maximum(x * (1 - 1e-12) - 1e-9, 0.0)


class Centroids:
    """Whole-number centroids with each one's neighbours in the order of distance."""

    def __init__(self, c: np.ndarray):
        self.c = c
        gap = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(2).astype(np.float64))
        self.order = np.argsort(gap, axis=1, kind="stable")
        # A centroid comes first in its own order, also beside an equal one.
        for i, row in enumerate(self.order):
            at = int(np.flatnonzero(row == i)[0])
            row[: at + 1] = np.r_[i, row[:at]]
        self.gap = np.take_along_axis(gap, self.order, 1)
        self.half = _down(self.gap[:, 1] / 2) if len(c) > 1 else np.full(1, np.inf)

    def to(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of vectors from a centroid each."""
        return ((x - self.c[which]) ** 2).sum(1)


def moved(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid went, and for each the furthest that another one went."""
    by = _up(np.sqrt(((before - after) ** 2).sum(1).astype(np.float64)))
    if len(by) == 1:
        return by, np.zeros(1)
    top = np.argsort(by)[::-1]
    return by, np.where(np.arange(len(by)) == top[0], by[top[1]], by[top[0]])


def search(x: np.ndarray, near: np.ndarray, second: np.ndarray, above: np.ndarray, below: np.ndarray, at: Centroids) -> tuple[np.ndarray, ...]:
    """near, second, squared distance, above, below of vectors x after a Shallot search that starts from what they had; and the number of distances computed."""
    near, second, above, below = near.copy(), second.copy(), above.copy(), below.copy()
    dist = at.to(x, near)
    root = np.sqrt(dist.astype(np.float64))
    above = np.minimum(above, _up(root))
    n, k = len(x), len(at.c)
    todo = np.flatnonzero(~((above < below) | (above < at.half[near])))
    if k == 1 or not len(todo):
        return near, second, dist, above, below, n
    v = x[todo]
    a, b, da = near[todo], second[todo], dist[todo]
    db = at.to(v, b)
    n += len(todo)
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    start, reach, skip = a.copy(), _up(np.sqrt(da.astype(np.float64))), b.copy()
    edge = reach + _up(np.sqrt(db.astype(np.float64)))
    on = np.arange(len(todo))
    for j in range(1, k):
        on = on[at.gap[start[on], j] <= edge[on]]  # neighbours further on are further off: these vectors are done
        if not len(on):
            break
        c = at.order[start[on], j]
        look = on[c != skip[on]]
        c = at.order[start[look], j]
        d = at.to(v[look], c)
        n += len(look)
        first = (d < da[look]) | ((d == da[look]) & (c < a[look]))
        other = ~first & ((d < db[look]) | ((d == db[look]) & (c < b[look])))
        i = look[first]
        b[i], db[i], a[i], da[i] = a[i], da[i], c[first], d[first]
        i = look[other]
        b[i], db[i] = c[other], d[other]
        edge[look] = reach[look] + _up(np.sqrt(db[look].astype(np.float64)))
    near[todo], second[todo], dist[todo] = a, b, da
    above[todo], below[todo] = _up(np.sqrt(da.astype(np.float64))), _down(np.sqrt(db.astype(np.float64)))
    return near, second, dist, above, below, n


def whole_vectors(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """vec_id and the vector as whole numbers, of rows whose vector is whole and finite."""
    good = (F.size(column) == size) & F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(column).isNotNull()).where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def _matrix(col: pa.Array, kind=np.int32) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1).astype(np.int64)


def _batch(ids: pa.Array, x: pa.Array, found: tuple) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([ids, x, *[pa.array(v, t) for v, t in zip(found[:5], kinds, strict=True)]], _FIELDS)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def first_state(whole: DataFrame, c: np.ndarray) -> DataFrame:
    """Every vector with its nearest and second-nearest centroid, from a search that knows nothing yet."""
    size = c.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Centroids(c)
        for b in _sliced(batches):
            x = np.asarray(b.column("x").flatten()).reshape(-1, size)
            if (np.abs(x) >= MOST).any():
                raise ValueError(f"a component is {MOST / SCALE:.0f} or more in absolute value")
            zero, one = np.zeros(len(x), np.int32), np.full(len(x), min(1, len(c) - 1), np.int32)
            found = search(x, zero, one, np.full(len(x), np.inf), np.zeros(len(x)), at)
            rows = x.astype(np.int32)
            yield _batch(b.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary()), found)

    return whole.mapInArrow(assign, _STATE)


def next_state(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """The state once centroids have moved from `before` to `after`."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, (own, others) = Centroids(after), moved(before, after)
        for b in _sliced(batches):
            near, second = (b.column(f).to_numpy() for f in ("near", "second"))
            above, below = _up(b.column("above").to_numpy() + own[near]), _down(b.column("below").to_numpy() - others[near])
            yield _batch(b.column("vec_id"), b.column("x"), search(_matrix(b.column("x")), near, second, above, below, at))

    return state.mapInArrow(assign, _STATE)


def _sums(state: DataFrame, size: int) -> dict[int, tuple[int, int, list[int]]]:
    """Of each centroid with vectors: their number, their distances added up, their components added up. A task sends a row for each centroid and batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            x, near = _matrix(b.column("x")), b.column("near").to_numpy()
            hit, at = np.unique(near, return_inverse=True)
            sums = np.zeros((len(hit), size), np.int64)
            np.add.at(sums, at, x)
            dist = [sum(d.tolist()) for d in (b.column("dist").to_numpy()[at == i] for i in range(len(hit)))]
            digits = pa.array(dist, pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(np.bincount(at), pa.int64()), digits, pa.array(sums.tolist(), pa.list_(pa.int64()))], ["near", "n", "dist", "sums"])

    parts = state.mapInArrow(add, "near int, n long, dist decimal(38,0), sums array<long>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(28,0)")).alias(f"s{i}") for i in range(size)]
    rows = parts.groupBy("near").agg(F.sum("n").alias("n"), F.sum("dist").alias("dist"), *exact).collect()  # k rows
    return {r["near"]: (int(r["n"]), int(r["dist"]), [int(r[f"s{i}"]) for i in range(size)]) for r in rows}


def starts(whole: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors whose hash is smallest; each task sends k rows at most."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, column: str = "embedding", size: int = 64) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each whole vector."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, column, size)
    c = starts(whole, k)
    if not len(c):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    folder = new_path(spark, "clusters")
    state = _written(first_state(whole, c), f"{folder}/0")
    found = _sums(state, size)
    for turn in range(1, rounds + 1):
        after = c.copy()
        for i, (n, _, sums) in found.items():
            after[i] = [s // n for s in sums]
        state = _written(next_state(state, c, after), f"{folder}/{turn}")
        _remove(spark, f"{folder}/{turn - 1}")
        c, found = after, _sums(state, size)
    total = sum(d for _, d, _ in found.values())
    told = [(i, found.get(i, (0, 0))[1], total, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in enumerate(c.tolist())]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return state.select("vec_id", F.col("near").alias("cluster"), F.col("dist").alias("distance")).join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _cluster_sql(k: int, rounds: int, size: int) -> str:
    """Each round: squared distances from all centroids, the nearest by (distance, number), floors of exact means."""
    sql = f"""with vec as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda c: cast(floor({SCALE} * cast(c as double)) as bigint)) as x from embeddings
where embedding is not null and len(embedding) = {size} and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = {size}),
c0 as materialized (select cast(row_number() over (order by sha256('1:' || coalesce(cast(vec_id as varchar), '')), x) - 1 as int) as c, x from vec qualify c < {k})"""
    for i in range(rounds + 1):
        sql += f""",
a{i} as materialized (select r, vec_id, x, c, dist from (select v.r, v.vec_id, v.x, c.c, list_sum(list_transform(range(1, {size + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) as dist from vec v cross join c{i} c) q qualify row_number() over (partition by r order by dist, c) = 1)"""
        if i < rounds:
            sql += f""",
m{i} as materialized (select c, list(cast(floor_mean as bigint) order by i) as x from (select c, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) as floor_mean from (select c, unnest(x) as v, unnest(range({size})) as i from a{i}) q group by c, i) q group by c),
c{i + 1} as materialized (select c.c, coalesce(m.x, c.x) as x from c{i} c left join m{i} m on m.c = c.c)"""
    return sql + f"""
select vec_id, a.c as cluster, cast(dist as bigint) as distance, cast(sum(dist) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(dist) over () as bigint) as inertia, sha256(array_to_string(k.x, ',')) as centroid_sha256 from a{rounds} a join c{rounds} k on k.c = a.c"""


CLUSTER_SQL = _cluster_sql(16, 3, 64)
