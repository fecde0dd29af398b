"""Window primitives: rolling values with a full window, percentile ranks, exponential means, as-of values."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame, key: str = "ticker", share: float = 1.0) -> DataFrame:
    """df dealt by key in as many parts as the session's shuffles have, or that share of them (but one for each core), a number that stays. Tables dealt alike are stacked without being sent again."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(math.ceil(most * share), min(most, spark.sparkContext.defaultParallelism)), key)


def by_key(key: str = "ticker", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def rolling(agg, x: Column, n: int, key: str | None = "ticker", order: str = "date") -> Column:
    """agg over the last n rows; null until n of them hold a value."""
    base = Window.partitionBy(key).orderBy(order) if key else Window.orderBy(order)
    w = base.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def rolled(df: DataFrame, wanted: dict[str, tuple], key: str = "ticker", order: str = "date") -> DataFrame:
    """df with rolling values that cost the same for every window length.

    wanted: name -> (kind, column, n), or ("cov", x, y, n); kinds are sum, avg, max, var and std (of a sample). A
    value is null unless all of the last n rows have one. A sliding frame would add up n rows for each row; here windows
    of 1, 2, 4, ... rows are each made of two of half the length, one of them `lag` rows back, and n rows of
    at most two or a few of those. Means and squared deviations are merged like partial aggregates, so nothing cancels out.
    All lags share one sort. Columns are numbers.
    """
    w = by_key(key, order)
    size: dict[tuple, int] = {}  # quantity -> the longest window that is needed of it

    def need(q: tuple, n: int) -> None:
        size[q] = max(size.get(q, 1), 1 << (n.bit_length() - 1))

    for kind, *xs, n in wanted.values():
        for q in {"max": [("max", *xs)], "sum": [("sum", *xs)], "avg": [("sum", *xs)]}.get(kind, [("sum", x) for x in xs] + [("co", xs[0], xs[-1])]):
            need(q, n)
    name = lambda q, m: "__" + "_".join((*q, str(m)))
    c = lambda q, m: F.col(name(q, m))
    for q, m in [(q, m) for q, m in size.items() if q[0] == "co"]:
        for x in q[1:]:
            size["sum", x] = max(size.get(("sum", x), 1), m)
    d = df.withColumns({name(q, 1): F.col(q[1]).cast("double") if q[0] != "co" else (F.col(q[1]) * F.col(q[2])).cast("double") * 0 for q in size})

    def doubled(q: tuple, m: int, k: int) -> Column:
        """q over the 2 * m rows that end k * m rows back, made of what `back` names of m rows."""
        mine = lambda q, k: F.col(f"{name(q, m)}_back{k}") if k else c(q, m)
        a, b = mine(q, k), mine(q, k + 1)
        apart = lambda x: (mine(("sum", x), k) - mine(("sum", x), k + 1)) / m
        return {"sum": lambda: a + b, "max": lambda: _all_max(a, b), "co": lambda: a + b + apart(q[1]) * apart(q[2]) * (m / 2)}[q[0]]()

    m = 1
    while 2 * m <= max(size.values(), default=1):
        now = [q for q, most in size.items() if most >= 2 * m]
        again = [q for q, most in size.items() if most >= 4 * m]
        # Two doublings share a pass over the rows: the second reads what the first gives 2 * m rows back as two of m rows.
        d = d.withColumns({f"{name(q, m)}_back{k}": F.lag(name(q, m), k * m).over(w) for q in now for k in ((1, 2, 3) if q in again else (1,))})
        d = d.withColumns({name(q, 2 * m): doubled(q, m, 0) for q in now} | {f"{name(q, 2 * m)}_back1": doubled(q, m, 2) for q in again})
        four = lambda q: _all_max(c(q, m), *[F.col(f"{name(q, m)}_back{k}") for k in (1, 2, 3)]) if q[0] == "max" else doubled(q, 2 * m, 0)  # noqa: B023, E731
        d = d.withColumns({name(q, 4 * m): four(q) for q in again})
        m *= 4
    # n rows are windows of its powers of two, one behind the other; for a maximum two that overlap do.
    parts: dict[str, list[tuple[int, int]]] = {}
    for out, (kind, *_, n) in wanted.items():
        powers = [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]
        parts[out] = [(powers[0], 0), (powers[0], n - powers[0])] if kind == "max" else [(p, sum(powers[:i])) for i, p in enumerate(powers)]
    lags = {}
    for out, (kind, *xs, _) in wanted.items():
        used = [("max", *xs)] if kind == "max" else [("sum", x) for x in xs] + ([] if kind in ("sum", "avg") else [("co", xs[0], xs[-1])])
        for q in used:
            lags |= {f"{name(q, p)}_at_{off}": F.lag(name(q, p), off).over(w) for p, off in parts[out] if off}
    d = d.withColumns(lags)
    at = lambda q, p, off: F.col(f"{name(q, p)}_at_{off}") if off else c(q, p)

    def value(out: str) -> Column:
        kind, *xs, n = wanted[out]
        if kind == "max":
            return _all_max(*[at(("max", *xs), p, off) for p, off in parts[out]])
        sums, co, seen = None, None, 0
        for p, off in parts[out]:
            s = [at(("sum", x), p, off) for x in xs]
            if kind not in ("sum", "avg"):
                own = at(("co", xs[0], xs[-1]), p, off)
                step = [a / seen - b / p for a, b in zip(sums, s, strict=True)] if sums else None
                co = own if co is None else co + own + step[0] * step[-1] * (seen * p / (seen + p))
            sums = s if sums is None else [a + b for a, b in zip(sums, s, strict=True)]
            seen += p
        if kind in ("var", "std"):  # what rounding leaves of equal values is no deviation
            co = F.when(co > 1e-24 * n * F.pow(sums[0] / n, 2), co).when(co.isNotNull(), 0.0)
        spread = co / (n - 1) if kind not in ("sum", "avg") and n > 1 else None
        return {"sum": sums[0], "avg": sums[0] / n}.get(kind, F.sqrt(spread) if kind == "std" and spread is not None else spread)

    return d.select(*df.columns, *[value(out).alias(out) for out in wanted])


def _all_max(*xs: Column) -> Column:
    return F.when(reduce(and_, [x.isNotNull() for x in xs]), F.greatest(*xs))


def clean_ticker(x: Column) -> Column:
    """Share classes behind a hyphen: BRK.B is BRK-B."""
    return F.translate(F.trim(x), ".", "-")


def dotted_ticker(x: Column) -> Column:
    """The way back: BRK-B is BRK.B, in capitals."""
    return F.upper(F.translate(x, "-", "."))


def day_of(x: Column) -> Column:
    """A date from text like 31-OCT-2025; null if it is none."""
    return F.try_to_timestamp(x, F.lit("dd-MMM-yyyy")).cast("date")


def quarter_of(d: Column) -> Column:
    """The calendar quarter of a date: 2025q3."""
    return F.concat(F.year(d).cast("string"), F.lit("q"), F.quarter(d).cast("string"))


def quarters(spark: SparkSession, start: str, end: str) -> DataFrame:
    """quarter, first_day and last_day of every calendar quarter from that of start to that of end."""
    from_, to = (F.trunc(F.lit(d).cast("date"), "quarter") for d in (start, end))
    d = spark.range(1).select(F.explode(F.sequence(from_, to, F.expr("interval 3 months"))).alias("first_day")) if start <= end else spark.createDataFrame([], "first_day date")
    return d.select(quarter_of(F.col("first_day")).alias("quarter"), "first_day", F.date_sub(F.add_months("first_day", 3), 1).alias("last_day"))


def over_safe(num: Column, den: Column) -> Column:
    """num / den, null where den isn't positive."""
    return num / F.when(den > 0, den)


def pct_rank(x: str, *by: str) -> Column:
    """Average rank of ties, the mean of their first and their last place, over the number of values; nulls stay null. One sort serves all three."""
    order = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    last = F.count(x).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.count(x).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(F.col(x).isNotNull(), (F.rank().over(order) + last) / 2 / total)


def pct_ranks(x: pa.ChunkedArray) -> pa.Array:
    """pct_rank of the values of one group."""
    there = np.asarray(x.is_valid())
    v = np.asarray(x.drop_null(), np.float64)
    s = np.sort(v)  # NaN last, as it is the largest
    out = np.zeros(len(there))
    out[there] = (np.searchsorted(s, v, "left") + 1 + np.searchsorted(s, v, "right")) / 2 / max(len(v), 1)
    return pa.array(out, mask=~there)


def ewm_mean(df: DataFrame, x: str, alpha: float, out: str, key: str = "ticker", order: str = "date") -> DataFrame:
    """df with the exponential mean of one column, as ewm_means defines it."""
    return ewm_means(df, {out: (x, alpha)}, key, order)


def ewm_means(df: DataFrame, wanted: dict[str, tuple[str, float]], key: str = "ticker", order: str = "date") -> DataFrame:
    """df with exponential means; wanted: name -> (column, alpha). y0 = x0, y = (1 - alpha) y + alpha x.

    Leading nulls give null. Nulls inside count as a step at which the value decays by (1 - alpha)
    without input, and the next value is weighed against what is left, as the recursion over rows with gaps does.
    Decayed sums over 1, 2, 4, ... rows are each made of two of half the length, one of them `lag` rows back, until what lies
    further back weighs less than rounding. All lags of all means share the one sort by key and order.
    """
    w = by_key(key, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({f"__{out}_n": F.count(x).over(so_far) for out, (x, _) in wanted.items()})
    start = {}
    for out, (x, alpha) in wanted.items():
        gain = F.when(F.col(x).isNull(), 0.0).when(F.col(f"__{out}_n") == 1, 1.0).otherwise(float(alpha))
        start |= {f"__{out}_v": gain * F.coalesce(F.col(x).cast("double"), F.lit(0.0)), f"__{out}_w": gain}
    d = d.withColumns(start)
    m = 1
    while now := [out for out, (_, alpha) in wanted.items() if (1 - alpha) ** m > 1e-16]:
        d = d.withColumns({f"__{out}_{s}_back": F.lag(f"__{out}_{s}", m).over(w) for out in now for s in "vw"})
        decay = {out: (1 - wanted[out][1]) ** m for out in now}
        d = d.withColumns({f"__{out}_{s}": F.col(f"__{out}_{s}") + decay[out] * F.coalesce(f"__{out}_{s}_back", F.lit(0.0)) for out in now for s in "vw"})
        m *= 2
    # A gap changes nothing until the next value, however long it is.
    last = lambda out, x: F.last(F.when(F.col(x).isNotNull(), F.col(f"__{out}_v") / F.col(f"__{out}_w")), ignorenulls=True).over(so_far)
    return d.select(*df.columns, *[last(out, x).alias(out) for out, (x, _) in wanted.items()])


def as_of(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, values: list[str], tie: list[str], strict: bool = False, each: bool = False) -> DataFrame:
    """left with the values of the last right row of its key whose date is on or before (strict: before) its own.

    each: of every value the last one that isn't null, instead of the last row's. Both sides are stacked and read by one window, so there is one exchange and no range join.
    The rows stay where that exchange and its sort put them: key and date are columns of the stack, so that what follows by key and date moves nothing.
    """
    stamp = F.struct(*[F.col(v).alias(v) for v in values])
    order = F.struct(*[F.col(t) for t in tie]) if tie else F.lit(0)  # compared field by field in its own type
    # A left row without fields of its own still needs them all back: they travel as one struct.
    a = left.select(F.col(key).alias("__k"), F.col(left_date).alias("__d"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(right.select(order.alias("s")).schema["s"].dataType).alias("__tie"), F.struct("*").alias("__left"), F.lit(None).cast(right.select(stamp.alias("s")).schema["s"].dataType).alias("__right"))
    b = right.where(F.col(right_date).isNotNull()).select(F.col(key).alias("__k"), F.col(right_date).alias("__d"), F.lit(1 if strict else 0).alias("__side"), order.alias("__tie"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("__left"), stamp.alias("__right"))
    w = Window.partitionBy("__k").orderBy("__d", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    if each:
        last = F.struct(*[F.last(F.col("__right").getField(v), ignorenulls=True).over(w).alias(v) for v in values])
    else:
        last = F.last("__right", ignorenulls=True).over(w)
    both = a.unionByName(b).withColumn("__right", last).where("__left is not null")
    return both.select(*unstacked(left, "__left", {key: "__k", left_date: "__d"}), *[F.col("__right").getField(v).alias(v) for v in values])


def unstacked(df: DataFrame, row: str, kept: dict[str, str]) -> list[Column]:
    """df's columns out of the struct `row`, but those in kept from the stack's columns named there (in their own type, should the other side be wider)."""
    return [F.col(kept[c]).cast(t).alias(c) if c in kept else F.col(row).getField(c).alias(c) for c, t in df.dtypes]


def business_days_after(d: Column, n: int) -> Column:
    """The date n weekdays after d; from a weekend it counts from the Friday before."""
    day = F.weekday(d)
    start = F.when(day > 4, F.date_sub(d, (day - 4).cast("int"))).otherwise(d)
    at = F.least(day, F.lit(4)) + n
    return F.date_add(start, (F.floor(at / 5) * 7 + at % 5 - F.least(day, F.lit(4))).cast("int"))
