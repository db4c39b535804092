"""Order-dependent operators that never gather one group into one task.

``lag``, running sums and row numbers over (match, period) or over all scores
of a model would send a whole group to one task, and one group may hold a large
part of the table. Here the order axis is cut into slices. Each slice is
summarised with a map-side combined aggregate, the summaries are scanned level
by level (fine, then coarse), and what a slice inherits is handed down to it. The
heavy window is then partitioned by (group, slice).

``slices`` lists integer columns, finest first. Each one must be monotone in
the order, and each coarser one a function of the finer one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def with_scalars(df: DataFrame, single: DataFrame) -> DataFrame:
    """Columns of a one-row aggregate on every row, as one scalar subquery: no join."""
    names = single.columns
    row = single.select(F.struct(*names)).scalar()
    return df.withColumn("_single", row).select(*df.columns, *[F.col(f"_single.{n}").alias(n) for n in names])


def time_slices(t: Column | str, widths: Sequence[int]) -> list[Column]:
    c = F.col(t) if isinstance(t, str) else t
    return [F.floor(c / F.lit(w)).cast("bigint") for w in widths]


def _lagged(rows: DataFrame, keys: list[str], order: list[str], slices: list[Column]) -> DataFrame:
    """Adds ``_prev``, the ``_value`` of the row before.

    Inside a slice the window finds it. Only the first row of a slice has to
    look further back, and only the last rows of earlier slices can answer:
    these edge rows alone go to the next, coarser level. Both parts read the
    same shuffle, so the input is scanned and exchanged once.
    """
    if not slices:
        return rows.withColumn("_prev", F.lag("_value").over(Window.partitionBy(*keys).orderBy(*order)))
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    mark = f"_open{len(slices)}"
    tagged = rows.withColumn("_slice", slices[0]).withColumns(
        {
            "_prev": F.lag("_value").over(w),
            "_first": F.lag(F.lit(1)).over(w).isNull(),
            "_last": F.lead(F.lit(1)).over(w).isNull(),
        }
    )
    inside = tagged.where(~F.col("_first")).drop("_first", "_last", "_slice")
    edges = tagged.where(F.col("_first") | F.col("_last")).select(*rows.columns, F.col("_first").alias(mark))
    found = _lagged(edges, keys, order, slices[1:]).where(mark).drop(mark)
    return inside.unionByName(found)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slices: Sequence[Column],
    cols: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """``lag(cols)`` within ``keys``; a null in the previous row stays null."""
    rows = df.withColumn("_value", F.struct(*[F.col(c) for c in cols]))
    lagged = _lagged(rows, list(keys), list(order), list(slices))
    return lagged.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in cols])


def _running(rows: DataFrame, keys: list[str], order: list[str], slices: list[Column], names: list[str]) -> DataFrame:
    """Adds ``_r_<name>``, the inclusive running sum of ``_v_<name>``.

    Slice sums are scanned the same way on the next level; what a slice
    inherits enters it as one extra row in front.
    """
    w = Window.partitionBy(*keys)
    if not slices:
        w = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(w) for n in names})
    levels = [f"_s{i}" for i in range(len(slices))]
    placed = rows.withColumns(dict(zip(levels, slices)))
    parts = placed.groupBy(*keys, *levels).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in names])
    upto = _running(parts, keys, levels[:1], [F.col(c) for c in levels[1:]], names)
    carry = upto.select(
        *keys,
        F.col("_s0").alias("_slice"),
        *[(F.col(f"_r_{n}") - F.col(f"_v_{n}")).alias(f"_v_{n}") for n in names],
        F.lit(0).alias("_real"),
    )
    here = rows.withColumns({"_slice": slices[0], "_real": F.lit(1)})
    both = here.unionByName(carry, allowMissingColumns=True)
    w = (
        Window.partitionBy(*keys, "_slice")
        .orderBy("_real", *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = both.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(w) for n in names})
    return summed.where(F.col("_real") == 1).drop("_real", "_slice")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slices: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums in ``order`` (which must be total within ``keys``)."""
    rows = df.withColumns({f"_v_{n}": e for n, e in sums.items()})
    out = _running(rows, list(keys), list(order), list(slices), list(sums))
    return out.select(*df.columns, *[F.col(f"_r_{n}").alias(n) for n in sums])


def _seen(rows: DataFrame, keys: list[str], order: list[str], slices: list[Column]) -> DataFrame:
    """Adds ``_seen``, the last non-null ``_mark`` strictly before the row."""
    if not slices:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_seen", F.last("_mark", ignorenulls=True).over(w))
    levels = [f"_s{i}" for i in range(len(slices))]
    placed = rows.withColumns(dict(zip(levels, slices)))
    newest = F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.struct(*order)))
    tails = placed.groupBy(*keys, *levels).agg(newest.alias("_mark"))
    carry = _seen(tails, keys, levels[:1], [F.col(c) for c in levels[1:]]).select(
        *keys, F.col("_s0").alias("_slice"), F.col("_seen").alias("_mark"), F.lit(0).alias("_real")
    )
    here = rows.withColumns({"_slice": slices[0], "_real": F.lit(1)})
    both = here.unionByName(carry.where(F.col("_mark").isNotNull()), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_real", *order).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_seen", F.last("_mark", ignorenulls=True).over(w))
    return found.where(F.col("_real") == 1).drop("_real", "_slice")


def last_seen(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: Sequence[Column], mark: Column, name: str
) -> DataFrame:
    """Last non-null value of ``mark`` strictly before each row, in ascending ``order``."""
    out = _seen(df.withColumn("_mark", mark), list(keys), list(order), list(slices))
    return out.select(*df.columns, F.col("_seen").alias(name))


def row_numbers(df, keys, order, slices, name="rn") -> DataFrame:
    return running_sums(df, keys, order, slices, {name: F.lit(1).cast("bigint")})


def digest_slices(digest: Column | str) -> list[Column]:
    """Slices of a hex digest order: at most 16^5, filled evenly by construction."""
    c = F.col(digest) if isinstance(digest, str) else digest
    return [F.conv(F.substring(c, 1, 5), 16, 10).cast("bigint")]


def recent_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slices: Sequence[Column],
    back: int,
    aggs: dict[str, Column],
    block: int = 8192,
) -> DataFrame:
    """Aggregates over the ``back`` rows before each row.

    Rows are numbered first, then cut into blocks of equal row count; the last
    ``back`` rows of a block are repeated in front of the next one.
    """
    keys, order = list(keys), list(order)
    block = max(block, back)
    rows = row_numbers(df, keys, order, slices, "_rn").withColumn(
        "_block", F.floor((F.col("_rn") - 1) / block).cast("bigint")
    )
    at = (F.col("_rn") - 1) % block
    spread = rows.withColumn(
        "_to",
        F.explode(
            F.when(at >= block - back, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))
        ),
    )
    w = Window.partitionBy(*keys, "_to").orderBy("_rn").rowsBetween(-back, -1)
    return (
        spread.withColumns({n: a.over(w) for n, a in aggs.items()})
        .where(F.col("_to") == F.col("_block"))
        .select(*df.columns, *aggs)
    )


#: Boundaries taken from the data, and equal steps between two of them.
BOUNDS, STEPS = 64, 256


def with_value_slice(df: DataFrame, keys: Sequence[str], value: str, name: str = "_slice") -> DataFrame:
    """Adds an integer slice of ``value``, monotone in it, that follows the data of each group.

    Approximate percentiles of the group's rows are the boundaries, and the range
    between two of them is cut in equal steps: a narrow distribution fills as
    many slices as a wide one, and far outliers leave the rest alone. Best on
    distinct values.
    """
    keys = list(keys)
    shares = F.array(*[F.lit(i / BOUNDS) for i in range(BOUNDS + 1)])
    v = F.col(value).cast("double")
    bounds = F.percentile_approx(v, shares, 20 * BOUNDS)
    if keys:
        # null-safe, so that no null filter is pushed into one side and the input is shared
        names = {k: f"_of_{k}" for k in keys}
        found = df.groupBy(*keys).agg(bounds.alias("_bounds")).withColumnsRenamed(names)
        placed = df.join(found, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    else:
        placed = with_scalars(df, df.agg(bounds.alias("_bounds")))
    inner = F.slice("_bounds", 2, BOUNDS - 1)
    part = F.size(F.filter(inner, lambda b: b <= v))
    low, high = F.element_at("_bounds", part + 1), F.element_at("_bounds", part + 2)
    step = F.when(high > low, F.least(F.greatest((v - low) / (high - low) * STEPS, F.lit(0.0)), F.lit(STEPS - 1.0))).otherwise(0.0)
    return placed.withColumn(name, part.cast("bigint") * STEPS + F.floor(step).cast("bigint")).select(*df.columns, name)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per ``keys``.

    ``weight`` names a column that says how often a row counts.

    Values are counted first, so equal values travel as one row; positions come
    from running counts, never from one sorted buffer per group.
    """
    keys = list(keys)
    times = F.sum(weight) if weight else F.count(F.lit(1))
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(times.alias("_n"))
    total = hist.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = with_value_slice(hist, keys, value, "_value_slice")
    ranked = running_sums(placed, keys, [value], [F.col("_value_slice")], {"_upto": F.col("_n")}).drop("_value_slice")
    if keys:
        # Null-safe, so no null filter is pushed into one side and the count is shared.
        names = {k: f"_total_{k}" for k in keys}
        same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
        ranked = ranked.join(total.withColumnsRenamed(names), same)
    else:
        ranked = with_scalars(ranked, total)
    first = F.col("_upto") - F.col("_n")
    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("_total") - 1)
        pick = [
            F.max(F.when((pos >= first) & (pos < F.col("_upto")), F.col(value))).cast("double") for pos in (low, high)
        ]
        frac = F.max(at - low)
        aggs.append((pick[0] + (pick[1] - pick[0]) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs) if keys else ranked.agg(*aggs)


def text_slices(c: Column | str) -> list[Column]:
    """Slices of a byte-wise text order: the leading 7 and 4 bytes as numbers."""
    raw = F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")
    return [
        F.conv(F.hex(F.rpad(F.substring(raw, 1, n), n, b"\x00")), 16, 10).cast("bigint") for n in (7, 4)
    ]


def number_slices(c: Column | str, width: int = 1 << 20) -> list[Column]:
    """Slices of an integer order with about one row per value, such as a row number."""
    return time_slices(c, [width])
