"""Running sums, ranks and quantiles over a global order, without one task holding a whole group.

Rows are range-partitioned on the full order, so a group or a tie of any size is spread over many
slices. Each slice is summed, the slice sums are accumulated (one row per slice and group), and
only then are rows placed inside their own slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.session import pinned, small_side

SLICE = "_slice"


def running_before(
    df: DataFrame,
    order: Sequence[Column],
    values: Mapping[str, str],
    by: Sequence[str] = (),
    total: str | None = None,
    cut: Column | None = None,
) -> DataFrame:
    """Add, for each ``output: input`` of ``values``, the sum of ``input`` over the earlier rows.

    ``order`` must end in a unique key. ``total`` names a column for the whole group's sum of the
    first input. ``cut`` is a per-group threshold for the first output and may use ``total``:
    slices that lie wholly on one side of it get the sum up to their start, which is on the same
    side, and skip the sort. The output then decides correctly whether a row lies before, at or
    behind the cut, and is exact in the slice that contains it.
    """
    by = list(by)
    first = next(iter(values))
    slices = pinned(
        df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(
            SLICE, F.spark_partition_id()
        )
    )
    sums = slices.groupBy(*by, SLICE).agg(
        *[F.coalesce(F.sum(src), F.lit(0)).alias(f"_total_{out}") for out, src in values.items()]
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    columns = {
        f"_start_{out}": F.coalesce(F.sum(f"_total_{out}").over(earlier), F.lit(0))
        for out in values
    }
    if total is not None:
        columns[total] = F.sum(f"_total_{first}").over(group)
    starts = sums.withColumns(columns)
    # one row per slice, plus one for each group that ends inside a slice
    starts = small_side(starts) if by else F.broadcast(starts)
    # groups may be NULL, so they are matched null-safely
    starts = starts.withColumnsRenamed({c: f"_of_{c}" for c in [*by, SLICE]})
    same = F.col(SLICE) == F.col(f"_of_{SLICE}")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    placed = slices.join(starts, same).drop(*[f"_of_{c}" for c in [*by, SLICE]])
    inside = (
        Window.partitionBy(*by, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    helper = [SLICE]
    for out in values:
        helper += [f"_total_{out}", f"_start_{out}"]

    def sorted_slices(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                out: F.col(f"_start_{out}") + F.coalesce(F.sum(src).over(inside), F.lit(0))
                for out, src in values.items()
            }
        ).drop(*helper)

    if cut is None:
        return sorted_slices(placed)
    begins, ends = F.col(f"_start_{first}"), F.col(f"_start_{first}") + F.col(f"_total_{first}")
    straddles = F.coalesce((begins < cut) & (ends > cut), F.lit(True))
    settled = (
        placed.filter(~straddles)
        .withColumns({out: F.col(f"_start_{out}") for out in values})
        .drop(*helper)
    )
    return settled.unionByName(sorted_slices(placed.filter(straddles)))


def average_rank(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Descending rank; equal values share the mean of the places they take. A NULL has no rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_before(counts, [F.col(value).desc()], {"_before": "_n"}).select(
        value, (F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(rank)
    )
    return df.join(ranks, value, "left")


def exact_quantile(df: DataFrame, value: str, fraction: float, name: str) -> DataFrame:
    """One row with the linearly interpolated quantile, found by position, never by collecting."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    placed = running_before(
        counts, [F.col(value).asc()], {"_before": "_n"}, total="_size"
    ).withColumn("_spot", (F.col("_size") - 1) * F.lit(float(fraction)))

    def at(position: Column) -> Column:
        hit = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_n"))
        return F.max(F.when(hit, F.col(value)))

    both = placed.agg(
        at(F.floor("_spot")).alias("_low"),
        at(F.ceil("_spot")).alias("_high"),
        F.max("_spot").alias("_spot"),
    )
    share = F.col("_spot") - F.floor("_spot")
    return both.select(
        (F.col("_low") + share * (F.col("_high") - F.col("_low"))).alias(name)
    )
