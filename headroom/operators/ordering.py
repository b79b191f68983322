"""Row order inside a series, spread over many tasks.

A window over one series is one task, and one series may hold a third of all rows.
So every operator that needs the order of rows (splits, lags, rolling sums, medians)
builds on three primitives that never put a long series into one task:

* ``cut_values``    - the order value at given ranks of each series,
* ``with_position`` - the row number and the row count of each series,
* ``in_chunks``     - window expressions over chunks of a fixed number of rows,
  each with as many rows of its neighbours as the expressions look back or ahead.

The rows of each series are counted first. When no series has more than ``rows`` of
them, one window per series is all it takes. Otherwise ranks come from counts: the span
of a series is cut into cells of equal width, a cell that still holds too many rows is
cut again by its own count, and running sums over those small count tables give the
offset of each cell. The counts are exact, so the result does not depend on
partitioning. Count tables are written before they are joined: they are computed once,
and the optimizer broadcasts them only if they are small. Where a series is a gap-free
grid, ``step`` gives ranks by arithmetic and rows are not shuffled at all.

``(series, order)`` is expected to be unique. Rows of a series with the same order
value are numbered in the order of ``tie`` columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from headroom.functions.clock import order_value
from headroom.session import settle

ROWS_PER_TASK = 250_000


def _valued(df: DataFrame, order: str, weight: str | None = None) -> DataFrame:
    counted = F.lit(1) if weight is None else F.col(weight)
    return df.withColumns({"_v": order_value(df, order), "_w": counted.cast("bigint")})


def _spans(valued: DataFrame, series: Sequence[str], rows: int) -> tuple[DataFrame, bool]:
    """Rows, first value and cell width per series, and whether any series has more than ``rows`` rows."""
    span = valued.groupBy(*series).agg(
        F.sum("_w").alias("n"), F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    width = F.expr(f"(_hi - _lo) div greatest(1L, _rows div {rows}L) + 1")
    spans = settle(span.select(*series, "n", "_rows", "_lo", width.alias("_width")))
    return spans, not spans.where(F.col("_rows") > rows).isEmpty()


def _in_cells(valued: DataFrame, spans: DataFrame, series: Sequence[str], rows: int) -> tuple[DataFrame, bool]:
    """Rows with their cell, the weight before it and their part of it, and whether any cell has parts."""
    celled = valued.join(spans.drop("_rows"), list(series)).withColumn("_cell", F.expr("(_v - _lo) div _width"))
    running = Window.partitionBy(*series).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = celled.groupBy(*series, "_cell", "_width").agg(F.sum("_w").alias("_c"), F.count(F.lit(1)).alias("_k"))
    parts = F.greatest(F.lit(1), F.expr(f"least(_width, _k div {rows}L)"))
    cells = settle(
        counts.select(
            *series,
            "_cell",
            "_c",
            F.coalesce(F.sum("_c").over(running), F.lit(0)).alias("_before"),
            parts.alias("_parts"),
            F.expr(f"(_width - 1) div greatest(1L, least(_width, _k div {rows}L)) + 1").alias("_part_width"),
        )
    )
    hot = not cells.where(F.col("_parts") > 1).isEmpty()
    parted = celled.join(cells, [*series, "_cell"]).withColumn(
        "_part", F.expr("(_v - _lo - _cell * _width) div _part_width") if hot else F.lit(0).cast("bigint")
    )
    return parted, hot


def _with_part_offsets(parted: DataFrame, series: Sequence[str], hot: bool) -> DataFrame:
    """Add ``_first``, the weight before the row's part; parts are counted only where a cell has several."""
    if not hot:
        return parted.withColumn("_first", F.col("_before"))
    inside = Window.partitionBy(*series, "_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = settle(
        parted.where(F.col("_parts") > 1)
        .groupBy(*series, "_cell", "_part")
        .agg(F.sum("_w").alias("_pc"))
        .select(*series, "_cell", "_part", F.coalesce(F.sum("_pc").over(inside), F.lit(0)).alias("_inner"))
    )
    joined = parted.join(parts, [*series, "_cell", "_part"], "left")
    return joined.withColumn("_first", F.col("_before") + F.coalesce("_inner", F.lit(0)))


def _grid_spans(df: DataFrame, series: Sequence[str], order: str, step: int) -> DataFrame:
    """Span per series of a regular grid; a gap or a duplicate is an error, not a wrong rank."""
    valued = df.withColumn("_v", order_value(df, order))
    span = valued.groupBy(*series).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    regular = F.col("_rows") == F.expr(f"(_hi - _lo) div {step}L + 1")
    stop = F.raise_error(F.lit(f"series is not a gap-free grid with step {step} microseconds"))
    return settle(
        span.select(*series, "_lo", F.when(regular, F.col("_rows")).otherwise(stop.cast("bigint")).alias("n"))
    )


def with_position(
    df: DataFrame,
    *,
    series: Sequence[str],
    order: str = "ds",
    tie: Sequence[str] = (),
    step: int | None = None,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``rn`` (1-based position in the series) and ``n`` (rows in the series)."""
    series = list(series)
    if step is not None:
        spans = _grid_spans(df.select(*series, order), series, order, step)
        placed = df.withColumn("_v", order_value(df, order)).join(spans, series)
        return placed.withColumn("rn", F.expr(f"(_v - _lo) div {step}L + 1")).select(*df.columns, "n", "rn")

    spans, long = _spans(_valued(df.select(*series, order), order), series, rows)
    valued = _valued(df, order)
    if not long:
        whole = Window.partitionBy(*series)
        return valued.select(
            *df.columns,
            F.count(F.lit(1)).over(whole).alias("n"),
            F.row_number().over(whole.orderBy("_v", *tie)).cast("bigint").alias("rn"),
        )
    narrow, hot = _in_cells(valued, spans, series, rows)
    placed = _with_part_offsets(narrow, series, hot)
    local = Window.partitionBy(*series, "_cell", "_part").orderBy("_v", *tie)
    return placed.select(*df.columns, "n", (F.col("_first") + F.row_number().over(local)).alias("rn"))


def cut_values(
    df: DataFrame,
    ranks: Mapping[str, Column],
    *,
    series: Sequence[str],
    order: str = "ds",
    step: int | None = None,
    weight: str | None = None,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per series: ``n`` and, per entry of ``ranks``, the order value (bigint) at that rank.

    A rank is an expression over ``n``. Ranks outside ``1..n`` give null. Of a long series
    only the cells that hold a wanted rank are sorted; the rest is counted. With
    ``weight`` a row stands for that many equal rows.
    """
    series = list(series)
    if step is not None:
        spans = _grid_spans(df.select(*series, order), series, order, step)
        return spans.select(
            *series,
            "n",
            *[
                F.when((rank >= 1) & (rank <= F.col("n")), F.col("_lo") + (rank - 1) * F.lit(step))
                .cast("bigint")
                .alias(name)
                for name, rank in ranks.items()
            ],
        )

    valued = _valued(df.select(*series, order, *([weight] if weight else [])), order, weight).select(*series, "_v", "_w")
    spans, long = _spans(valued, series, rows)
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()]
    )

    def hits(first: Column, count: Column) -> Column:
        return F.filter(wanted, lambda w: (w["rank"] > first) & (w["rank"] <= first + count))

    if long:
        parted, hot = _in_cells(valued, spans, series, rows)
        near = parted.where(F.size(hits(F.col("_before"), F.col("_c"))) > 0)
        placed = _with_part_offsets(near, series, hot)
        local = Window.partitionBy(*series, "_cell", "_part")
    else:
        whole = Window.partitionBy(*series)
        placed = valued.select("*", F.sum("_w").over(whole).alias("n"), F.lit(0).cast("bigint").alias("_first"))
        local = whole
    through = F.sum("_w").over(local.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    reached = placed.withColumn("_through", through + F.col("_first"))
    at = {name: (rank.cast("bigint") > F.col("_through") - F.col("_w")) & (rank.cast("bigint") <= F.col("_through")) for name, rank in ranks.items()}
    found = reached.groupBy(*series).agg(*[F.max(F.when(hit, F.col("_v"))).alias(name) for name, hit in at.items()])
    return spans.select(*series, "n").join(found, series, "left")


def in_chunks(
    df: DataFrame,
    expressions: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    series: Sequence[str],
    before: int = 0,
    after: int = 0,
    rows: int = ROWS_PER_TASK,
    position: str = "rn",
) -> DataFrame:
    """Evaluate window expressions over chunks of the series, ordered by ``position``.

    ``before``/``after`` say how many rows the expressions look back and ahead. Chunks
    have the same number of rows whatever the series looks like, and the border rows
    are sent to the neighbour chunk as well, so results equal those of one big window.
    """
    spread = haloed(df, before=before, after=after, rows=rows, position=position)
    window = Window.partitionBy(*series, "_chunk").orderBy(position)
    added = expressions(window)
    return (
        spread.select("*", *[column.alias(name) for name, column in added.items()])
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_own", "_chunk")
    )


def haloed(
    df: DataFrame, *, before: int = 0, after: int = 0, rows: int = ROWS_PER_TASK, position: str = "rn"
) -> DataFrame:
    """Add ``_own``, the chunk of the row, and ``_chunk``, the chunk this copy of the row is for."""
    size = max(rows, before, after, 1)
    at = (F.col(position) - 1) % F.lit(size)
    own = F.floor((F.col(position) - 1) / F.lit(size)).cast("bigint")
    targets = [own]
    if before:
        targets.append(F.when(at >= size - before, own + 1))
    if after:
        targets.append(F.when((at < after) & (own > 0), own - 1))
    spread = df.withColumn("_own", own)
    if len(targets) == 1:
        return spread.withColumn("_chunk", F.col("_own"))
    return spread.withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))


def with_lags(
    df: DataFrame,
    lags: Mapping[str, tuple[str, int]],
    *,
    series: Sequence[str],
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``{name: (column, offset)}`` row lags (negative offsets look ahead); needs ``rn``."""
    before = max([offset for _, offset in lags.values() if offset > 0], default=0)
    after = max([-offset for _, offset in lags.values() if offset < 0], default=0)
    return in_chunks(
        df,
        lambda w: {name: F.lag(column, offset).over(w) for name, (column, offset) in lags.items()},
        series=series,
        before=before,
        after=after,
        rows=rows,
    )


def running_total(df: DataFrame, value: Column, name: str, *, series: Sequence[str], rows: int = ROWS_PER_TASK) -> DataFrame:
    """Add the running sum of ``value`` by position: sums inside chunks plus the sums of the chunks before."""
    chunk = F.floor((F.col("rn") - 1) / F.lit(rows)).cast("bigint")
    chunked = df.withColumn("_value", value).withColumn("_chunk", chunk)
    ahead = Window.partitionBy(*series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        chunked.groupBy(*series, "_chunk")
        .agg(F.sum("_value").alias("_total"))
        .select(*series, "_chunk", F.sum("_total").over(ahead).alias("_ahead"))
    )
    inner = Window.partitionBy(*series, "_chunk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    summed = chunked.withColumn("_inner", F.sum("_value").over(inner)).join(totals, [*series, "_chunk"])
    return summed.withColumn(name, F.col("_inner") + F.coalesce("_ahead", F.lit(0))).select(*df.columns, name)
