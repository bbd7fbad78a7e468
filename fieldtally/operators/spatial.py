"""Plots on their grid: position, neighbours, one step of spreading."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions.keys import as_column, measure, with_values


def _on_border(value: Column, size: int) -> Column:
    return (value == 0) | (value == size - 1)


def plot_position(
    x="plot_x", y="plot_y", width: int = fixed.GRID_WIDTH, height: int = fixed.GRID_HEIGHT
) -> Column:
    """Whether a plot lies in a corner, on an edge or inside; null without both
    coordinates."""
    across, down = _on_border(as_column(x), width), _on_border(as_column(y), height)
    placed = as_column(x).isNotNull() & as_column(y).isNotNull()
    return F.when(across & down, "corner").when(placed & (across | down), "edge").when(placed, "interior")


def outbreak_ring(
    x="plot_x", y="plot_y", cx: int = fixed.OUTBREAK_X, cy: int = fixed.OUTBREAK_Y,
    width: int = fixed.GRID_WIDTH, height: int = fixed.GRID_HEIGHT,
) -> Column:
    """A plot's place relative to the outbreak: centre, one of its eight
    neighbours, a corner of the grid, or elsewhere."""
    px, py = as_column(x), as_column(y)
    far = F.greatest(F.abs(px - cx), F.abs(py - cy))
    corner = _on_border(px, width) & _on_border(py, height)
    placed = px.isNotNull() & py.isNotNull()
    return (
        F.when(placed & (far == 0), "centre")
        .when(placed & (far == 1), "neighbour")
        .when(placed & corner, "corner")
        .when(placed, "other")
    )


def neighbour_count(
    x="plot_x", y="plot_y", width: int = fixed.GRID_WIDTH, height: int = fixed.GRID_HEIGHT
) -> Column:
    """Number of the up to eight neighbours that lie on the grid."""

    def reach(value: Column, size: int) -> Column:
        return F.when(_on_border(value, size), 2).otherwise(3)

    return reach(as_column(x), width) * reach(as_column(y), height) - F.lit(1)


def spatial_gradient(df: DataFrame, keys: Sequence[str] = (), place: Column | None = None) -> DataFrame:
    """Mean loss by place on the grid; rows without a key are left out."""
    where = plot_position() if place is None else place
    return with_values(df, *keys).groupBy(*keys, where.alias("place")).agg(
        F.avg(measure("pest_loss_tha")).alias("mean_loss"), F.count(F.lit(1)).alias("n_rows")
    )


def _scatter(
    df: DataFrame, x: str, y: str, within: Sequence[str], own: Column, sent: Column, width: int, height: int
) -> DataFrame:
    """Every plot's own value on its own cell and its sent value on its neighbours'.

    One explode and no join: cells outside the grid are never produced, and a
    grouping on the cell brings a plot and all it receives together.
    """
    cells = F.array(
        *[
            F.struct(
                (F.col(x) + dx).alias("x"),
                (F.col(y) + dy).alias("y"),
                (own if dx == 0 and dy == 0 else F.lit(None).cast("double")).alias("own"),
                (F.lit(None).cast("double") if dx == 0 and dy == 0 else sent).alias("received"),
                F.lit(dx == 0 and dy == 0).alias("is_own"),
            )
            for dx in (-1, 0, 1)
            for dy in (-1, 0, 1)
        ]
    )
    spread = df.select(*within, F.explode(cells).alias("_c"))
    return spread.select(
        *within,
        F.col("_c.x").alias(x),
        F.col("_c.y").alias(y),
        F.col("_c.own").alias("own"),
        F.col("_c.received").alias("received"),
        F.col("_c.is_own").alias("is_own"),
    ).filter(F.col(x).between(0, width - 1) & F.col(y).between(0, height - 1))


#: How an aggregate of the parts of a neighbourhood gives that of the whole.
_WHOLE = {
    F.avg: (F.sum, lambda parts, n: F.when(n > 0, sum(F.coalesce(p, F.lit(0.0)) for p in parts) / n)),
    F.sum: (F.sum, lambda parts, n: F.when(n > 0, sum(F.coalesce(p, F.lit(0.0)) for p in parts))),
    F.max: (F.max, lambda parts, n: F.greatest(*parts)),
    F.min: (F.min, lambda parts, n: F.least(*parts)),
}


def neighbour_agg(
    df: DataFrame,
    value: str,
    within: Sequence[str] = ("run_id",),
    x: str = "plot_x",
    y: str = "plot_y",
    function: Callable[[str], Column] = F.avg,
    width: int = fixed.GRID_WIDTH,
    height: int = fixed.GRID_HEIGHT,
) -> DataFrame:
    """An aggregate (avg, sum, min or max) over the eight neighbours of every plot, grid
    not wrapped.

    Plots are unique within ``within``; neighbours the frame lacks do not count, and
    plots outside the grid are left out.  The grid is laid out as one line, column after
    column, with two empty places between columns; so the neighbours of a plot are four
    ranges of places, and one window pass takes all of them.  No row is copied.
    """
    if function not in _WHOLE:
        raise ValueError("neighbour_agg takes avg, sum, min or max")
    part, whole = _WHOLE[function]
    stride = height + 2
    rows = df.filter(F.col(x).between(0, width - 1) & F.col(y).between(0, height - 1)).select(
        *within, x, y, measure(value).alias(value), (F.col(x) * stride + F.col(y)).cast("long").alias("_place")
    )
    line = Window.partitionBy(*within).orderBy("_place")
    ranges = [(-stride - 1, -stride + 1), (-1, -1), (1, 1), (stride - 1, stride + 1)]
    frames = [line.rangeBetween(a, b) for a, b in ranges]
    found = rows.select(
        *within, x, y, value,
        *[part(value).over(f).alias(f"_part{i}") for i, f in enumerate(frames)],
        sum(F.count(value).over(f) for f in frames).alias("n_neighbours"),
    )
    parts = [F.col(f"_part{i}") for i in range(len(frames))]
    return found.select(*within, x, y, value, whole(parts, F.col("n_neighbours")).alias("neighbour_value"), "n_neighbours")


def diffuse(
    df: DataFrame,
    load: str = "pest_load",
    within: Sequence[str] = ("run_id",),
    x: str = "plot_x",
    y: str = "plot_y",
    share: float = fixed.DIFFUSION_SHARE,
    width: int = fixed.GRID_WIDTH,
    height: int = fixed.GRID_HEIGHT,
) -> DataFrame:
    """One synchronous step: every plot gives ``share`` of its load in equal
    parts to its neighbours; the result is at most 1.

    All plots read the same snapshot, so order does not matter.
    """
    given = F.col(load) * F.lit(share)
    each = given / neighbour_count(x, y, width, height)
    cells = _scatter(df, x, y, within, F.col(load) - given, each, width, height)
    return (
        cells.groupBy(*within, x, y)
        .agg(
            F.max("own").alias("_kept"),
            F.coalesce(F.sum("received"), F.lit(0.0)).alias("_received"),
            F.max("is_own").alias("_present"),
        )
        .filter("_present")
        .select(
            *within, x, y,
            F.col("_received").alias("received"),
            F.least(F.lit(1.0), F.col("_kept") + F.col("_received")).alias("load_after"),
        )
    )
