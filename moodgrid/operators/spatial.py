"""Point in polygon, centroids and grid cells, without a geometry library.

A polygon is a row with an id and ``ring``: array<struct<x, y>> in ring order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodgrid.operators.joins import lookup_join
from moodgrid.session import cut_lineage


def _next_vertex(ring: Column, i: Column) -> Column:
    return F.element_at(ring, F.when(i == F.size(ring), F.lit(1)).otherwise(i + 1))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting. Left and lower borders count as inside, right and
    upper ones as outside, so tiles that share a border never match twice."""

    def crosses(i: Column) -> Column:
        a = F.element_at(ring, i)
        b = _next_vertex(ring, i)
        ax, ay, bx, by = a.getField("x"), a.getField("y"), b.getField("x"), b.getField("y")
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)

    hits = F.size(F.filter(F.sequence(F.lit(1), F.size(ring)), crosses))
    return hits % 2 == 1


def centroid(ring: Column) -> Column:
    """Area centroid (shoelace) as struct<x, y>."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, i: Column) -> Column:
        p, q = F.element_at(ring, i), _next_vertex(ring, i)
        cross = p.getField("x") * q.getField("y") - q.getField("x") * p.getField("y")
        return F.struct(
            (acc.getField("a") + cross).alias("a"),
            (acc.getField("x") + (p.getField("x") + q.getField("x")) * cross).alias("x"),
            (acc.getField("y") + (p.getField("y") + q.getField("y")) * cross).alias("y"),
        )

    def finish(acc: Column) -> Column:
        area3 = F.lit(3.0) * acc.getField("a")
        return F.struct((acc.getField("x") / area3).alias("x"), (acc.getField("y") / area3).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.size(ring)), start, add, finish)


def cell_of(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def point_in_polygon(
    points: DataFrame,
    polygons: DataFrame,
    x: str = "lon",
    y: str = "lat",
    how: str = "inner",
    cell: float = 0.5,
    ids: Sequence[str] | None = None,
    match: Sequence[str] = (),
) -> DataFrame:
    """Attach the columns of the polygon that holds each point.

    Each polygon is listed under the grid cells of its bounding box; points
    meet it by an equi-join on the cell and are then tested exactly. ``ids``
    identify a point: they spread the points of a hot cell and, in a left
    join, find the points that matched nothing. ``match`` names columns of both
    sides that must agree as well, such as the vintage of a boundary.
    """
    ring = F.col("ring")
    xs, ys = F.transform(ring, lambda p: p.getField("x")), F.transform(ring, lambda p: p.getField("y"))
    covered = polygons.withColumn(
        "__cx", F.explode(F.sequence(cell_of(F.array_min(xs), cell), cell_of(F.array_max(xs), cell)))
    ).withColumn("__cy", F.explode(F.sequence(cell_of(F.array_min(ys), cell), cell_of(F.array_max(ys), cell))))
    keyed = points.withColumn("__cx", cell_of(F.col(x), cell)).withColumn("__cy", cell_of(F.col(y), cell))
    attributes = [c for c in polygons.columns if c != "ring" and c not in match]
    matched = (
        lookup_join(keyed, covered, ["__cx", "__cy", *match], "inner", ids)
        .filter(contains(ring, F.col(x), F.col(y)))
        .select(*points.columns, *attributes)
    )
    if how == "inner":
        return matched
    if not ids:
        raise ValueError("a left join needs the columns that identify a point")
    matched = cut_lineage(matched)  # used twice below
    types = dict(polygons.dtypes)
    unmatched = points.join(matched.select(*ids), list(ids), "left_anti").select(
        *points.columns, *(F.lit(None).cast(types[c]).alias(c) for c in attributes)
    )
    return matched.unionByName(unmatched)


def centroid_within(
    polygons: DataFrame, regions: DataFrame, ids: Sequence[str], how: str = "left", cell: float = 1.0
) -> DataFrame:
    """Attach the region that holds each polygon's centroid."""
    located = polygons.withColumn("__c", centroid(F.col("ring"))).select(
        *(c for c in polygons.columns if c != "ring"),
        F.col("__c.x").alias("cx"),
        F.col("__c.y").alias("cy"),
    )
    return point_in_polygon(located, regions, "cx", "cy", how, cell, ids)


def inside_flag(
    polygons: DataFrame, regions: DataFrame, ids: Sequence[str], name: str, cell: float = 1.0
) -> DataFrame:
    """0/1: whether a polygon's centroid lies in any of the regions."""
    tagged = centroid_within(polygons, regions.withColumn(name, F.lit(1)).select("ring", name), ids, "left", cell)
    keep = [c for c in polygons.columns if c != "ring"]
    return tagged.groupBy(*keep).agg(F.coalesce(F.max(name), F.lit(0)).alias(name))


def grid_lookup(
    points: DataFrame,
    grid: DataFrame,
    time: str,
    resolution: float,
    lon0: float,
    lat0: float,
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """Values of the grid cell and UTC hour of each point.

    ``grid`` has ``hour``, ``row``, ``col`` and value columns, one row per cell
    and hour; a point without a cell keeps nulls.
    """
    keyed = (
        points.withColumn("hour", F.date_trunc("hour", F.col(time)).cast("timestamp_ntz"))
        .withColumn("row", F.floor((F.col(lat) - F.lit(lat0)) / F.lit(resolution)).cast("long"))
        .withColumn("col", F.floor((F.col(lon) - F.lit(lon0)) / F.lit(resolution)).cast("long"))
    )
    return keyed.join(grid, ["hour", "row", "col"], "left")


def daily_grid_lookup(
    points: DataFrame, grid: DataFrame, time: str, resolution: float, lon0: float, lat0: float, values: Sequence[str]
) -> DataFrame:
    """Values, to two digits, of the daily cell; the day ends at 12 UTC."""
    from moodgrid.functions.clock import day_after_noon

    keyed = (
        points.withColumn("day", day_after_noon(F.col(time)))
        .withColumn("row", F.floor((F.col("lat") - F.lit(lat0)) / F.lit(resolution)).cast("long"))
        .withColumn("col", F.floor((F.col("lon") - F.lit(lon0)) / F.lit(resolution)).cast("long"))
    )
    rounded = grid.select("day", "row", "col", *(F.round(v, 2).alias(v) for v in values))
    return keyed.join(rounded, ["day", "row", "col"], "left")


def vintage_lookup(
    points: DataFrame,
    raster: DataFrame,
    year: Column,
    x0: float,
    y0: float,
    dx: float,
    dy: float,
    switch: int = 2014,
    vintages: tuple[int, int] = (2011, 2016),
) -> DataFrame:
    """Pixel of the older raster before ``switch``, of the newer one from it on.

    ``points`` carry projected ``x`` and ``y``; pixel indices truncate toward
    zero, ``raster`` has ``vintage``, ``row``, ``col`` and value columns.
    """
    keyed = (
        points.withColumn("vintage", F.when(year < switch, F.lit(vintages[0])).otherwise(F.lit(vintages[1])))
        .withColumn("col", ((F.col("x") - F.lit(x0)) / F.lit(dx)).cast("long"))
        .withColumn("row", ((F.col("y") - F.lit(y0)) / F.lit(dy)).cast("long"))
    )
    return keyed.join(raster, ["vintage", "row", "col"], "left")


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)
