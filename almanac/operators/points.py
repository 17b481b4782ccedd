"""Extracts at points from a grid: the cell nearest to each station.

Cells and stations are cut into bins of latitude and longitude, and each station looks into the bins
that hold any place within its reach, across the date line and around a pole if need be. So the
join is one on equal bins, and its work follows the cells near stations, not all pairs.

Bins are about as wide as they are high, so a station looks into some 25, and not into many more near
a pole. Spark judges these rows by the few stations they come from, so it is told to shuffle them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.spread import spread

#: Mean radius of the earth in km, and the length of a degree along a meridian.
EARTH_KM = 6371.0088
DEGREE_KM = 111.195079735
#: Size of a bin in degrees at least.
LEAST_BIN = 0.25
#: Degrees of longitude that a station looks further than it has to, for what is lost to rounding.
SLACK = 1e-6


def distance_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Along the great circle, by the haversine, which is exact for short distances."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    half = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(
        F.sin(F.radians(lon_a - lon_b) / 2), 2
    )
    return F.asin(F.sqrt(F.least(half, F.lit(1.0)))) * (2 * EARTH_KM)


def _turned(lon: Column) -> Column:
    """A longitude from 0 to 360; extracts count either way."""
    return F.pmod(lon, F.lit(360.0))


def nearest_cells(
    stations: DataFrame, cells: DataFrame, reach_km: float, cell_id: str = "cell"
) -> DataFrame:
    """``(STATION, cell, distance_km)`` for ``stations`` (``STATION``, ``lat``, ``lon``) and ``cells``
    (the id, ``lat``, ``lon``): the nearest cell within reach, of equally near ones that with the
    smallest id. Stations without one have no row, and neither have those without a place. Repeated
    cells are one; a station that is listed at several places gets the nearest cell of any.
    """
    if not reach_km > 0:
        raise ValueError("the reach has to be above zero")
    size = max(LEAST_BIN, reach_km / DEGREE_KM / 2)
    degrees = reach_km / DEGREE_KM + 1e-9
    # How many bins go around in each row, the fewer the nearer to a pole.
    middles = (math.radians((i + 0.5) * size - 90) for i in range(int(180 / size) + 1))
    around = F.get(F.lit([max(1, int(360 / size * math.cos(middle))) for middle in middles]), F.col("_row"))
    row = lambda lat: F.floor((lat + 90) / size).cast("int")
    column = lambda lon: F.floor(lon * around / 360)
    grid = cells.where(F.col("lat").between(-90, 90) & F.col("lon").isNotNull()).select(
        F.col(cell_id).alias("_cell"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), row(F.col("lat")).alias("_row")
    ).withColumn("_column", F.least(column(_turned(F.col("_lon"))), around - 1).cast("int"))
    # A task that reads a small file would make all the rows that its stations become.
    placed = stations.where(
        F.col("STATION").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").isNotNull()
    ).select("STATION", "lat", "lon").repartition("STATION")
    rows = F.sequence(row(F.greatest(F.col("lat") - degrees, F.lit(-90.0))), row(F.least(F.col("lat") + degrees, F.lit(90.0))))
    # How far a circle on the sphere reaches east and west; around a pole it has all longitudes.
    top = F.abs("lat") + degrees
    wide = SLACK + F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(degrees))) / F.cos(F.radians("lat")))))
    low, high = column(F.col("lon") - wide), column(F.col("lon") + wide)
    everywhere = (top >= 90) | (high - low >= around - 1)
    columns = F.sequence(F.when(everywhere, F.lit(0)).otherwise(low), F.when(everywhere, around - 1).otherwise(high))
    looked = placed.select("*", F.explode(rows).alias("_row"))
    looked = looked.select("*", around.alias("_around"), F.explode(columns).alias("_column"))
    looked = looked.select("STATION", "lat", "lon", "_row", F.pmod("_column", "_around").cast("int").alias("_column"))
    near = spread(looked, "_row", "_column").hint("merge").join(grid, ["_row", "_column"]).select(
        "STATION", "_cell", distance_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("km")
    )
    best = near.where(F.col("km") <= reach_km).groupBy("STATION").agg(
        F.min(F.struct("km", "_cell")).alias("best")
    )
    return best.select("STATION", F.col("best._cell").alias(cell_id), F.col("best.km").alias("distance_km"))


def extract_points(values: DataFrame, matches: DataFrame, cell_id: str = "cell") -> DataFrame:
    """The values of each station's cell, under the station's name. A cell may serve many stations.
    Values of all other cells are left out before anything else is done with them. Both are shuffled:
    Spark judges values by their packed files, which can be small."""
    return values.hint("merge").join(matches.select("STATION", cell_id), cell_id).drop(cell_id)
