"""Regular lat/lon grids and the column expressions that address them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0


@dataclass(frozen=True)
class Grid:
    """Rows run north to south, columns west to east; cells are ``deg`` wide."""

    grid_id: str
    deg: float
    nlat: int
    nlon: int
    tile_size: int = 64
    lat_max: float = 90.0
    lon_min: float = -180.0

    @property
    def tile_counts(self) -> tuple[int, int]:
        return -(-self.nlat // self.tile_size), -(-self.nlon // self.tile_size)


def global_grid(deg: float, tile_size: int = 64) -> Grid:
    """The whole-globe grid of a resolution, e.g. 0.25 -> 720 x 1440 cells."""
    nlat = round(180 / deg)
    return Grid(f"global_{deg:g}".replace(".", "p"), deg, nlat, 2 * nlat, tile_size)


COARSE = global_grid(0.25)
FINE = global_grid(0.05)


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def _clamp(index: Column, n: int) -> Column:
    return F.when(
        index.isNotNull(), F.least(F.greatest(index, F.lit(0)), F.lit(n - 1))
    ).cast("int")


def row_of(lat: Column, grid: Grid) -> Column:
    """Row of the containing cell; the poles belong to the outermost rows."""
    edge = grid.lat_max - 1e-12
    inside = F.when(lat.isNotNull(), F.greatest(F.lit(-edge), F.least(F.lit(edge), lat)))
    return _clamp(F.floor((F.lit(grid.lat_max) - inside) / F.lit(grid.deg)), grid.nlat)


def col_of(lon: Column, grid: Grid) -> Column:
    return _clamp(F.floor((wrap_lon(lon) - F.lit(grid.lon_min)) / F.lit(grid.deg)), grid.nlon)


def cell_of(lat: Column, lon: Column, grid: Grid) -> dict[str, Column]:
    """Columns ``i_lat``/``i_lon`` of the cell that contains a point."""
    return {"i_lat": row_of(lat, grid), "i_lon": col_of(lon, grid)}


def tile_of(grid: Grid, i_lat="i_lat", i_lon="i_lon") -> dict[str, Column]:
    n = F.lit(grid.tile_size)
    r, c = F.col(i_lat), F.col(i_lon)
    return {
        "tile_r": F.floor(r / n).cast("int"),
        "tile_c": F.floor(c / n).cast("int"),
        "o_lat": (r % n).cast("int"),
        "o_lon": (c % n).cast("int"),
    }


def center_lat(i_lat: Column, grid: Grid) -> Column:
    return F.lit(grid.lat_max) - (i_lat.cast("double") + F.lit(0.5)) * F.lit(grid.deg)


def center_lon(i_lon: Column, grid: Grid) -> Column:
    return F.lit(grid.lon_min) + (i_lon.cast("double") + F.lit(0.5)) * F.lit(grid.deg)


def bbox_of(grid: Grid, i_lat="i_lat", i_lon="i_lon") -> dict[str, Column]:
    lat, lon, half = center_lat(F.col(i_lat), grid), center_lon(F.col(i_lon), grid), grid.deg / 2
    return {
        "lat": lat,
        "lon": lon,
        "lat_min": lat - half,
        "lat_max": lat + half,
        "lon_min": lon - half,
        "lon_max": lon + half,
    }


def area_weight(i_lat: Column, grid: Grid) -> Column:
    """Relative cell area: the cosine of the centre latitude."""
    return F.cos(F.radians(center_lat(i_lat, grid)))


def snap_round(value: Column, res: float) -> Column:
    """Nearest multiple of ``res``, halves to even."""
    return F.rint(value / F.lit(res)) * F.lit(res)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_bbox(lat: Column, lon: Column, west, south, east, north) -> Column:
    """Point in a box; ``west > east`` means the box crosses the dateline."""
    across = (lon >= west) | (lon <= east) if west > east else (lon >= west) & (lon <= east)
    return lat.between(south, north) & across
