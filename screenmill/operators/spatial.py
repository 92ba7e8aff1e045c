"""Joins of project sites to environmental layers by place, and the layers' summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenmill.sources.io import written

EARTH_M = 6_371_000.0
#: Land capability classes.
PRIME = {"1": "Prime Farmland", "2": "Prime Farmland", "3": "Farmland of Statewide Importance"}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


#: Rows of a side of a cell that one task takes; and cells with more that are told by broadcast.
CELL_ROWS, BROADCAST_CELLS = 20_000, 200_000


def met_on(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left join right on the columns, of whose values one may have a third of all rows; those of both sides are dropped.

    Both sides are counted by value.  One with more than CELL_ROWS of a side is dealt to parts: its rows of one side to
    so many, each of which gets the other side's parts in turn, so a task has CELL_ROWS of both at most, by plan.
    """
    counts = [df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias(name)) for df, name in ((left, "_ls"), (right, "_rs"))]
    full = written(counts[0].join(counts[1], on).filter("_ls > 1 OR _rs > 1"), "full-cells")
    full = F.broadcast(full) if full.count() <= BROADCAST_CELLS else full

    def dealt(df: DataFrame, own: str, other: str, part: str, every: str) -> DataFrame:
        met = df.join(full, on, "left").withColumn(part, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(own)), F.lit(0)).cast("int"))
        return met.withColumn(every, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))).drop(own, other)

    keys = [*on, "_l", "_r"]
    return dealt(left, "_ls", "_rs", "_l", "_r").join(dealt(right, "_rs", "_ls", "_r", "_l"), keys).drop(*keys)


def met_in_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    return met_on(left, right, ["_x", "_y"])


def places(sites: DataFrame) -> DataFrame:
    """The different places of the sites, as sites whose project_id is the place: what is found there is found once."""
    at = F.struct(F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"))
    return _sites(sites).select("site_lat", "site_lon").distinct().select(at.alias("project_id"), F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"))


def for_sites(sites: DataFrame, found: DataFrame) -> DataFrame:
    """Rows found at places, whose project_id is the place, for each site there: project_id, site_lat, site_lon and the other columns."""
    rest = [c for c in found.columns if c not in ("project_id", "site_lat", "site_lon")]
    there = found.select(F.col("project_id.lat").alias("_lat"), F.col("project_id.lon").alias("_lon"), *rest)
    return met_on(_sites(sites).select("*", F.col("site_lat").alias("_lat"), F.col("site_lon").alias("_lon")), there, ["_lat", "_lon"])


def near_cells(sites: DataFrame, features: DataFrame, lat_reach: float, lon_reach: float) -> DataFrame:
    """Pairs in cells that a site's box touches: an equi-join on cells twice as wide as the reach, four at most for a site."""
    touched = lambda value, reach: F.explode(F.sequence(_cell(F.col(value) - reach * 1.0001, 2 * reach), _cell(F.col(value) + reach * 1.0001, 2 * reach)))
    left = sites.select("*", touched("site_lon", lon_reach).alias("_x")).select("*", touched("site_lat", lat_reach).alias("_y"))
    right = features.withColumn("_x", _cell(F.col("lon"), 2 * lon_reach)).withColumn("_y", _cell(F.col("lat"), 2 * lat_reach))
    return met_in_cells(left, right)


def _sites(sites: DataFrame) -> DataFrame:
    return sites.select("project_id", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon")).filter("site_lat IS NOT NULL AND site_lon IS NOT NULL")


def features_in_box(sites: DataFrame, features: DataFrame, half_deg: float = 0.009) -> DataFrame:
    pairs = near_cells(_sites(sites), features, half_deg, half_deg)
    return pairs.filter((F.abs(F.col("lat") - F.col("site_lat")) <= half_deg) & (F.abs(F.col("lon") - F.col("site_lon")) <= half_deg))


def features_within(sites: DataFrame, features: DataFrame, radius_m: float = 1000.0) -> DataFrame:
    """Pairs within the radius, with distance_m, at any latitude and across the date line.

    Rows of the grid are as high as the radius; a row has as many cells as keep each as wide as the radius reaches there,
    one around the poles.  A site is copied to the cells around it, an equi-join finds the candidates.
    """
    reach = radius_m / EARTH_M * 1.001
    height = math.degrees(reach)
    row_of = lambda lat: F.floor(lat / height).cast("long")

    def cells_in(row: Column) -> Column:
        # the farthest from the equator that a site or feature of this row or one beside it can be
        far = F.radians(F.greatest(F.abs(row - 1), F.abs(row + 2)) * height)
        width = F.degrees(F.asin(F.least(F.lit(math.sin(min(reach, math.pi / 2))) / F.greatest(F.cos(far), F.lit(1e-12)), F.lit(1.0))))
        return F.when(far + reach >= math.pi / 2, 1).otherwise(F.greatest(F.floor(360 / width), F.lit(1))).cast("long")

    cell_of = lambda lon, n: F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n)
    near = _sites(sites).select("*", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: row_of(F.col("site_lat")) + k)).alias("_y")).withColumn("_n", cells_in(F.col("_y")))
    around = F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.pmod(cell_of(F.col("site_lon"), F.col("_n")) + k, F.col("_n"))))
    left = near.select("*", F.explode(around).alias("_x")).drop("_n")
    right = features.withColumn("_y", row_of(F.col("lat"))).withColumn("_x", cell_of(F.col("lon"), cells_in(F.col("_y"))))
    pairs = met_in_cells(left, right)
    return pairs.withColumn("distance_m", haversine(F.col("site_lat"), F.col("site_lon"), F.col("lat"), F.col("lon"))).filter(F.col("distance_m") <= radius_m)


def air_baseline(sites: DataFrame, readings: DataFrame, as_of: str, days: int = 90, box: float = 0.3) -> DataFrame:
    """Per site and pollutant over the days up to yesterday: mean and largest valid reading, mean AQI, valid samples.

    Only readings flagged valid count for the means; the AQI averages over all that have one.
    """
    until = F.date_sub(F.lit(as_of).cast("date"), 1)
    recent = readings.filter(F.col("date").between(F.date_sub(until, days), until))
    valid = F.when((F.col("validity_indicator") == "Y"), F.col("arithmetic_mean"))
    # sums of each place's readings, then of those around each place with a site
    sums = (("total", F.sum(valid), F.sum), ("most", F.max(valid), F.max), ("samples", F.count(valid), F.sum), ("aqi", F.sum("aqi"), F.sum), ("n_aqi", F.count("aqi"), F.sum))
    spots = recent.groupBy("lat", "lon", "param").agg(*(own.alias(c) for c, own, _ in sums))
    near = features_in_box(places(sites), spots, box).groupBy("project_id", "param").agg(*(both(c).alias(c) for c, _, both in sums))
    made = near.select("project_id", "param", F.round(F.try_divide("total", "samples"), 2).alias("mean"), F.round("most", 2).alias("max"), F.round(F.try_divide("aqi", "n_aqi"), 1).alias("mean_aqi"), "samples")
    return for_sites(sites, written(made, "air")).drop("site_lat", "site_lon")


def forecast_means(forecasts: DataFrame) -> DataFrame:
    """Mean of the non-null values of each property."""
    rows = forecasts.select("site", "property", F.explode_outer("values").alias("v"))
    return rows.groupBy("site", "property").agg(F.round(F.avg("v.value"), 2).alias("mean"))


def feature_summary(pairs: DataFrame, kind: str) -> DataFrame:
    """Number, kinds and list of features per site."""
    return pairs.groupBy("project_id").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_set(kind)).alias("types"), F.sort_array(F.collect_list("feature_id")).alias("features"))


def summary_in_box(sites: DataFrame, features: DataFrame, kind: str, half_deg: float = 0.009) -> DataFrame:
    """What feature_summary gives of the features in the boxes around sites, for each place of sites once: for_sites tells the sites.

    Features at one place are lists from the start, so places meet places, however many sites and features lie there.
    """
    spots = features.groupBy("lat", "lon").agg(F.collect_set(kind).alias("types"), F.collect_list("feature_id").alias("features"), F.count(F.lit(1)).alias("count"))
    near = features_in_box(places(sites), spots, half_deg)
    lists = lambda c: F.flatten(F.collect_list(c))
    return near.groupBy("project_id").agg(F.sum("count").alias("count"), F.sort_array(F.array_distinct(lists("types"))).alias("types"), F.sort_array(lists("features")).alias("features"))


def summary_within(sites: DataFrame, features: DataFrame, kind: str, radius_m: float = 1000.0) -> DataFrame:
    """Features within the radius of each site: their number, number of kinds and the distance of the nearest, by places as well."""
    kinds = features.groupBy("lat", "lon", F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    spots = kinds.groupBy("lat", "lon").agg(F.collect_list(F.struct("kind", "n")).alias("kinds"))
    near = features_within(places(sites), spots, radius_m).select("project_id", "distance_m", F.explode("kinds").alias("k"))
    by_kind = near.groupBy("project_id", "k.kind").agg(F.sum("k.n").alias("n"), F.min("distance_m").alias("nearest"))
    made = by_kind.groupBy("project_id").agg(F.sum("n").alias("n"), F.count("kind").alias("n_kinds"), F.min("nearest").alias("nearest"))
    return for_sites(sites, written(made, "within")).drop("site_lat", "site_lon")


def species_name(common: Column, short: Column) -> Column:
    return F.coalesce(F.nullif(common, F.lit("")), F.nullif(short, F.lit("")), F.lit("Unknown"))


def crossings(x: Column, y: Column, edges: Column) -> Column:
    """Whether a ray from the point crosses an odd number of the edges (array of struct(ax, ay, bx, by)): it is inside."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1


#: The largest cell is this many times doubled from the smallest: it holds the whole earth.
LEVELS = 14
#: Edges that a slab has on average, and copies of an edge over slabs at most, on average.
SLAB_EDGES, EDGE_COPIES = 32, 4


def edges_of(ring: Column) -> Column:
    """The edges of a ring (array of struct(x, y)) that aren't level; a ring is closed whether its last point repeats the first or not."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    pairs = F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return F.filter(pairs, lambda e: e["ay"] != e["by"])


def slab_of(y: Column) -> Column:
    """The slab that a height falls in; it never falls as the height rises, so an edge is in all slabs between its ends'."""
    return F.greatest(F.lit(0), F.least(F.col("_slabs") - 1, F.floor((y - F.col("_low")) / F.col("_tall") * F.col("_slabs")))).cast("int")


def places_in_shapes(sites: DataFrame, polygons: DataFrame, cell: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Pairs (project_id, the place, and _shape) of places of sites and shapes around them; and the polygons by _shape, without rings.

    Polygons with the same rings are one shape, told by SHA-256, and sites with the same coordinates one place, so what is
    compared are different things only.  Boxes are found first: a shape goes to the grid whose cells are as large as its
    box, so it is copied four times at most, and a place is looked up in each grid that there are shapes in.  Then a
    shape's edges are cut into slabs by height, and a place meets the edges of its slab alone: about SLAB_EDGES, however
    many the shape has, unless its edges are mostly as high as itself.
    """
    many = "rings" in polygons.columns
    rings = F.col("rings") if many else F.array("ring")
    own = polygons.withColumn("_rings", F.filter(rings, lambda r: F.size(r) > 2)).drop("rings" if many else "ring")
    own = own.select("*", F.sha2(F.col("_rings").cast("string"), 256).alias("_shape"), F.monotonically_increasing_id().alias("_polygon"))
    own = written(own, "polygons").filter("size(_rings) > 0")  # after the table: else rings are made once more for the filter
    firsts = written(own.groupBy("_shape").agg(F.min("_polygon").alias("_polygon")), "shapes")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_CELLS else firsts
    shapes = own.select("_shape", "_polygon", "_rings").join(firsts, ["_shape", "_polygon"]).drop("_polygon")
    points = F.flatten("_rings")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    edges = F.flatten(F.transform("_rings", edges_of))
    rise = F.aggregate("_edges", F.lit(0.0), lambda n, e: n + F.abs(e["by"] - e["ay"]))
    boxed = shapes.withColumns({"_left": F.array_min(xs), "_right": F.array_max(xs), "_low": F.array_min(ys), "_high": F.array_max(ys), "_edges": edges}).drop("_rings")
    boxed = boxed.withColumn("_tall", F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-12)))
    # an edge is copied to as many slabs as it is high: on average EDGE_COPIES at most
    most = (EDGE_COPIES - 1) * F.size("_edges") * F.col("_tall") / F.greatest(rise, F.lit(1e-12))
    boxed = boxed.withColumn("_slabs", F.greatest(F.lit(1), F.least(F.ceil(F.size("_edges") / SLAB_EDGES), F.floor(most))).cast("int"))
    boxed = written(boxed, "shape-edges")

    size = lambda level: F.lit(cell) * F.pow(F.lit(2.0), level)
    at = lambda v, level: F.floor(v / size(level)).cast("long")
    extent = F.greatest(F.col("_right") - F.col("_left"), F.col("_high") - F.col("_low"))
    level = F.least(F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)) / cell)), F.lit(0)), F.lit(LEVELS)).cast("int")
    every = lambda low, high: F.explode(F.sequence(at(F.col(low), F.col("_level")), at(F.col(high), F.col("_level"))))
    boxes = boxed.drop("_edges").withColumn("_level", level)
    used = sorted(r["_level"] for r in boxes.select("_level").distinct().collect())  # LEVELS + 1 numbers at most
    right = boxes.select("*", every("_left", "_right").alias("_x")).select("*", every("_low", "_high").alias("_y"))
    left = _sites(places(sites)).select("*", F.explode(F.array(*map(F.lit, used)).cast("array<int>")).alias("_level"))
    left = left.withColumn("_x", at(F.col("site_lon"), F.col("_level"))).withColumn("_y", at(F.col("site_lat"), F.col("_level")))
    inside = F.col("site_lon").between(F.col("_left"), F.col("_right")) & F.col("site_lat").between(F.col("_low"), F.col("_high"))
    near = left.join(right, ["_level", "_x", "_y"]).filter(inside).withColumn("_slab", slab_of(F.col("site_lat")))

    cut = boxed.select("_shape", "_low", "_tall", "_slabs", F.explode("_edges").alias("e"))
    ends = slab_of(F.least("e.ay", "e.by")), slab_of(F.greatest("e.ay", "e.by"))
    slabs = cut.select("_shape", F.explode(F.sequence(*ends)).alias("_slab"), "e").groupBy("_shape", "_slab").agg(F.collect_list("e").alias("_near"))
    hit = near.join(slabs, ["_shape", "_slab"]).filter(crossings(F.col("site_lon"), F.col("site_lat"), F.col("_near")))
    return written(hit.select("project_id", "_shape"), "places-in-shapes"), own.drop("_rings", "_polygon")


def sites_in_polygons(sites: DataFrame, polygons: DataFrame, cell: float = 0.05) -> DataFrame:
    """Pairs of sites and polygons around them, with the polygons' other columns.

    A polygon has a `ring` (array of struct(x, y)) or `rings` (array of such): what lies in an odd number of rings is
    inside, so rings within a ring are holes, and rings beside it further parts.  Rings with fewer than three points and
    null ones count as none; rings aren't returned.  Places are compared with shapes, then each place's sites meet the
    polygons of its shapes.
    """
    hit, members = places_in_shapes(sites, polygons, cell)
    return for_sites(sites, written(met_on(hit, members, ["_shape"]), "polygons-at-places"))


def flood_status(sites: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones of each site and whether any is a special flood hazard area; sites outside all have none."""
    hit, members = places_in_shapes(sites, zones)
    kinds = members.groupBy("_shape", "fld_zone").agg(F.bool_or(F.col("sfha_tf") == "T").alias("in_sfha"))
    at = hit.join(kinds, "_shape").groupBy("project_id").agg(F.bool_or("in_sfha").alias("in_sfha"), F.collect_set("fld_zone").alias("zones"))
    found = for_sites(sites, written(at, "flood")).groupBy("project_id").agg(F.bool_or("in_sfha").alias("in_sfha"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("zones")))).alias("zones"))
    return sites.select("project_id").join(found, "project_id", "left").select("project_id", F.coalesce("in_sfha", F.lit(False)).alias("in_sfha"), F.coalesce("zones", F.array().cast("array<string>")).alias("zones"))


def dominant_soil(sites: DataFrame, mapunits: DataFrame, components: DataFrame) -> DataFrame:
    """The largest major component of the soil unit under each site, its farmland class and whether it is prime.

    Of components of one size and name that with the smallest key (cokey) counts.
    """
    largest = F.struct("comppct_r", "compname", -F.col("cokey").cast("long"))
    top = components.filter("majcompflag = 'Yes'").groupBy("mukey").agg(F.max_by(F.struct("compname", "nirrcapcl", "comppct_r"), largest).alias("c")).select("mukey", "c.*")
    label = F.coalesce(*(F.when(F.col("nirrcapcl") == k, v) for k, v in PRIME.items()), F.lit("Not prime farmland"))
    known = mapunits.join(top.select("mukey", "compname", "nirrcapcl", label.alias("farmland_class"), F.coalesce(F.col("nirrcapcl").isin("1", "2"), F.lit(False)).alias("is_prime")), "mukey")
    return sites_in_polygons(sites, known).select("project_id", "mukey", "compname", "nirrcapcl", "farmland_class", "is_prime")


def demographics(sites: DataFrame, tracts: DataFrame, acs: DataFrame) -> DataFrame:
    """Shares of minority and poverty in the tract of each site; null where the total is 0."""
    share = lambda part, total: F.when(F.col(total) > 0, F.round(part / F.col(total), 4))
    key = ["state", "county", "tract"]
    shares = acs.select(*key, share(F.col("race_total") - F.col("white_nh"), "race_total").alias("minority_share"), share(F.col("below_poverty"), "poverty_total").alias("poverty_share"))
    known = tracts.select(*key, "ring" if "ring" in tracts.columns else "rings").join(shares, key, "left")
    return sites_in_polygons(sites, known).select("project_id", *key, "minority_share", "poverty_share")
