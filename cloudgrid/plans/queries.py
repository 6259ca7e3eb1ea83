"""Queries over clouds of the star-schema tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.box import Box, sort_boxes
from ..functions.points import add, cast_dimensions, component, divide, multiply, subtract
from ..operators import geometry, index, partition
from ..operators.cloud import PointCloud
from ..operators.grid import Grid
from ..sources.views import embeddings_cloud, events_cloud, lineitem_cloud

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
GRID = Grid(5000.0, 10.0, 365.0, 0.125)
BOX = "20000,10,9500,0,40000,20,10500,0.1"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_ROLL = "(('0x' || substr(md5({k}), 1, 6))::BIGINT / 16777216.0::DOUBLE)::FLOAT"
_KEY = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
_PC = f"""pc AS (SELECT {_ROLL.format(k=_KEY)} AS i, l_extendedprice AS x, l_quantity AS y,
  date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS z, * FROM lineitem)"""
_EV = f"""ev AS (SELECT {_ROLL.format(k="event_id::VARCHAR")} AS i, user_id::DOUBLE AS x, value AS y,
  (epoch_us(ts) / 1000000.0 - 1704067200)::DOUBLE AS z, event_id, event_type FROM events)"""
_EM = f"""em AS (SELECT {_ROLL.format(k="vec_id::VARCHAR")} AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, vec_id, label FROM embeddings)"""
_CELLS = "floor(x / 5000.0::DOUBLE)::BIGINT AS cx, floor(y / 10.0::DOUBLE)::BIGINT AS cy, floor(z / 365.0::DOUBLE)::BIGINT AS cz, floor(i::DOUBLE / 0.125::DOUBLE)::BIGINT AS ci"
_STATS = f"""st AS (SELECT cx, cy, cz, ci, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z,
  min(i)::DOUBLE AS lo_i, max(i)::DOUBLE AS hi_i, count(*) AS n_points FROM (SELECT *, {_CELLS} FROM pc) GROUP BY ALL)"""
_ID = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_IN_BOX = "x >= 20000 AND x < 40000 AND y >= 10 AND y < 20 AND z >= 9500 AND z < 10500"


def query(sql: str | None):
    def add_query(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add_query


def _cloud(spark: SparkSession, sf_dir: str) -> PointCloud:
    return PointCloud(lineitem_cloud(spark, sf_dir))


def _gridded(spark: SparkSession, sf_dir: str) -> PointCloud:
    return _cloud(spark, sf_dir).with_grid(GRID)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each customer segment and nation: bounds of account and key."""
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    aggs = [f(F.col(c).cast("double")).alias(p + a) for a, c in (("x", "c_acctbal"), ("y", "c_custkey")) for f, p in ((F.min, "lo_"), (F.max, "hi_"))]
    return t.groupBy("c_nationkey", "c_mktsegment").agg(*aggs)


_BOXES = "bx AS (SELECT c_nationkey, c_mktsegment, min(c_acctbal) AS lo_x, max(c_acctbal) AS hi_x, min(c_custkey)::DOUBLE AS lo_y, max(c_custkey)::DOUBLE AS hi_y FROM customer GROUP BY ALL)"
_BID = ["c_nationkey", "c_mktsegment"]


@query(f"WITH {_PC} SELECT {_ID}, x, y, z, i FROM pc WHERE {_IN_BOX} AND i >= 0 AND i < 0.1::FLOAT")
def box_4d(spark, sf_dir):
    """Space and importance together: the flagship."""
    return _cloud(spark, sf_dir).query(BOX).select(*KEYS, "x", "y", "z", "i")


@query(f"WITH {_PC} SELECT {_ID}, x, y, z FROM pc WHERE {_IN_BOX}")
def box_3d(spark, sf_dir):
    return _cloud(spark, sf_dir).query("20000,10,9500,40000,20,10500").select(*KEYS, "x", "y", "z")


@query(f"WITH {_PC} SELECT {_ID}, x, y FROM pc WHERE x >= 20000 AND x < 40000 AND y >= 10 AND y < 20")
def box_2d(spark, sf_dir):
    """Missing dimensions are unbounded."""
    return _cloud(spark, sf_dir).query("20000,10,40000,20").select(*KEYS, "x", "y")


@query(f"WITH {_PC} SELECT {_ID}, i FROM pc WHERE i >= 0.5::FLOAT AND i < 1 AND x < 50000 AND x >= 0 AND y >= 0 AND y < 60 AND z >= 0 AND z < 20000")
def box_4d_slice(spark, sf_dir):
    """Another sample: a slice of importance that doesn't start at 0."""
    return _cloud(spark, sf_dir).query("0,0,0,0.5,50000,60,20000,1").select(*KEYS, "i")


@query(f"WITH {_PC} SELECT {_ID}, x FROM pc WHERE x >= 5 AND x < 5")
def box_empty(spark, sf_dir):
    return _cloud(spark, sf_dir).query("5,5").select(*KEYS, "x")


@query(f"WITH {_PC} SELECT {_ID}, i FROM pc WHERE {_IN_BOX} ORDER BY i, l_orderkey, l_linenumber LIMIT 50")
def box_budget(spark, sf_dir):
    """At most so many points of a box: those of least importance."""
    found = _cloud(spark, sf_dir).query("20000,10,9500,40000,20,10500")
    return found.orderBy("i", "l_orderkey", "l_linenumber").limit(50).select(*KEYS, "i")


@query(f"WITH {_EV} SELECT event_id, x, y, z, i FROM ev WHERE y >= 100 AND y < 200 AND i < 0.25::FLOAT")
def box_events(spark, sf_dir):
    cloud = PointCloud(events_cloud(spark, sf_dir))
    return cloud.filter_box(Box((-math.inf, 100.0, -math.inf, 0.0), (math.inf, 200.0, math.inf, 0.25))).df.select("event_id", "x", "y", "z", "i")


@query(f"WITH {_PC} SELECT {_ID}, x >= 20000 AND x <= 40000 AND y >= 10 AND y <= 20 AND z >= 9500 AND z <= 10500 AS inside FROM pc")
def point_in_box(spark, sf_dir):
    """Both faces count."""
    cloud = _cloud(spark, sf_dir)
    return cloud.df.select(*KEYS, cloud.contains(Box((20000.0, 10.0, 9500.0), (40000.0, 20.0, 10500.0))).alias("inside"))


@query(f"WITH {_PC} SELECT {_ID}, i FROM pc WHERE i < 0.01::FLOAT")
def sample_p(spark, sf_dir):
    return _cloud(spark, sf_dir).sample(0.01).select(*KEYS, "i")


@query(f"WITH {_PC} SELECT p, count(*) AS n FROM pc, (SELECT unnest([0.01, 0.1, 0.7, 1.0])::DOUBLE AS p) WHERE i < p::FLOAT GROUP BY p")
def sample_nested(spark, sf_dir):
    """Sizes of growing samples, each within the next, in one pass."""
    cloud = _cloud(spark, sf_dir)
    p = F.explode(F.array(*map(F.lit, (0.01, 0.1, 0.7, 1.0)))).alias("p")
    return cloud.df.select("i", p).where(F.col("i") < F.col("p").cast("float")).groupBy("p").agg(F.count("*").alias("n"))


@query(f"WITH {_PC} SELECT count(*) AS n_points FROM pc")
def num_points(spark, sf_dir):
    return _cloud(spark, sf_dir).df.agg(F.count("*").alias("n_points"))


@query(f"""WITH {_PC} SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z,
  min(i)::DOUBLE AS lo_i, max(i)::DOUBLE AS hi_i, count(*) AS n_points FROM pc""")
def bounds(spark, sf_dir):
    return _cloud(spark, sf_dir).bounds_frame()


@query(f"WITH {_PC}, {_STATS} SELECT * FROM st")
def bounds_by_cell(spark, sf_dir):
    """The block index."""
    return index.build(_gridded(spark, sf_dir))


@query(f"WITH {_PC} SELECT x, y, z, i FROM pc")
def project_dims(spark, sf_dir):
    return _cloud(spark, sf_dir).project()


@query(f"WITH {_PC} SELECT trunc(x)::INTEGER AS x, trunc(y)::INTEGER AS y, trunc(z)::INTEGER AS z, trunc(i)::INTEGER AS i FROM pc")
def cast_dims_int(spark, sf_dir):
    return _cloud(spark, sf_dir).points("int")


@query(f"WITH {_EM} SELECT x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z, 0::FLOAT AS i FROM em")
def cast_dims_zero_fill(spark, sf_dir):
    """Three dimensions as four: the missing one is 0."""
    return cast_dimensions(embeddings_cloud(spark, sf_dir), ["x", "y", "z"], "float", 4)


@query("SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS s, l_partkey * l_suppkey AS m, l_partkey // l_suppkey AS d FROM lineitem WHERE l_suppkey > 0")
def point_arith(spark, sf_dir):
    """Integers, whose quotient is cut towards zero."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey > 0")
    p, q = [F.col("l_partkey")], [F.col("l_suppkey")]
    return t.select("l_orderkey", "l_linenumber", add(p, q)[0].alias("a"), subtract(p, q)[0].alias("s"), multiply(p, q)[0].alias("m"), divide(p, q, whole=True)[0].alias("d"))


@query(f"WITH {_EM} SELECT vec_id, x, y, z, 0 AS i FROM em")
def point_accessors(spark, sf_dir):
    df = embeddings_cloud(spark, sf_dir)
    return df.select("vec_id", *(component(df, ["x", "y", "z"], k).alias(n) for k, n in enumerate("xyzi")))


@query(f"WITH {_PC} SELECT {_ID}, {_CELLS} FROM pc")
def cell_assign(spark, sf_dir):
    return _gridded(spark, sf_dir).df.select(*KEYS, *GRID.cell_columns())


@query(f"WITH {_PC} SELECT cx, cy, cz, ci, count(*) AS n FROM (SELECT {_CELLS} FROM pc) GROUP BY ALL")
def cell_histogram(spark, sf_dir):
    return _gridded(spark, sf_dir).df.groupBy(*GRID.cell_columns()).agg(F.count("*").alias("n"))


@query(f"""WITH {_PC} SELECT DISTINCT printf('%.9f-%.9f-%.9f-%.9f', cx * 5000.0::DOUBLE, cy * 10.0::DOUBLE, cz * 365.0::DOUBLE, ci * 0.125::DOUBLE) AS cell FROM (SELECT {_CELLS} FROM pc)""")
def cell_id(spark, sf_dir):
    return _gridded(spark, sf_dir).df.select(*GRID.cell_columns()).distinct().select(GRID.cell_id().alias("cell"))


@query(f"""WITH {_BOXES} SELECT c_nationkey, c_mktsegment, cx, cy FROM (SELECT *, unnest(range(floor(lo_x / 2000.0::DOUBLE)::BIGINT, ceil(hi_x / 2000.0::DOUBLE)::BIGINT)) AS cx FROM bx) AS a,
  LATERAL (SELECT unnest(range(floor(a.lo_y / 500.0::DOUBLE)::BIGINT, ceil(a.hi_y / 500.0::DOUBLE)::BIGINT)) AS cy)""")
def grid_cells(spark, sf_dir):
    """All cells of boxes: from floor(low / step) to below ceil(high / step)."""
    return Grid(2000.0, 500.0).cell_boxes(_boxes(spark, sf_dir)).select(*_BID, "cx", "cy")


@query(f"WITH {_PC}, {_STATS} SELECT cx, cy, cz, ci, n_points FROM st WHERE lo_x <= 40000 AND hi_x >= 20000 AND lo_y <= 20 AND hi_y >= 10 AND lo_z <= 10500 AND hi_z >= 9500")
def index_candidates(spark, sf_dir):
    cloud = _gridded(spark, sf_dir)
    return index.candidates(index.build(cloud), Box((20000.0, 10.0, 9500.0), (40000.0, 20.0, 10500.0)), ["x", "y", "z"]).select(*GRID.cell_columns(), "n_points")


@query(f"WITH {_PC}, {_STATS} SELECT cx, cy, cz, ci, n_points FROM st WHERE lo_x >= 20000 AND hi_x < 40000 AND lo_y >= 10 AND hi_y < 20 AND lo_z >= 9500 AND hi_z < 10500")
def index_contained(spark, sf_dir):
    cloud = _gridded(spark, sf_dir)
    return index.contained(index.build(cloud), Box((20000.0, 10.0, 9500.0), (40000.0, 20.0, 10500.0)), ["x", "y", "z"]).select(*GRID.cell_columns(), "n_points")


@query(f"WITH {_PC} SELECT {_ID}, x, y, z FROM pc WHERE {_IN_BOX}")
def box_indexed(spark, sf_dir):
    """The index never changes a result."""
    cloud = _gridded(spark, sf_dir)
    box = Box((20000.0, 10.0, 9500.0, 0.0), (40000.0, 20.0, 10500.0, 1.0))
    return index.query(cloud, index.build(cloud), box).select(*KEYS, "x", "y", "z")


_PART = _ROLL.format(k=f"{_KEY} || '-part'") + "::DOUBLE"


@query(f"SELECT {_ID} FROM lineitem WHERE {_PART} >= 0.25::DOUBLE AND {_PART} < 0.5::DOUBLE")
def fraction_slice(spark, sf_dir):
    return partition.fraction(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), KEYS, 0.25, 0.5).select(*KEYS)


@query(f"SELECT floor({_PART} * 8)::INTEGER AS worker, count(*) AS n FROM lineitem GROUP BY 1")
def worker_split(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.groupBy(partition.worker(KEYS, 8).alias("worker")).agg(F.count("*").alias("n"))


@query(f"WITH {_BOXES} SELECT c_nationkey, c_mktsegment, round(greatest(hi_x - lo_x, 0) * greatest(hi_y - lo_y, 0), 4) AS area, round(greatest(hi_x - lo_x, 0) + greatest(hi_y - lo_y, 0), 4) AS perimeter FROM bx")
def box_area_perimeter(spark, sf_dir):
    b = Box.of_columns(["x", "y"])
    return _boxes(spark, sf_dir).select(*_BID, F.round(b.area(), 4).alias("area"), F.round(b.perimeter(), 4).alias("perimeter"))


@query(f"WITH {_BOXES} SELECT c_nationkey, c_mktsegment, round(greatest(least(hi_x, 5000) - greatest(lo_x, 0), 0) * greatest(least(hi_y, 700) - greatest(lo_y, 100), 0), 4) AS shared, lo_x <= 5000 AND hi_x >= 0 AND lo_y <= 700 AND hi_y >= 100 AS touches, lo_x >= 0 AND hi_x <= 5000 AND lo_y >= 100 AND hi_y <= 700 AS within FROM bx")
def box_intersection(spark, sf_dir):
    b, fixed = Box.of_columns(["x", "y"]), Box((0.0, 100.0), (5000.0, 700.0))
    return _boxes(spark, sf_dir).select(*_BID, F.round(b.intersection_area(fixed), 4).alias("shared"), b.intersects(fixed).alias("touches"), fixed.contains_box(b).alias("within"))


@query(f"WITH {_BOXES} SELECT c_nationkey, c_mktsegment, least(lo_x, 0) AS lo_x, greatest(hi_x, 5000) AS hi_x, least(lo_y, 100) AS lo_y, greatest(hi_y, 700) AS hi_y FROM bx")
def box_merge(spark, sf_dir):
    m = Box.of_columns(["x", "y"]).merged(Box((0.0, 100.0), (5000.0, 700.0)))
    return _boxes(spark, sf_dir).select(*_BID, *(v.alias(p + a) for p, vs in (("lo_", m.lower), ("hi_", m.upper)) for a, v in zip("xy", vs)))


@query(f"""WITH {_BOXES} SELECT c_nationkey, c_mktsegment, round(greatest(lo_x - 1000, 0, 1000 - hi_x) ** 2 + greatest(lo_y - 900, 0, 900 - hi_y) ** 2, 3) AS d2,
  round(least((1000 - nx) ** 2 + (900 - fy) ** 2, (1000 - fx) ** 2 + (900 - ny) ** 2), 3) AS min_max_d2
FROM (SELECT *, CASE WHEN 1000 <= (lo_x + hi_x) / 2 THEN lo_x ELSE hi_x END AS nx, CASE WHEN 1000 >= (lo_x + hi_x) / 2 THEN lo_x ELSE hi_x END AS fx,
  CASE WHEN 900 <= (lo_y + hi_y) / 2 THEN lo_y ELSE hi_y END AS ny, CASE WHEN 900 >= (lo_y + hi_y) / 2 THEN lo_y ELSE hi_y END AS fy FROM bx)""")
def box_distances(spark, sf_dir):
    b, p = Box.of_columns(["x", "y"]), (F.lit(1000.0), F.lit(900.0))
    return _boxes(spark, sf_dir).select(*_BID, F.round(b.distance_2(p), 3).alias("d2"), F.round(b.min_max_dist_2(p), 3).alias("min_max_d2"))


@query(f"WITH {_BOXES} SELECT c_nationkey, c_mktsegment, (lo_x + hi_x) / 2 AS x, (lo_y + hi_y) / 2 AS y FROM bx")
def box_center(spark, sf_dir):
    c = Box.of_columns(["x", "y"]).center()
    return _boxes(spark, sf_dir).select(*_BID, *(v.alias(a) for a, v in zip("xy", c)))


@query(f"WITH {_BOXES} SELECT c_nationkey, c_mktsegment, lo_x, row_number() OVER (ORDER BY lo_x, c_nationkey, c_mktsegment) AS rank FROM bx")
def box_sort_all(spark, sf_dir):
    """All boxes with their rank on an axis, in one task: there is a box for each nation and segment, whatever the scale."""
    rank = F.row_number().over(Window.orderBy("lo_x", *_BID)).cast("bigint")
    return sort_boxes(_boxes(spark, sf_dir), "x").select(*_BID, "lo_x", rank.alias("rank"))


@query(f"WITH {_BOXES} SELECT c_nationkey, c_mktsegment, CASE WHEN row_number() OVER (ORDER BY lo_x, c_nationkey, c_mktsegment) <= 30 THEN 0 ELSE 1 END AS side FROM bx")
def box_partition(spark, sf_dir):
    from ..functions.box import partition_boxes

    return partition_boxes(_boxes(spark, sf_dir).select(*_BID, "lo_x"), "x", 30).select(*_BID, "side")


@query(f"WITH {_EM}, b AS (SELECT min(x) AS ax, min(y) AS ay, min(z) AS az, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM em) SELECT vec_id, round((x - ax) / e, 9) AS x, round((y - ay) / e, 9) AS y, round((z - az) / e, 9) AS z FROM em, b")
def normalize_unit_cube(spark, sf_dir):
    df = geometry.unit_cube(PointCloud(embeddings_cloud(spark, sf_dir)))
    return df.select("vec_id", *(F.round(a, 9).alias(a) for a in "xyz"))


@query(f"WITH {_EM}, b AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM em) SELECT vec_id, round((x - mx) * 2 / e, 9) AS x, round((y - my) * 2 / e, 9) AS y, round((z - mz) * 2 / e, 9) AS z FROM em, b")
def center_scale(spark, sf_dir):
    df = geometry.center_scale(PointCloud(embeddings_cloud(spark, sf_dir)))
    return df.select("vec_id", *(F.round(a, 9).alias(a) for a in "xyz"))


@query(f"WITH {_EM} SELECT vec_id, round(x * cos(0.5::DOUBLE) - y * sin(0.5::DOUBLE), 9) AS x, round(x * sin(0.5::DOUBLE) + y * cos(0.5::DOUBLE), 9) AS y, round(z, 9) AS z FROM em")
def rotate_z(spark, sf_dir):
    df = geometry.rotate_z(PointCloud(embeddings_cloud(spark, sf_dir)), 0.5).df
    return df.select("vec_id", *(F.round(a, 9).alias(a) for a in "xyz"))


@query(f"WITH {_EM} SELECT vec_id, round(2 * x + y + 1, 9) AS x, round(y - z, 9) AS y, round(0.5 * z - 3, 9) AS z FROM em")
def affine_transform(spark, sf_dir):
    df = geometry.affine(PointCloud(embeddings_cloud(spark, sf_dir)), [[2, 1, 0, 1], [0, 1, -1, 0], [0, 0, 0.5, -3], [0, 0, 0, 1]]).df
    return df.select("vec_id", *(F.round(a, 9).alias(a) for a in "xyz"))


@query(f"WITH {_EM} SELECT p.vec_id AS a, q.vec_id AS b, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 9) AS distance FROM em AS p, em AS q")
def distance_matrix_all(spark, sf_dir):
    """The whole cloud with itself: the square of its rows, whatever the scale."""
    df = embeddings_cloud(spark, sf_dir)
    return geometry.distance_matrix_whole(df, "vec_id").withColumn("distance", _rounded(F.col("distance"), 9))


def _rounded(value: Column, digits: int) -> Column:
    """value, not negative, rounded as SQL does it here: the scaled double, halves up. Spark's round goes by decimal digits, which is slow and at times another value."""
    scaled = value * 10.0**digits
    whole = F.floor(scaled)
    near = whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)
    return F.when(scaled < 2.0**52, near / 10.0**digits).when(scaled < math.inf, scaled / 10.0**digits).otherwise(value)


_D = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"
_HAUSDORFF = f"""WITH {_EM}, d AS (SELECT p.vec_id AS a, q.vec_id AS b, {_D} AS d FROM em AS p, em AS q WHERE p.label % 2 = 0 AND q.label % 2 = 1)
SELECT round(sqrt(greatest((SELECT max(m) FROM (SELECT min(d) AS m FROM d GROUP BY a)), (SELECT max(m) FROM (SELECT min(d) AS m FROM d GROUP BY b)))), 9) AS hausdorff"""


@query(_HAUSDORFF)
def hausdorff(spark, sf_dir):
    """Through cells of a grid, for clouds of any size."""
    df = embeddings_cloud(spark, sf_dir)
    found = geometry.hausdorff(df.where("label % 2 = 0"), df.where("label % 2 = 1"))
    return spark.range(1).select(F.round(F.lit(found), 9).alias("hausdorff"))


@query(_HAUSDORFF)
def hausdorff_pairs(spark, sf_dir):
    df = embeddings_cloud(spark, sf_dir)
    return geometry.hausdorff_pairs(df.where("label % 2 = 0"), df.where("label % 2 = 1")).select(F.round("hausdorff", 9).alias("hausdorff"))


@query(f"""WITH {_EM}, m AS (SELECT * FROM em), t(angle) AS (SELECT unnest([0.0, 0.7, 1.4, 2.1, 2.8])::DOUBLE),
r AS (SELECT angle, vec_id, x * cos(angle) - y * sin(angle) AS x, x * sin(angle) + y * cos(angle) AS y, z FROM m, t),
f AS (SELECT vec_id, x * cos(1.4::DOUBLE) - y * sin(1.4::DOUBLE) AS x, x * sin(1.4::DOUBLE) + y * cos(1.4::DOUBLE) AS y, z FROM m),
d AS (SELECT angle, p.vec_id AS a, q.vec_id AS b, {_D} AS d FROM r AS p, f AS q)
SELECT angle, round(sqrt(greatest(fa, fb)), 6) AS hausdorff FROM (SELECT angle, max(m) AS fa FROM (SELECT angle, a, min(d) AS m FROM d GROUP BY ALL) GROUP BY angle) JOIN (SELECT angle, max(m) AS fb FROM (SELECT angle, b, min(d) AS m FROM d GROUP BY ALL) GROUP BY angle) USING (angle)""")
def registration_candidates(spark, sf_dir):
    """The Hausdorff distance of a cloud, turned by each of several angles, to itself turned by one of them."""
    cloud = PointCloud(embeddings_cloud(spark, sf_dir))
    fixed = geometry.rotate_z(cloud, 1.4).df
    found = [(a, geometry.hausdorff(geometry.rotate_z(cloud, a).df, fixed)) for a in (0.0, 0.7, 1.4, 2.1, 2.8)]
    return spark.createDataFrame(found, "angle double, hausdorff double").withColumn("hausdorff", F.round("hausdorff", 6))


@query(None)
def registration(spark, sf_dir):
    """The angle that brings a cloud back onto itself turned by 1.4; found by search, so there is no SQL."""
    cloud = PointCloud(embeddings_cloud(spark, sf_dir))
    found = geometry.register(cloud, geometry.rotate_z(cloud, 1.4))
    return spark.range(1).select(F.lit(found).alias("angle"))


@query(f"WITH {_PC} SELECT {_ID}, x FROM pc WHERE i < 0.5::FLOAT UNION ALL SELECT {_ID}, x FROM pc WHERE i >= 0.5::FLOAT")
def append_union_all(spark, sf_dir):
    """Two slices of importance that make the whole table."""
    cloud = _cloud(spark, sf_dir)
    high = cloud.filter_box(Box((-math.inf,) * 3 + (0.5,), (math.inf,) * 4)).df
    return PointCloud(cloud.sample(0.5)).append(high).df.select(*KEYS, "x")


# SQL over a cloud as a view


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    _cloud(spark, sf_dir).register("pc")
    for name in ("orders", "customer", "part"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def _sql_query(name: str, spark_text: str, duck_text: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: _sql(spark, sf_dir, spark_text)
    ORACLE_SQL[name] = f"WITH {_PC} {duck_text or spark_text}"


_sql_query("sql_scan", f"SELECT {_ID}, x, y, z, i FROM pc")
_sql_query("sql_filter", f"SELECT {_ID}, x FROM pc WHERE y BETWEEN 10 AND 12 AND x > 50000")
_sql_query("sql_mean", "SELECT round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM pc")
_sql_query("sql_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(x) AS lo, max(x) AS hi, count(DISTINCT l_partkey) AS parts FROM pc GROUP BY l_returnflag, l_linestatus")
_sql_query("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM pc GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql_query("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM pc GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql_query("sql_grouping_sets", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM pc GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
_sql_query("sql_window_topk", f"SELECT {_ID}, x, r FROM (SELECT {_ID}, x, row_number() OVER (PARTITION BY l_suppkey ORDER BY x DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM pc) AS t WHERE r <= 3", None)
_sql_query("sql_window_frame", f"SELECT {_ID}, sum(y) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, x ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM pc")
_sql_query("sql_join", "SELECT o_orderpriority, count(*) AS n FROM pc JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
_sql_query("sql_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_sql_query("sql_semi_join", f"SELECT {_ID}, x FROM pc WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
_sql_query("sql_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql_query("sql_except", "SELECT DISTINCT l_partkey FROM pc WHERE y > 25 EXCEPT SELECT DISTINCT l_partkey FROM pc WHERE y < 10")
_sql_query("sql_intersect", "SELECT l_partkey FROM pc WHERE y > 45 INTERSECT SELECT l_partkey FROM pc WHERE y < 5")
_sql_query("sql_union", "SELECT l_partkey FROM pc WHERE y > 49 UNION SELECT l_partkey FROM pc WHERE y < 2")
_sql_query("sql_topk", f"SELECT {_ID}, x FROM pc ORDER BY x DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
_sql_query("sql_math", f"SELECT {_ID}, floor(x / 1000)::BIGINT AS k, round(sqrt(x), 6) AS root, CASE WHEN y > 25 THEN 'many' ELSE 'few' END AS size FROM pc", None)


@query(f"""WITH {_PC}, {_BOXES} SELECT c_nationkey, c_mktsegment, count(*) AS n FROM bx JOIN pc ON x >= lo_x AND x < hi_x AND l_suppkey >= lo_y AND l_suppkey < hi_y
GROUP BY ALL""")
def sql_range_join_all(spark, sf_dir):
    """All points in all boxes: both sides meet in cells of a grid, then the exact test."""
    return _count_inside(_cloud(spark, sf_dir).df, _boxes(spark, sf_dir))


def _count_inside(points: DataFrame, boxes: DataFrame) -> DataFrame:
    cells = boxes.withColumn("cx", F.explode(F.sequence(F.floor(F.col("lo_x") / 2000.0), F.floor(F.col("hi_x") / 2000.0))))
    inside = (F.col("x") >= F.col("lo_x")) & (F.col("x") < F.col("hi_x")) & (F.col("l_suppkey") >= F.col("lo_y")) & (F.col("l_suppkey") < F.col("hi_y"))
    return Grid(2000.0).with_cells(points).join(cells, "cx").where(inside).groupBy(*_BID).agg(F.count("*").alias("n"))


@query(f"WITH {_PC} SELECT ci, lo, n FROM (SELECT floor(i::DOUBLE / 0.125::DOUBLE)::BIGINT AS ci, min(x) AS lo, count(*) AS n FROM pc GROUP BY 1) ORDER BY ci")
def importance_strata(spark, sf_dir):
    """Points by eighth of importance: each is a sample of the whole."""
    df = Grid(i=0.125).with_cells(_cloud(spark, sf_dir).df)
    return df.groupBy("ci").agg(F.min("x").alias("lo"), F.count("*").alias("n"))


@query(f"WITH {_PC} SELECT l_suppkey, x, y, z, i FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY i, l_orderkey, l_linenumber, l_partkey) AS r FROM pc) WHERE r <= 2")
def stratified_sample(spark, sf_dir):
    """The least important points of each group, a sample of fixed size; a ranked window limits each map task first."""
    w = Window.partitionBy("l_suppkey").orderBy("i", "l_orderkey", "l_linenumber", "l_partkey")
    return _cloud(spark, sf_dir).df.withColumn("r", F.row_number().over(w)).where("r <= 2").select("l_suppkey", "x", "y", "z", "i")
