import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudgrid.functions import points
from cloudgrid.functions.box import INF, Box, parse_bounds, partition_boxes, sort_boxes
from cloudgrid.functions.importance import STEPS, add_importance
from cloudgrid.functions.schema import SchemaError, dimensions, importance_column, mark_axes, point_schema, validate, with_roles

numbers = st.integers(-(10**9), 10**9).map(lambda v: v / 1024)
three = st.tuples(numbers, numbers, numbers)
T3 = [(0.0, 1.0, 2.0), (2.0, 0.0, 1.0), (1.0, 2.0, 0.0)]


def test_bounds_of_points():
    assert Box.from_points(T3) == Box((0, 0, 0), (2, 2, 2))


def test_empty_box_is_neutral():
    b = Box((0.0, 1.0), (2.0, 3.0))
    assert Box.empty(2).merged(b) == b and Box.empty(2).area() == 0


@given(three, three, three)
def test_box_algebra(p, q, r):
    b = Box.from_corners(p, q)
    assert b.contains_point(p) and b.contains_point(q) and b.contains_point(b.center())
    m = b.add_point(r)
    assert m.contains_box(b) and m.contains_point(r) and m.intersects(b)
    assert b.distance_2(r) <= b.min_max_dist_2(r) * (1 + 1e-9) + 1e-9
    assert (b.distance_2(r) == 0) == b.contains_point(r)
    assert b.intersection_area(b) == b.area() and b.perimeter() >= 0


def test_touching_boxes_intersect_without_area():
    a, b = Box((0.0, 0.0), (1.0, 1.0)), Box((1.0, 0.0), (2.0, 1.0))
    assert a.intersects(b) and a.intersection_area(b) == 0
    assert not a.intersects(Box((1.1, 0.0), (2.0, 1.0)))


def test_min_max_distance():
    assert Box((0.0, 0.0), (2.0, 2.0)).min_max_dist_2((-1.0, 0.5)) == 1 + 1.5**2


def test_cast_box():
    b = Box((1.0, 2.0), (3.0, 4.0))
    assert b.cast(1) == Box((1.0,), (3.0,))
    assert b.cast(3) == Box((1.0, 2.0, -INF), (3.0, 4.0, INF))


def test_from_slice():
    assert points.from_slice([1, 1, 1], 2) == (1, 1)
    assert points.from_slice([1, 1, 1], 4) == (1, 1, 1, 0)


def test_parse_bounds():
    assert parse_bounds("0,0,1,1", 0.5) == Box((0, 0, -INF, 0), (1, 1, INF, 0.5))
    assert parse_bounds("0,0,0,0.5,1,1,1,1") == Box((0, 0, 0, 0.5), (1, 1, 1, 1))
    assert parse_bounds(None) == Box((-INF,) * 3 + (0,), (INF,) * 3 + (1,))
    for bad in ("1,2,3", "1,2,3,4,5,6,7,8,9,10"):
        with pytest.raises(ValueError):
            parse_bounds(bad)


def test_column_boxes_agree_with_numbers(spark):
    rows = [(0.0, 2.0, 0.0, 2.0), (1.0, 1.0, -1.0, 5.0), (3.0, 4.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "lo_x double, hi_x double, lo_y double, hi_y double")
    b, o, p = Box.of_columns(["x", "y"]), Box((0.5, 0.5), (3.0, 3.0)), (1.5, 4.0)
    got = df.select(b.area(), b.perimeter(), b.intersection_area(o), b.intersects(o), b.distance_2(tuple(map(F.lit, p))), b.min_max_dist_2(tuple(map(F.lit, p))), b.contains_point(tuple(map(F.lit, p)))).collect()
    for row, (a, c, d, e) in zip(got, rows):
        n = Box((a, d), (c, e))
        assert tuple(row) == (n.area(), n.perimeter(), n.intersection_area(o), n.intersects(o), n.distance_2(p), n.min_max_dist_2(p), n.contains_point(p))


def test_box_order_and_partition(spark):
    df = spark.createDataFrame([(float(k % 5), k) for k in range(20)], "lo_x double, k int")
    assert [r.lo_x for r in sort_boxes(df, "x").collect()] == sorted(float(k % 5) for k in range(20))
    got = partition_boxes(df, "x", 6).collect()
    low, high = [r.lo_x for r in got if r.side == 0], [r.lo_x for r in got if r.side == 1]
    assert len(got) == 20 and len(low) == 6 and max(low) <= min(high)


def test_point_algebra(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a bigint, b bigint, c bigint, d bigint")
    col = lambda n: [F.col(n)] * 3
    made = [points.add(col("a"), col("a")), points.subtract(col("c"), col("a")), points.multiply(col("b"), col("b")), points.divide(col("d"), col("b"), whole=True)]
    assert list(df.select(*(m[0] for m in made)).first()) == [2, 2, 4, 2]


def test_cast_dimensions_fills_and_cuts(spark):
    df = mark_axes(spark.createDataFrame([(1.7, -1.7, 1.0)], "x double, y double, z double"))
    assert tuple(points.cast_dimensions(df, ["x", "y", "z"], "bigint", 4).first()) == (1, -1, 1, 0)
    assert tuple(points.cast_dimensions(df, ["x", "y", "z"], "bigint", 2).first()) == (1, -1)


def test_roles(spark, tmp_path):
    df = add_importance(mark_axes(spark.createDataFrame(T3, "x double, y double, z double")), seed=1)
    assert df.columns[0] == "i" and dimensions(df.schema) == ["x", "y", "z", "i"] and importance_column(df.schema) == "i"
    assert add_importance(df) is df
    df.write.parquet(str(tmp_path / "p"))
    assert dimensions(spark.read.parquet(str(tmp_path / "p")).schema) == ["x", "y", "z", "i"]
    lost = df.withColumn("x", F.col("x") * 2)
    assert dimensions(with_roles(lost, df.schema).schema) == ["x", "y", "z", "i"]
    assert dimensions(point_schema(T.LongType(), 2)) == ["x", "y"]


def test_validate(spark):
    with pytest.raises(SchemaError):
        validate(point_schema(T.DoubleType(), 2))
    with pytest.raises(SchemaError):
        validate(mark_axes(spark.createDataFrame([("a", 1.0, 1.0)], "x string, y double, z double")).schema)
    with pytest.raises(SchemaError):
        point_schema(T.DoubleType(), 5)
    validate(point_schema(T.IntegerType(), 3))


def test_importance_is_uniform_and_below_one(spark):
    df = add_importance(mark_axes(spark.range(20000).selectExpr("id", "cast(id as double) x", "0D y", "0D z")), ["id"])
    row = df.agg(F.min("i"), F.max("i"), F.avg("i"), F.count_distinct("i")).first()
    assert row[0] >= 0 and row[1] < 1 and abs(row[2] - 0.5) < 0.01 and row[3] > 19900
    assert STEPS == 1 << 24
    assert df.collect() == df.collect()
