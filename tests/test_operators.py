import math
import random

import pytest
from pyspark.sql import functions as F

from cloudgrid.functions.box import Box
from cloudgrid.operators import geometry, index, partition
from cloudgrid.operators.cloud import PointCloud
from cloudgrid.operators.grid import Grid

T3 = [(0.0, 1.0, 2.0), (2.0, 0.0, 1.0), (1.0, 2.0, 0.0)]
XYZ = "x double, y double, z double"


def cloud(spark, rows, schema=XYZ, keys=None):
    made = PointCloud.of(spark.createDataFrame(rows, schema))
    return made.with_importance(keys) if keys else made


@pytest.fixture(scope="module")
def numbered(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 100 as double) x", "cast(id div 100 as double) y", "cast(-(id % 7) as double) z")
    return PointCloud.of(df).with_importance(["id"])


def test_bounds(spark):
    assert cloud(spark, T3).bounds() == Box((0, 0, 0), (2, 2, 2))
    assert cloud(spark, []).bounds() == Box.empty(3)
    assert cloud(spark, T3).num_points() == 3


def test_filter(spark):
    c = cloud(spark, [(1.0,) * 3, (2.0,) * 3, (3.0,) * 3])
    assert [r.x for r in c.query("0.5,0.5,0.5,1.5,1.5,1.5").collect()] == [1.0]


def test_box_is_half_open(spark):
    c = cloud(spark, [(1.0,) * 3, (2.0,) * 3])
    assert [r.x for r in c.query("1,1,1,2,2,2").collect()] == [1.0]
    assert c.df.where(c.contains(Box((1.0,) * 3, (2.0,) * 3))).count() == 2


def test_empty_results_keep_the_schema(numbered):
    found = numbered.query("5,5,5,5,5,5")
    assert found.count() == 0 and found.columns == numbered.df.columns


def test_nan_and_null_never_pass(spark):
    c = cloud(spark, [(float("nan"), 1.0, 1.0), (None, 1.0, 1.0), (1.0, 1.0, 1.0)])
    assert c.query("0,0,0,9,9,9").count() == 1


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "float", "decimal(10,2)"])
def test_all_numeric_dimensions(spark, kind):
    df = spark.range(20).select(*(F.col("id").cast(kind).alias(a) for a in "xyz"))
    c = PointCloud.of(df)
    assert c.query("2.5,0,0,7,99999999999,99").count() == 4
    assert c.query("-99999999999,0,0,3,99,99").count() == 3


def test_importance_at_float_neighbours(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.7), (0.0, 0.0, 0.0, 0.1)], "x double, y double, z double, i float")
    c = PointCloud.of(df, importance="i")
    assert [round(r.i, 3) for r in c.sample(0.7).collect()] == [0.1]
    g = c.with_grid(Grid(i=0.1))
    assert g.query("0,0,0,0.7,1,1,1,1").count() == 1


def test_samples_are_nested_and_sized(numbered):
    small, large = ({r.id for r in numbered.sample(p).collect()} for p in (0.1, 0.3))
    assert small < large and abs(len(small) - 300) < 80 and abs(len(large) - 900) < 120
    assert numbered.sample(1.0).count() == 3000


def test_budget_takes_the_least_important(numbered):
    got = [r.i for r in numbered.query("0,0,-9,50,50,9", budget=7).collect()]
    assert len(got) == 7 and max(got) <= sorted(r.i for r in numbered.query("0,0,-9,50,50,9").collect())[6]


def test_grid_cells():
    b = Box((-0.9,) * 3, (0.9,) * 3)
    assert len(Grid().cells(b)) == 1 and len(Grid(1.0, 1.0, 1.0).cells(b)) == 8
    assert Grid.parse("1,2").steps() == {"x": 1.0, "y": 2.0} and Grid.parse("0,-1,3").steps() == {"z": 3.0}


def test_cells_lose_no_point(numbered):
    g = numbered.with_grid(Grid(10.0, 10.0, 2.0, 0.25))
    assert g.df.count() == 3000 and g.df.where("cx is null or ci > 3 or ci < 0").count() == 0
    union = g.df.groupBy("cx", "cy", "cz", "ci").count().agg(F.sum("count")).first()[0]
    assert union == 3000


def test_cell_ids(spark):
    g = cloud(spark, [(1.5, -0.5, 0.0)]).with_grid(Grid(1.0, 1.0))
    assert g.df.select(g.grid.cell_id()).first()[0] == "1.000000000--1.000000000"


def test_index_changes_nothing(numbered):
    g = numbered.with_grid(Grid(10.0, 10.0, None, 0.125))
    stats = index.build(g)
    for box in (Box((0.0, 0.0, -7.0, 0.0), (10.0, 10.0, 1.0, 1.0)), Box((5.0, 5.0, -2.0, 0.2), (31.0, 20.0, 0.0, 0.8)), Box((500.0, 0.0, 0.0, 0.0), (600.0, 9.0, 9.0, 1.0))):
        want = {r.id for r in numbered.filter_box(box).df.collect()}
        assert {r.id for r in index.query(g, stats, box).collect()} == want
        inside = index.contained(stats, box, g.dims).select("cx", "cy", "ci")
        assert {r.id for r in g.df.join(inside, ["cx", "cy", "ci"], "left_semi").collect()} <= want


def test_fractions_are_disjoint_and_whole(numbered):
    parts = [{r.id for r in p.collect()} for p in partition.split(numbered.df, ["id"], 4)]
    assert sum(map(len, parts)) == 3000 and len(set().union(*parts)) == 3000
    assert numbered.df.select(partition.worker(["id"], 4).alias("w")).distinct().count() == 4
    with pytest.raises(ValueError):
        partition.fraction(numbered.df, ["id"], 0.5, 0.2)


def test_unit_cube(spark):
    got = geometry.unit_cube(cloud(spark, T3)).collect()
    assert len(got) == 3 and all(0 <= v <= 1 for r in got for v in r)
    assert geometry.unit_cube(cloud(spark, [(5.0, 5.0, 5.0)])).first().x == 0
    assert all(-1 <= v <= 1 for r in geometry.center_scale(cloud(spark, T3)).collect() for v in r)


def test_distance_matrix(spark):
    df = cloud(spark, T3).df.withColumn("id", F.monotonically_increasing_id())
    total = geometry.distance_matrix(df, df, "id", "id").agg(F.sum("distance")).first()[0]
    assert total / 6 == pytest.approx(2.4494897427831783)


def test_hausdorff_of_clouds_of_any_size(spark):
    r = random.Random(3)
    points = lambda n, far: [(r.uniform(0, far), r.uniform(0, 10), r.gauss(0, 1)) for _ in range(n)]
    for n, m, far in ((40, 25, 10), (5, 60, 300), (30, 1, 10)):
        a, b = points(n, 10), points(m, far)
        d = lambda p, q: math.dist(p, q)
        want = max(max(min(d(p, q) for q in b) for p in a), max(min(d(p, q) for p in a) for q in b))
        x, y = spark.createDataFrame(a, XYZ), spark.createDataFrame(b, XYZ)
        assert geometry.hausdorff(x, y) == pytest.approx(want)
        assert geometry.hausdorff_pairs(x, y).first()[0] == pytest.approx(want)
    assert geometry.hausdorff(x, x.limit(0)) is None


def test_rotation_and_registration(spark):
    c = cloud(spark, T3)
    turned = geometry.rotate_z(c, 1.0)
    assert turned.dims == ["x", "y", "z"]
    found = geometry.register(c, turned, 14)
    assert geometry.angle_error(found, 1.0) < 0.2
    assert geometry.angle_error(0.1, 2 * math.pi - 0.1) == pytest.approx(0.2)


def _plain_hausdorff(p, q):
    d = ((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2)
    return math.sqrt(max(d.min(axis=1).max(), d.min(axis=0).max()))


@pytest.mark.parametrize("leaf", [40, 100_000])
def test_hausdorff_of_odd_clouds(spark, monkeypatch, leaf):
    """Outliers, dense clusters, clouds far apart, flat clouds and repeated points, in one leaf and in many."""
    import numpy as np

    monkeypatch.setattr(geometry, "LEAF", leaf)
    monkeypatch.setattr(geometry, "BLOCK", 16)
    monkeypatch.setattr(geometry, "ASKED", 50)
    r = np.random.default_rng(1)
    near = r.normal(size=(300, 3))
    clouds = [
        (near, np.vstack([r.normal(size=(250, 3)), [[1e9, 0, 0]]])),
        (np.vstack([r.normal(scale=1e-6, size=(300, 3)), near[:20]]), near),
        (near, r.normal(size=(200, 3)) + 1e6),
        (near * [1, 1, 0], np.repeat(near[:5], 60, axis=0)),
    ]
    for p, q in clouds:
        frames = [spark.createDataFrame(list(map(tuple, x.tolist())), "x double, y double, z double").repartition(3) for x in (p, q)]
        assert geometry.hausdorff(*frames) == pytest.approx(_plain_hausdorff(p, q), rel=1e-9)


def test_positions_that_are_none_take_no_part(spark):
    make = lambda rows: spark.createDataFrame(rows, "x double, y double, z double")
    odd = [(None, 0.0, 0.0), (float("nan"), 1.0, 1.0), (0.0, float("inf"), 0.0)]
    a, b = make([(0.0, 0.0, 0.0), *odd]), make([(0.0, 3.0, 4.0), *odd])
    assert geometry.hausdorff(a, b) == 5.0
    assert geometry.hausdorff(a, make(odd)) is None and geometry.nearest(a, make(odd)).first().d2 is None
    with pytest.raises(ValueError):
        geometry.register(PointCloud.of(a), PointCloud.of(make(odd)), 4)
