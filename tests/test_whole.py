"""Queries that take every row of their tables."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from cloudgrid.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_range_join_meets_all_points_and_boxes(spark):
    got = {(r.c_nationkey, r.c_mktsegment): r.n for r in __spark_entry__.queries()["sql_range_join_all"](spark, DATA).collect()}
    boxes = queries._boxes(spark, DATA).collect()
    points = [(r.l_extendedprice, r.l_suppkey) for r in spark.read.parquet(f"{DATA}/lineitem.parquet").collect()]
    want = {(b.c_nationkey, b.c_mktsegment): sum(b.lo_x <= x < b.hi_x and b.lo_y <= y < b.hi_y for x, y in points) for b in boxes}
    assert got == {k: n for k, n in want.items() if n}
    assert len({segment for _, segment in got}) > 1


def test_distance_matrix_is_of_the_whole_cloud(spark):
    df = __spark_entry__.queries()["distance_matrix_all"](spark, DATA)
    ids = sorted(r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect())
    got = {(r.a, r.b): r.distance for r in df.collect()}
    assert len(got) == len(ids) ** 2 and sorted({a for a, _ in got}) == sorted({b for _, b in got}) == ids
    assert all(got[a, a] == 0 and got[a, b] == got[b, a] for a in ids[:20] for b in ids)


def test_distance_matrix_rounds_as_sql_does(spark, tmp_path):
    """Far points, so that some scaled distances lie half-way, at whole places, whose squares are exact; vectors that repeat, one without a coordinate."""
    made = np.random.default_rng(1).integers(-10**6, 10**6, (300, 3)).astype("float32").tolist()
    made += [made[0], [0.0, None, 1.0], [3e38, 0.0, 0.0]]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(made)), "int64"), "embedding": pa.array(made, pa.list_(pa.float32())), "label": pa.array([0] * len(made), "int32")}), f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r.distance for r in __spark_entry__.queries()["distance_matrix_all"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = {(a, b): d for a, b, d in con.execute(__spark_entry__.oracle_sql()["distance_matrix_all"]).fetchall()}
    assert len(got) == len(made) ** 2 and got == want


def test_distance_matrix_holds_a_distance_once_in_a_file(spark, tmp_path):
    """Both ways round lie near each other, so that compression finds the second: 8.0 bytes a distance where they are apart."""
    made = np.random.default_rng(2).normal(size=(3000, 3)).astype("float32")
    pq.write_table(pa.table({"vec_id": np.arange(3000), "embedding": pa.array(list(made), pa.list_(pa.float32())), "label": np.zeros(3000, "int32")}), f"{tmp_path}/embeddings.parquet")
    __spark_entry__.queries()["distance_matrix_all"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "out").glob("*.parquet")]
    assert sum(m.num_rows for m in files) == 3000**2
    assert sum(m.row_group(k).column(2).total_compressed_size for m in files for k in range(m.num_row_groups)) < 6 * 3000**2


@pytest.mark.parametrize("size", [20, 1000])
def test_distance_matrix_is_a_product_of_any_blocks(spark, monkeypatch, size):
    """Blocks that rows don't fill, and one that holds more than its share; repeated rows, ids that are null or text, missing and infinite coordinates."""
    monkeypatch.setattr(queries.geometry, "SQUARE", size)
    rows = [(f"v{k}", float(k), k / 3, -1.0) for k in range(300)] + [("v1", 1.0, 1 / 3, -1.0)] * 3 + [("same", 2.0, 2.0, 2.0)] * 20
    rows += [(None, 1.0, 2.0, 3.0), ("none", None, 1.0, 1.0), ("nan", float("nan"), 1.0, 1.0), ("far", float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, x double, y double, z double")
    whole, plain = queries.geometry.distance_matrix_whole(df, "id"), queries.geometry.distance_matrix(df, df, "id", "id")
    assert whole.dtypes == plain.dtypes and whole.count() == len(rows) ** 2
    assert whole.exceptAll(plain).count() == 0 and plain.exceptAll(whole).count() == 0
    assert queries.geometry.distance_matrix_whole(df.limit(0), "id").count() == 0


def test_registration_finds_the_angle_with_every_point(spark, monkeypatch):
    sizes, plain = set(), queries.geometry.hausdorff

    def counted(a, b, axes):
        if not sizes:
            sizes.update((a.count(), b.count()))
        return plain(a, b, axes)

    monkeypatch.setattr(queries.geometry, "hausdorff", counted)
    found = __spark_entry__.queries()["registration"](spark, DATA).first()["angle"]
    assert sizes == {spark.read.parquet(f"{DATA}/embeddings.parquet").count()}
    assert queries.geometry.angle_error(found, 1.4) < 0.002


def test_box_sort_ranks_every_box(spark):
    rows = __spark_entry__.queries()["box_sort_all"](spark, DATA).collect()
    assert len(rows) == queries._boxes(spark, DATA).count() > 10
    assert [r["rank"] for r in sorted(rows, key=lambda r: (r.lo_x, r.c_nationkey, r.c_mktsegment))] == list(range(1, len(rows) + 1))


def test_append_makes_the_whole_table(spark):
    columns = [*queries.KEYS, "l_extendedprice"]
    want = sorted(map(tuple, spark.read.parquet(f"{DATA}/lineitem.parquet").select(*columns).collect()))
    assert sorted(map(tuple, __spark_entry__.queries()["append_union_all"](spark, DATA).collect())) == want
