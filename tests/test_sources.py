import numpy as np
import pyarrow as pa
import pytest

from cloudgrid.__main__ import main
from cloudgrid.functions.schema import dimensions
from cloudgrid.sources import formats, ipc, las, ply

N = 1000


def las_batch(n=N):
    r = np.random.default_rng(1)
    return pa.RecordBatch.from_pydict(
        {
            "x": r.uniform(0, 100, n).round(3),
            "y": r.uniform(-50, 50, n).round(3),
            "z": r.uniform(0, 9, n).round(3),
            "intensity": pa.array(r.integers(0, 60000, n), pa.int32()),
            "return_number": pa.array(r.integers(1, 4, n), pa.int16()),
            "number_of_returns": pa.array(np.full(n, 4), pa.int16()),
            "classification": pa.array(r.integers(0, 12, n), pa.int16()),
            "is_withheld": pa.array(r.integers(0, 2, n).astype(bool)),
            "is_edge_of_flight_line": pa.array(r.integers(0, 2, n).astype(bool)),
            "gps_time": r.uniform(0, 1, n),
            "red": pa.array(r.integers(0, 65535, n), pa.int32()),
            "nir": pa.array(r.integers(0, 65535, n), pa.int32()),
        }
    )


@pytest.mark.parametrize("kind", sorted(las.FORMATS))
def test_las_round_trip(spark, tmp_path, kind, monkeypatch):
    path, b = str(tmp_path / "a.LAS"), las_batch()
    assert las.write_las([b.slice(0, 300), b.slice(300)], path, kind) == N
    df = formats.read(spark, path)
    assert dimensions(df.schema) == ["x", "y", "z"]
    assert ("gps_time" in df.columns, "red" in df.columns, "nir" in df.columns) == tuple(any(f == n for f, _ in las.FORMATS[kind]) for n in ("gps_time", "red", "nir"))
    got, want = df.orderBy("x", "y").toPandas(), b.to_pandas().sort_values(["x", "y"]).reset_index(drop=True)
    assert np.allclose(got[["x", "y", "z"]], want[["x", "y", "z"]], atol=6e-4)
    for c in set(want.columns) & set(got.columns) - {"x", "y", "z"}:
        assert (got[c].to_numpy() == want[c].to_numpy()).all(), c


def test_las_splits(tmp_path):
    path = str(tmp_path / "a.las")
    las.write_las([las_batch()], path)
    old, las.CHUNK = las.CHUNK, 300
    try:
        parts = las.LasReader(None, {"path": path}).partitions()
    finally:
        las.CHUNK = old
    assert [(p.first, p.count) for p in parts] == [(0, 300), (300, 300), (600, 300), (900, 100)]


def test_las_sql_and_several_files(spark, tmp_path):
    paths = [str(tmp_path / f"{k}.las") for k in range(2)]
    for p in paths:
        las.write_las([las_batch()], p)
    formats.read(spark, paths).createOrReplaceTempView("las")
    assert spark.sql("SELECT count(*), avg(x) FROM las").first()[0] == 2 * N
    las.write_las([las_batch()], paths[1], 6)
    with pytest.raises(Exception, match="different schemas"):
        formats.read(spark, paths).count()


def test_laz_needs_a_codec(spark, tmp_path):
    path = tmp_path / "a.laz"
    las.write_las([las_batch()], str(path))
    raw = bytearray(path.read_bytes())
    raw[104] |= 0x80
    path.write_bytes(raw)
    with pytest.raises(Exception, match="codec"):
        formats.read(spark, str(path)).count()


@pytest.mark.parametrize("binary", [False, True])
def test_ply_round_trip(spark, tmp_path, binary):
    df = spark.range(500).selectExpr("id * 0.5D x", "cast(id as float) y", "-1D z", "cast(id % 100 as tinyint) a", "cast(id as smallint) b", "cast(-id as int) c")
    path = str(tmp_path / "a.ply")
    assert ply.write_ply(df, path, binary) == 500
    back = formats.read(spark, path)
    assert dimensions(back.schema) == ["x", "y", "z"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_ply_big_endian_and_other_elements(spark, tmp_path):
    head = b"ply\nformat binary_big_endian 1.0\ncomment hi\nelement camera 2\nproperty uchar k\nelement vertex 2\nproperty float x\nproperty uint n\nelement face 1\nproperty list uchar int v\nend_header\n"
    body = b"\x01\x02" + np.array([(1.5, 4_000_000_000), (2.5, 7)], dtype=[("x", ">f4"), ("n", ">u4")]).tobytes() + b"\x01\0\0\0\0"
    path = tmp_path / "a.ply"
    path.write_bytes(head + body)
    formats.register(spark)
    assert sorted(map(tuple, spark.read.format("ply").load(str(path)).collect())) == [(1.5, 4_000_000_000), (2.5, 7)]


def test_ply_lists_are_refused(spark, tmp_path):
    path = tmp_path / "a.ply"
    path.write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int v\nend_header\n1 2\n")
    formats.register(spark)
    with pytest.raises(Exception, match="list properties"):
        spark.read.format("ply").load(str(path)).count()


def test_ipc_round_trip(spark, tmp_path):
    df = formats.normalised(spark.range(50).selectExpr("id * 1D x", "0D y", "1D z", "id"))
    path = str(tmp_path / "a.arrow")
    assert ipc.write_ipc(df, path, compress=True) == 50
    for back in (formats.read(spark, path), ipc.from_stream(spark, ipc.to_stream(df))):
        assert dimensions(back.schema) == ["x", "y", "z"] and sorted(back.collect()) == sorted(df.collect())


def test_unsigned_columns_grow(spark, tmp_path):
    t = pa.table({"a": pa.array([255], pa.uint8()), "b": pa.array([2**32 - 1], pa.uint32()), "c": pa.array([2**64 - 1], pa.uint64())})
    path = str(tmp_path / "a.ipc")
    with pa.ipc.new_file(path, t.schema) as w:
        w.write_table(t)
    row = formats.read(spark, path).first()
    assert (row.a, row.b, int(row.c)) == (255, 2**32 - 1, 2**64 - 1)


def test_convert(spark, tmp_path):
    src = str(tmp_path / "a.las")
    las.write_las([las_batch()], src)
    target = formats.convert(spark, src, importance=True, seed=1)
    assert target == str(tmp_path / "a.parquet")
    df = spark.read.parquet(target)
    assert df.columns[0] == "i" and dimensions(df.schema) == ["x", "y", "z", "i"] and df.count() == N
    assert formats.convert(spark, src) is None
    assert formats.convert(spark, src, overwrite=True) == target
    assert main(["convert", src, src, "-d", str(tmp_path / "both.parquet")]) == 0
    assert spark.read.parquet(str(tmp_path / "both.parquet")).count() == 2 * N


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        formats.read(spark, "a.xyz")
    assert formats.format_of("A.LaZ") == "las"


def test_negative_zero(spark):
    row = formats.normalised(spark.createDataFrame([(-0.0, 1.0, 1.0)], "x double, y double, z double")).first()
    assert str(row.x) == "0.0"
