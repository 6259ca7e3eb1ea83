"""Queries that pass whole tables through files, collections, the service and streams, and the same in DuckDB's SQL."""

from __future__ import annotations

import math
import threading
import uuid
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.box import Box
from ..functions.extend import register_function
from ..operators import geometry, partition
from ..operators.cloud import PointCloud
from ..sources import formats, ipc, las, ply
from ..sources.files import shared_root
from ..sources.views import embeddings_cloud, events_cloud, lineitem_cloud
from ..streaming.ingest import ingest
from .engine import Engine
from .queries import _BID, _BOXES, _EM, _EV, _ID, _IN_BOX, _PC, KEYS, _boxes, query
from .service import serve

_DELTA = "5000,10,365,0.125"
_RECORDS = "l_suppkey % 65536 AS point_source_id, l_partkey % 65536 AS intensity, l_linenumber AS red"


def _new(spark: SparkSession, extension: str = "") -> str:
    """A name under the shared folder that nobody has used."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}{extension}"


def _las(spark: SparkSession, sf_dir: str, point_format: int) -> list[str]:
    df = lineitem_cloud(spark, sf_dir)
    more = {"gps_time": F.col("l_orderkey").cast("double"), "point_source_id": F.col("l_suppkey") % 65536, "intensity": F.col("l_partkey") % 65536, "red": F.col("l_linenumber"), "nir": F.col("l_linenumber") * 2, "classification": F.col("l_linenumber") % 32}
    return las.write_parts(df.select("x", "y", "z", *(c.cast("int" if n != "gps_time" else "double").alias(n) for n, c in more.items())), _new(spark), point_format, 0.01)


def _records(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(F.col("gps_time").cast("bigint").alias("l_orderkey"), *(F.col(c).cast("bigint").alias(c) for c in ("point_source_id", "intensity", "red")), *more, F.round("x", 2).alias("x"), "y", "z")


@query(f"WITH {_PC} SELECT l_orderkey, {_RECORDS.replace('l_linenumber', 'l_linenumber::BIGINT')}, round(x, 2) AS x, y, z FROM pc")
def las_files(spark, sf_dir):
    """A table as LAS files of format 3, one for each task, and back."""
    return _records(formats.read(spark, _las(spark, sf_dir, 3)))


@query(f"WITH {_PC} SELECT l_orderkey, {_RECORDS.replace('l_linenumber', 'l_linenumber::BIGINT')}, (2 * l_linenumber)::BIGINT AS nir, l_linenumber::BIGINT AS classification, round(x, 2) AS x, y, z FROM pc")
def las_extended_files(spark, sf_dir):
    """Version 1.4, format 8: with near infrared and whole classes."""
    df = formats.read(spark, _las(spark, sf_dir, 8))
    more = [F.col(c).cast("bigint").alias(c) for c in ("nir", "classification")]
    return _records(df, *more)


_EVENT = f"WITH {_EV} SELECT x, y, z, event_id::DOUBLE AS event_id FROM ev"


def _ply(spark: SparkSession, sf_dir: str, binary: bool) -> str:
    path = _new(spark, ".ply")
    ply.write_ply(events_cloud(spark, sf_dir).select("x", "y", "z", "event_id"), path, binary)
    return path


@query(_EVENT)
def ply_ascii(spark, sf_dir):
    return formats.read(spark, _ply(spark, sf_dir, False))


@query(_EVENT)
def ply_binary(spark, sf_dir):
    return formats.read(spark, _ply(spark, sf_dir, True))


@query(_EVENT)
def convert_files(spark, sf_dir):
    """PLY to Parquet with ZSTD."""
    target = formats.convert(spark, _ply(spark, sf_dir, True), _new(spark, ".parquet"))
    return formats.read(spark, target)


_EMBEDDED = f"WITH {_EM} SELECT i, x, y, z, vec_id, label FROM em"


@query(_EMBEDDED)
def ipc_file(spark, sf_dir):
    path = _new(spark, ".arrow")
    ipc.write_ipc(embeddings_cloud(spark, sf_dir), path, compress=True)
    return formats.read(spark, path)


@query(_EMBEDDED)
def ipc_stream(spark, sf_dir):
    return ipc.from_stream(spark, ipc.to_stream(embeddings_cloud(spark, sf_dir)))


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """lineitem as a collection, stored in two appends."""
    engine, cloud = Engine(spark, _new(spark)), PointCloud(lineitem_cloud(spark, sf_dir))
    engine.append(cloud.sample(0.5), "pc", _DELTA)
    engine.append(cloud.filter_box(Box((-math.inf,) * 3 + (0.5,), (math.inf,) * 4)).df, "pc")
    return engine


@query(f"WITH {_PC} SELECT {_ID}, x, y, z, i FROM pc WHERE {_IN_BOX} AND i < 0.5::FLOAT")
def collection_box(spark, sf_dir):
    """A box and a sample of a stored collection through its index."""
    engine = _engine(spark, sf_dir)
    engine.build_index("pc")
    return engine.points("20000,10,9500,40000,20,10500", 0.5, "pc").select(*KEYS, "x", "y", "z", "i")


@query(f"WITH {_PC} SELECT {_ID}, x, i FROM pc")
def collection_reopened(spark, sf_dir):
    """All points of a collection, by an engine that finds it in the store."""
    return Engine.open(spark, _engine(spark, sf_dir).store).points(collection="pc").select(*KEYS, "x", "i")


@query("SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag")
def collection_sql(spark, sf_dir):
    return _engine(spark, sf_dir).sql("SELECT l_returnflag, count(*) AS n, max(x) AS hi FROM pc GROUP BY l_returnflag")


@query(f"WITH {_PC} SELECT l_orderkey, x, y, z FROM (SELECT l_orderkey, round(x, 2) AS x, y, z FROM pc) WHERE x >= 20000 AND x < 40000 AND y >= 10 AND y < 20")
def load_las(spark, sf_dir):
    """LAS files loaded into a collection, and a box of it."""
    engine = Engine(spark, _new(spark))
    engine.load(_las(spark, sf_dir, 3), "pc", _DELTA)
    return engine.points("20000,10,40000,20", collection="pc").select(F.col("gps_time").cast("bigint").alias("l_orderkey"), F.round("x", 2).alias("x"), "y", "z")


@query(f"WITH {_EM} SELECT vec_id, label, x, y, z, i FROM em WHERE x >= -0.5 AND x < 0.5")
def service_points(spark, sf_dir):
    """Points sent to the service as an Arrow stream, and a box of them fetched from it."""
    server = serve(Engine(spark, _new(spark)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        urlopen(Request(f"{base}/load?collection=em&delta=0.5,0.5,0.5", ipc.to_stream(embeddings_cloud(spark, sf_dir)), method="POST")).read()
        urlopen(f"{base}/index?collection=em").read()
        body = urlopen(f"{base}/points?collection=em&bounds=-0.5,0.5").read()
    finally:
        server.shutdown()
        server.server_close()
    return ipc.from_stream(spark, body).select("vec_id", "label", "x", "y", "z", "i")


@query(f"WITH {_PC} SELECT {_ID}, x, y, z, i FROM pc")
def stream_ingest(spark, sf_dir):
    """A stream of files into a collection, each micro-batch a folder of its own."""
    table, path, engine = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _new(spark), Engine(spark, _new(spark))
    table.repartition(3, "l_orderkey").write.parquet(path)  # a stream reads a folder
    rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    cloud = rows.select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), days.alias("z"), *KEYS)
    ingest(cloud, engine, "live", _new(spark), _DELTA, KEYS).awaitTermination()
    return engine.points(collection="live").select(*KEYS, "x", "y", "z", "i")


@query(f"SELECT {_ID}, l_extendedprice AS x FROM lineitem")
def random_assignment(spark, sf_dir):
    """Rows dealt to workers by their keys: each row to one."""
    return partition.spread(lineitem_cloud(spark, sf_dir), 8, KEYS).select(*KEYS, "x")


@query("""SELECT n_nationkey, round(least(d, 2 * pi() - d), 9) AS error FROM (SELECT n_nationkey, abs(n_nationkey * 0.7::DOUBLE - n_regionkey * 1.9::DOUBLE) % (2 * pi()) AS d FROM nation)""")
def angle_errors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()  # 25 nations at every scale
    found = [(r.n_nationkey, round(geometry.angle_error(r.n_nationkey * 0.7, r.n_regionkey * 1.9), 9)) for r in rows]
    return spark.createDataFrame(found, "n_nationkey int, error double")


@query(f"""WITH {_BOXES} SELECT c_nationkey, c_mktsegment, lo_x, hi_x, least(lo_y, 0) AS lo_y, hi_y, 0::DOUBLE AS point_area, 'Infinity'::DOUBLE AS hi_z FROM bx""")
def box_builders(spark, sf_dir):
    """From corners in any order, extended by a point, cast to three dimensions; a box of one point has no area."""
    lo, hi = [F.col("lo_x"), F.col("lo_y")], [F.col("hi_x"), F.col("hi_y")]
    made = Box.from_corners((hi[0], lo[1]), (lo[0], hi[1])).add_point((F.col("lo_x"), F.lit(0.0))).cast(3)
    values = {"lo_x": made.lower[0], "hi_x": made.upper[0], "lo_y": made.lower[1], "hi_y": made.upper[1]}
    return _boxes(spark, sf_dir).select(*_BID, *(v.alias(n) for n, v in values.items()), Box.from_point(lo).area().alias("point_area"), F.lit(made.upper[2]).alias("hi_z"))


def _table_query(name: str, table: str, spark_text: str, duck_text: str | None = None, prepare=None) -> None:
    def run(spark, sf_dir):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        if prepare:
            prepare(spark)
        return spark.sql(spark_text)

    run.__name__ = name
    query(duck_text or spark_text)(run)


_table_query("sql_strings", "part", "SELECT p_partkey, upper(p_name) AS name, cast(length(p_type) AS BIGINT) AS n, substr(p_type, 1, 5) AS kind, replace(p_brand, '#', '-') AS brand, concat(p_brand, '/', p_type) AS both, p_name LIKE '%e%' AS has_e FROM part")
_PARTS = "SELECT o_orderkey, cast(year(o_orderdate) AS INT) AS y, cast(month(o_orderdate) AS INT) AS m, cast(day(o_orderdate) AS INT) AS d, cast(quarter(o_orderdate) AS INT) AS q"
_table_query("sql_dates", "orders", f"{_PARTS}, datediff(cast(o_orderdate AS DATE), DATE '1995-01-01') AS days FROM orders", f"{_PARTS}, cast(date_diff('day', DATE '1995-01-01', cast(o_orderdate AS DATE)) AS INT) AS days FROM orders")
_table_query("sql_arrays", "embeddings", "SELECT vec_id, cast(size(embedding) AS BIGINT) AS n, array_max(embedding) AS hi, array_min(embedding) AS lo, embedding[0] AS head, cast(size(filter(embedding, v -> v > 0)) AS BIGINT) AS above FROM embeddings", "SELECT vec_id, len(embedding) AS n, list_max(embedding) AS hi, list_min(embedding) AS lo, embedding[1] AS head, len(list_filter(embedding, lambda v: v > 0)) AS above FROM embeddings")
_table_query("sql_udf", "customer", "SELECT c_custkey, doubled(c_acctbal) AS d FROM customer", "SELECT c_custkey, 2 * c_acctbal AS d FROM customer", lambda spark: register_function(spark, "doubled", lambda s: s * 2, "double"))
