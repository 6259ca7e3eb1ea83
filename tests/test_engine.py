import pytest
from pyspark.sql import functions as F

from cloudgrid.functions.box import Box
from cloudgrid.plans.engine import Engine, NotFound
from cloudgrid.sources import ipc
from cloudgrid.streaming.ingest import ingest


def points(spark, n=2000, start=0):
    return spark.range(start, start + n).selectExpr("id", "cast(id % 50 as double) x", "cast(id div 50 as double) y", "cast(id % 3 as double) z")


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark, f"file://{tmp_path}/store")
    made.append(points(spark), delta="10,10,0,0.125", keys=["id"])
    return made


def test_points(engine):
    assert engine.points().count() == 2000
    got = engine.points("0,0,0,10,5,9", p=0.5)
    assert got.columns == ["i", "id", "x", "y", "z"]
    assert {r.id for r in got.collect()} == {r.id for r in engine.points().where("x < 10 and y < 5 and i < 0.5").collect()}
    assert engine.points("0,0,0,9,9,9", budget=5).count() == 5


def test_index_is_exact_and_goes_stale(engine, spark):
    want = sorted(engine.points("5,5,0,25,25,9", 0.7).collect())
    stats = engine.build_index()
    assert stats.agg(F.sum("n_points")).first()[0] == 2000
    assert sorted(engine.points("5,5,0,25,25,9", 0.7).collect()) == want
    engine.append(points(spark, 500, 5000), keys=["id"])
    assert not engine.status()["default"]["indexed"] and engine.points().count() == 2500
    engine.build_index()
    engine.drop_index()
    assert not engine.status()["default"]["indexed"]


def test_streams(engine, spark):
    body = engine.points_stream("0,0,0,10,5,9")
    engine.append(body, "copy")
    assert engine.points(collection="copy").count() == engine.points("0,0,0,10,5,9").count()
    assert ipc.from_stream(spark, engine.points_stream("0,0,0,0,0,0")).count() == 0


def test_unknown_and_dropped_collections(engine):
    with pytest.raises(NotFound):
        engine.points(collection="other")
    engine.drop()
    engine.drop()
    with pytest.raises(NotFound):
        engine.points()


def test_columns_must_agree(engine, spark):
    with pytest.raises(ValueError):
        engine.append(points(spark).withColumn("more", F.lit(1)), keys=["id"])


def test_pruning(engine):
    plan = engine.points("10,10,0,20,20,9", 0.1)._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")
    assert "ci" in filters[0] and "LessThan(x,20.0)" in filters[1] and "cx" in filters[1]


def test_random_importance_is_stored(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    e.append(points(spark), seed=3)
    assert sorted(e.points(p=0.2).collect()) == sorted(e.points(p=0.2).collect())


def test_load_fractions(spark, tmp_path):
    src = f"{tmp_path}/a.parquet"
    points(spark).write.parquet(src)
    e = Engine(spark, f"file://{tmp_path}/s")
    for k in range(4):
        e.load(src, "parts", start=k / 4, end=(k + 1) / 4, keys=["id"])
    assert e.points(collection="parts").select("id").distinct().count() == e.points(collection="parts").count() == 2000
    e.load(src, "half", start=0.0, end=0.5)
    assert 800 < e.points(collection="half").count() < 1200


def test_sql(engine):
    assert engine.sql("SELECT count(*) FROM default").first()[0] == 2000


def test_box_of_a_cloud(engine):
    assert engine.cloud().bounds().cast(3) == Box((0, 0, 0), (49, 39, 2))


def test_streaming_ingest(spark, tmp_path):
    src = f"{tmp_path}/in"
    points(spark).repartition(3).write.parquet(src)
    e = Engine(spark, f"file://{tmp_path}/s")
    stream = spark.readStream.schema(points(spark).schema).option("maxFilesPerTrigger", 1).parquet(src)
    ingest(stream, e, "live", f"{tmp_path}/cp", "10,10", ["id"]).awaitTermination(120)
    assert e.points(collection="live").count() == 2000


def test_service(engine, spark):
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from cloudgrid.plans.service import serve

    server = serve(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        body = urlopen(f"{base}/points?bounds=0,0,0,10,5,9&p=0.5").read()
        assert ipc.from_stream(spark, body).count() == engine.points("0,0,0,10,5,9", 0.5).count()
        urlopen(Request(f"{base}/load?collection=sent", body, method="POST"))
        assert b'"sent"' in urlopen(f"{base}/status").read()
        urlopen(f"{base}/index?collection=sent")
        assert engine.status()["sent"]["indexed"]
        urlopen(Request(f"{base}/index", method="DELETE"))
        urlopen(Request(f"{base}/load?collection=sent", method="DELETE"))
        assert "sent" not in engine.status()
        for path, code in (("/points?collection=sent", 404), ("/odd", 404), ("/points?bounds=1,2,3", 400), ("/load", 400)):
            with pytest.raises(HTTPError) as e:
                urlopen(base + path)
            assert e.value.code == code
    finally:
        server.shutdown()


def test_a_hot_cell_is_split(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    for n in names:
        spark.conf.set(n, "64k")
    try:
        e.append(spark.range(100_000).selectExpr("id", "1D x", "1D y", "1D z"), "hot", "10,10", ["id"])
    finally:
        for n in names:
            spark.conf.unset(n)
    assert e.cloud("hot").df.inputFiles().__len__() > 3 and e.points(collection="hot").count() == 100_000


def test_reopened_store(engine, spark):
    engine.build_index()
    engine.append(points(spark, 10, 9000), "other", keys=["id"])
    again = Engine.open(spark, engine.store)
    assert again.status() == engine.status()
    assert sorted(again.points("5,5,0,25,25,9", 0.7).collect()) == sorted(engine.points("5,5,0,25,25,9", 0.7).collect())
    again.append(points(spark, 10, 7000), keys=["id"])
    again.drop("other")
    third = Engine.open(spark, engine.store)
    assert third.points().count() == 2010 and list(third.collections) == ["default"]
    assert Engine.open(spark, engine.store + "-none").collections == {}


def test_a_batch_replaces_itself(engine, spark):
    for _ in range(2):
        engine.append(points(spark, 10, 9000), keys=["id"], batch="7")
    assert engine.points().count() == 2010
    engine.append(points(spark, 10, 9000), keys=["id"])
    assert engine.points().count() == 2020


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from cloudgrid.sources.files import shared_root

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(ValueError):
        shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file://")
