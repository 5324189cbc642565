import datetime

from fixtures import package
from pyspark.sql import functions as F

from foliospark.operators import nodes as N
from foliospark.streaming import ingest


def test_ingest(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.hwpx").write_bytes(package())
    (source / "junk.bin").write_bytes(b"?")

    def run():
        ingest.ingest_packages(ingest.watch(spark, str(source)), str(out), str(tmp_path / "state")).awaitTermination()

    run()
    (source / "b.hwpx").write_bytes(package())
    run()
    run()
    parts, nodes = (spark.read.parquet(f"{out}/{t}") for t in ("parts", "nodes"))
    assert parts.select("doc").distinct().count() == 2 and parts.where("path = 'mimetype'").count() == 2
    assert N.select(nodes, "tables").count() == 2


def test_windowed_counts(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(minutes=m), k) for m, k in ((0, "a"), (1, "a"), (6, "b"), (7, "a"), (60, "a"))]
    spark.createDataFrame(rows, "ts timestamp, kind string").write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_counts(spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in")), "ts", "kind")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.start.hour * 60 + r.start.minute, r.kind): r.n for r in spark.table("counts").where(F.col("n") > 0).collect()}
    assert got == {(0, "a"): 2, (5, "b"): 1, (5, "a"): 1, (60, "a"): 1}
