import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import SMALL
from pixquill.operators import corpus
from pixquill.sources import tables
from pixquill.streaming import ingest, serve


def test_ingest_resumes(spark, path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(
        F.concat(F.lit("http://h/"), "doc_id").alias("image_url"), F.col("text").alias("capsfusion")
    )
    docs.repartition(5).write.parquet(f"{path}/in")
    total = docs.count()

    def run():
        stream = ingest.stream_folder(spark, f"{path}/in", tables.LINKS, files_per_batch=2)

        def step(batch):
            return corpus.assign_identifier(batch).withColumns(
                {"original_width": F.lit(1), "original_height": F.lit(1)}
            )

        ingest.ingest_incremental(stream, f"{path}/out", f"{path}/ckpt", step)
        return tables.read_manifest(spark, f"{path}/out")

    first = run()
    assert first.count() == total
    assert first.select("batch_id").distinct().count() == 3
    assert first.where(F.col("file").contains("batch_id=")).count() == total
    assert run().count() == total
    more = docs.select(F.concat("image_url", F.lit("/2")).alias("image_url"), "capsfusion")
    more.coalesce(1).write.mode("append").parquet(f"{path}/in")
    final = run()
    assert final.count() == 2 * total
    assert final.select("identifier").distinct().count() == 2 * total
    left = corpus.not_done(corpus.assign_identifier(docs), first)
    assert left.count() == 0


class Stopped(Exception):
    pass


def dies_at(number):
    def written(batch_id):
        if batch_id == number:
            raise Stopped
    return written


@pytest.mark.parametrize("at", [0, 2])
def test_batch_is_repeated_after_a_failure_before_its_commit(spark, path, at):
    spark.range(50).selectExpr("concat('u', id) image_url", "'c' capsfusion").repartition(10, "image_url").write.parquet(f"{path}/in")
    seen = []

    def run(written=None):
        stream = ingest.stream_folder(spark, f"{path}/in", tables.LINKS, files_per_batch=2)

        def step(batch):
            seen.append(batch.count())
            return corpus.assign_identifier(batch).withColumns({"original_width": F.lit(1), "original_height": F.lit(1)})

        ingest.ingest_incremental(stream, f"{path}/out", f"{path}/ckpt", step, written)

    with pytest.raises(StreamingQueryException):
        run(dies_at(at))
    before = tables.read_manifest(spark, f"{path}/out").count()
    assert 0 < before < 50 and len(seen) == at + 1
    run()
    done = tables.read_manifest(spark, f"{path}/out")
    assert done.count() == 50 and done.select("image_url").distinct().count() == 50
    assert sum(seen) == 50 + seen[at] and seen[at + 1] == seen[at]  # the same files again


def test_counts_of_batches_add_up_through_failures_and_folds(spark, path):
    schema, target = "id bigint, status string", f"{path}/counts"
    rows = spark.range(90).selectExpr("id", "if(id % 3 = 0, 'failed', 'ok') status")

    def totals():
        return {r["status"]: r["n_rows"] for r in ingest.read_running_counts(spark, target).collect()}

    def run(written=None):
        source = ingest.stream_folder(spark, f"{path}/in", schema, files_per_batch=2)
        ingest.write_running_counts(source, target, f"{path}/ckpt", written=written)

    rows.repartition(8, "id").write.parquet(f"{path}/in")
    with pytest.raises(StreamingQueryException):
        run(dies_at(1))
    run()
    assert totals() == {"ok": 60, "failed": 30}
    # a batch holds its own rows alone
    each = spark.read.parquet(target).groupBy("batch_id").agg(F.sum("n_rows").alias("n")).collect()
    assert len(each) == 4 and sum(r["n"] for r in each) == 90
    assert ingest.compact_running_counts(spark, target) == 3 and ingest.compact_running_counts(spark, target) == 3
    assert totals() == {"ok": 60, "failed": 30}
    rows.limit(9).coalesce(1).write.mode("append").parquet(f"{path}/in")
    with pytest.raises(StreamingQueryException):
        run(dies_at(4))
    run()
    assert sum(totals().values()) == 99
    assert ingest.compact_running_counts(spark, target) == 4 and sum(totals().values()) == 99


def test_stream_of_a_table_that_is_a_folder_or_a_file(spark, path):
    spark.range(5).write.parquet(f"{path}/folder.parquet")
    spark.range(7).coalesce(1).write.parquet(f"{path}/other")
    part = next(f for f in os.listdir(f"{path}/other") if f.endswith(".parquet"))
    os.makedirs(f"{path}/flat")
    os.rename(f"{path}/other/{part}", f"{path}/flat/file.parquet")
    for folder, n in ((f"{path}/folder.parquet", 5), (f"{path}/flat", 7)):
        source = ingest.stream_folder(spark, folder, "id bigint")
        ingest.ingest_incremental(source, f"{folder}-out", f"{folder}-ckpt")
        assert spark.read.parquet(f"{folder}-out").count() == n


def test_absent_manifest_is_empty(spark, path):
    assert tables.read_manifest(spark, f"{path}/none").count() == 0


def test_running_counts(spark, path):
    schema = "status string"
    spark.createDataFrame([("ok",), ("ok",), ("failed",)], schema).write.parquet(f"{path}/in")
    counts = ingest.running_counts(ingest.stream_folder(spark, f"{path}/in", schema))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["status"]: r["n_rows"] for r in spark.table("running").collect()} == {"ok": 2, "failed": 1}


def test_serve_stream(spark, path):
    os.makedirs(f"{path}/req")
    rows = [
        {"request_id": "1", "message": " What? ", "image": "data:image/png;base64,aGk="},
        {"request_id": "2", "message": "  ", "image": None},
    ]
    with open(f"{path}/req/a.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))

    def predict(df):
        return df.withColumn("reply", F.concat(F.col("prompt"), F.lit("assistant\n\nreply "), F.coalesce(F.octet_length("image_bytes"), F.lit(0)).cast("string")))

    def answers():
        serve.serve_stream(spark, f"{path}/req", f"{path}/rep", f"{path}/ck", predict, extract=True)
        return {r["request_id"]: r["response"] for r in spark.read.parquet(f"{path}/rep").collect()}

    assert answers() == {"1": "reply 2", "2": "reply 0"}
    with open(f"{path}/req/b.json", "w") as f:
        f.write(json.dumps({"request_id": "3", "message": "more", "image": ""}))
    assert answers() == {"1": "reply 2", "2": "reply 0", "3": "reply 0"}
