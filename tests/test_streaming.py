"""Streams give what batches give."""

from quillmark.operators import words
from quillmark.streaming import rowlocal


def test_streams(spark, tmp_path):
    rows = [(1, "The cat sat (Smith, 2001). It ran."), (2, None)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    for build, columns in ((rowlocal.readability_stream, ["doc_id", "n_words"]), (rowlocal.citation_stream, ["doc_id", "citation_text", "start_pos"])):
        q = build(stream).writeStream.format("memory").queryName("got").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
        batch = build(spark.read.parquet(source))
        assert sorted(spark.table("got").select(*columns).collect()) == sorted(batch.select(*columns).collect())
    q = stream.writeStream.foreachBatch(rowlocal.per_batch(words.text_stats, str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
