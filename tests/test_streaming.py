"""The stream must say what the batch job says, however the rows are cut into batches."""

from dialoglake.operators import cleaning
from dialoglake.streaming.live import mark_hallucinations_live

SCHEMA = "media_id string, seq long, start double, end double, text string"


def test_stream_equals_batch(spark, tmp_path):
    said = ["はい。", "はい", "おわり", "はい！", " ", "。。", "別", "はい", "ハイハイハイ", "はい", "別"]
    rows = [(m, i, 0.0, 1.0, t) for i, t in enumerate(said) for m in "ab"]
    phrases = spark.createDataFrame([("おわり",)], "phrase string")
    for n in range(0, len(rows), 5):
        spark.createDataFrame(rows[n : n + 5], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = mark_hallucinations_live(stream, phrases).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    want = cleaning.mark_hallucinations(spark.createDataFrame(rows, SCHEMA), phrases)
    pick = lambda df: sorted((x.media_id, x.seq, x.reason) for x in df.collect())
    assert pick(spark.table("live")) == pick(want)
