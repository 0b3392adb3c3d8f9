from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.streaming.file_drop import score_stream, stream_files

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def scorer(df):
    return df.withColumn("spam_probability", F.length("text") / 100.0)


def test_late_files_are_scored_once(spark, tmp_path):
    drop, out, progress = (str(tmp_path / n) for n in ("drop", "out", "progress"))

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(drop)
        score_stream(stream_files(spark, drop, SCHEMA, max_files=1), scorer, out, progress, max_length=20_000).awaitTermination()
        return {r["id"]: (r["status"], r["spam_probability"]) for r in spark.read.parquet(out).collect()}

    assert arrive([(1, " a  b "), (2, " "), (3, "x" * 20001)]) == {1: ("ok", 0.03), 3: ("text_too_large", None)}
    assert set(arrive([(4, "new")])) == {1, 3, 4}
    assert spark.read.parquet(out).count() == 3


def test_long_texts_are_scored_by_default(spark, tmp_path):
    drop, out, progress = (str(tmp_path / n) for n in ("drop", "out", "progress"))
    spark.createDataFrame([(1, "x" * 20001)], SCHEMA).write.json(drop)

    def aggregating(df):  # a scorer that Column-only streams could not run
        return df.join(df.groupBy("id").agg(F.max(F.length("text")).alias("spam_probability")), "id")

    score_stream(stream_files(spark, drop, SCHEMA), aggregating, out, progress).awaitTermination()
    assert [(r["status"], r["spam_probability"]) for r in spark.read.parquet(out).collect()] == [("ok", 20001)]
