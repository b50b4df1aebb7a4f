"""The stream sampler against the batch operator, on micro-batches in any order within the lateness, and late rows."""

import random

from pyspark.sql import functions as F

from attesta.operators import photos
from attesta.streaming import sampling

FRAMES = "video long, idx long, t long"


def run(spark, tmp_path, batches: list, every: int, most: int, lateness: str) -> list:
    """Each batch becomes a file, and each file a micro-batch."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, FRAMES).select("video", "idx", F.timestamp_millis("t").alias("ts")).coalesce(1)
        df.write.parquet(str(folder / f"b={i:03d}"))
    stream = spark.readStream.schema("video long, idx long, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")
    return sorted(tuple(r) for r in sampling.run_to_end(sampling.sample_stream(stream, every, most, lateness)).select("video", "idx", "place").collect())


def batch(spark, rows: list, every: int, most: int) -> list:
    df = spark.createDataFrame(rows, FRAMES).select("video", "idx").distinct()
    return sorted((r.video, r.idx, r.k) for r in photos.sample_frames(df, F.lit(float(every)), most).collect())


def test_stream_equals_batch_on_shuffled_micro_batches(spark, tmp_path):
    r = random.Random(3)
    rows = [(v, i, 1_000_000 + 100 * i + v) for v in range(5) for i in range(0, 60 + 10 * v)]
    late = sorted(rows + rows[:20], key=lambda x: x[2] + r.uniform(0, 900))  # up to 0.9 seconds out of order, some twice
    batches = [late[a : a + 45] for a in range(0, len(late), 45)]
    end = [(99, 0, 10_000_000)]
    got = [x for x in run(spark, tmp_path, [*batches, end, [(99, 3, 20_000_000)]], 3, 8, "1 second") if x[0] != 99]
    assert got == batch(spark, rows, 3, 8) and len(got) == 5 * 8


def test_rows_beyond_the_lateness_are_dropped(spark, tmp_path):
    batches = [[(1, 10, 10_000)], [(1, 20, 60_000)], [(1, 5, 5_000), (1, 30, 61_000)], [(2, 0, 900_000)], [(2, 5, 990_000)]]
    got = run(spark, tmp_path, batches, 5, 10, "1 second")
    assert [x for x in got if x[0] == 1] == [(1, 10, 1), (1, 20, 2), (1, 30, 3)]
