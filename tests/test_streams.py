import random

from pyspark.sql import functions as F

from trackframe.operators import contracts as ct
from trackframe.streaming import judge as sj
from trackframe.streaming import windows as sw

SHAPE = "session long, seq long, verdict string, score double, has_deltas boolean, sec long"


def _rows(n, seed=2):
    rng = random.Random(seed)
    kinds = ["tune"] * 6 + ["good", "wrong_class", "reset"]
    return [(7, k, rng.choice(kinds), round(rng.random() * 0.85, 3), rng.random() < 0.9, 10_000 + 2 * k) for k in range(n)]


def _stream(spark, rows, folder, files):
    """The rows as a stream of shuffled files, one file a batch."""
    rng = random.Random(5)
    rows = rows[:]
    rng.shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], SHAPE).withColumn("ts", F.timestamp_seconds("sec")).drop("sec").coalesce(1).write.mode("append").parquet(folder)
    shape = spark.read.parquet(folder).schema
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)


def _answers(rows):
    policy, out = sj.Policy(), []
    for _, seq, verdict, score, deltas, _ in sorted(rows, key=lambda r: r[1]):
        got = policy.take(seq, verdict, score, deltas)
        if got:
            out.append((seq, *got, False))
    return out


def test_a_long_session_in_shuffled_files_gives_the_ordered_answer(spark, tmp_path):
    rows = _rows(50_000)
    stream = _stream(spark, rows, str(tmp_path / "in"), 3)
    got = sj.drain(stream, "long", ttl="3 days", hold="2 days").select("seq", "iteration", "go", "reason", "best", "stopped", "late").orderBy("seq").collect()
    assert list(map(tuple, got)) == _answers(rows)


def test_rows_after_their_turn_are_counted_as_late(spark, tmp_path):
    rows = [(s, k, "tune", 0.1 * k, True, 10_000 + 3600 * k) for s in (1, 2) for k in range(6) if k != 2]
    folder = str(tmp_path / "in")
    write = lambda r: spark.createDataFrame(r, SHAPE).withColumn("ts", F.timestamp_seconds("sec")).drop("sec").coalesce(1).write.mode("append").parquet(folder)
    write(rows)
    shape = spark.read.parquet(folder).schema
    stream, end = sj.with_end(spark.readStream.schema(shape).parquet(folder), str(tmp_path / "end"))
    made = sj.judge_stream(stream, ttl="1 day", hold="1 hour")
    writer = lambda: made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
    writer().trigger(availableNow=True).start().awaitTermination()
    write([(1, 2, "tune", 0.2, True, 10_000 + 7200)])  # its successors were taken
    sj.run_to_end(writer, end)
    got = spark.read.schema(made.schema).parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in sj.late_counts(got).collect()] == [(1, 1)]
    assert sorted(r.seq for r in got.filter("session = 1 and not late").collect()) == [0, 1, 3, 4, 5]
    assert sorted(r.seq for r in got.filter("session = 2").collect()) == [0, 1, 3, 4, 5]


def test_stream_and_table_share_their_rules(spark):
    rows = [r for r in _rows(400, 9) if r[2] != "reset"]
    df = spark.createDataFrame(rows, SHAPE).withColumn("i", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("seq")).cast("long") - 1)
    table = {r.i: (r.go, r.reason) for r in ct.judge_policy(df).collect()}
    policy = sj.Policy()
    for i, (_, seq, verdict, score, deltas, _) in enumerate(rows):
        policy.stopped = False
        _, go, reason, _, _ = policy.take(seq, verdict, score, deltas)
        assert table[i] == (go, reason)


def test_every_window_comes_out(spark, tmp_path):
    rows = [(1, 100 + k // 4 * 0.05, k // 4, k // 2 % 2, k % 2, 0.1 * (k % 7), 0.2 * (k % 5), True) for k in range(800)]
    df = spark.createDataFrame(rows, "clip long, sec double, t long, gy long, gx long, vx double, vy double, valid boolean").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    df.write.parquet(str(tmp_path / "in"))
    got = sw.distill_windows(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")), fps=20.0)
    assert sorted(r.start.timestamp() for r in got.collect()) == [100.0, 104.0, 108.0]
