"""The stream of latest sightings against the batch over the same rows."""

import random

from pyspark.sql import functions as F

from ledgerfold.operators.authorship import copied_shingles
from ledgerfold.streaming.sightings import copied_stream

SCHEMA = "id string, conversation_id string, text string, sent_at timestamp"
PHRASES = ["one two three four five six seven eight nine", "a b c d e f g h", "never said by any agent at all here", "short"]


def rows(seed, n, prefix):
    rng = random.Random(seed)
    return [(f"{prefix}{i}", f"c{i % 3}", rng.choice(PHRASES), 1_767_225_600 + rng.randint(0, 5 * 86_400) // 600 * 600 + rng.choice([0, 0, 1])) for i in range(n)]


def put(spark, path, found):
    df = spark.createDataFrame(found, "id string, conversation_id string, text string, s long").selectExpr("id", "conversation_id", "text", "timestamp_seconds(s) sent_at")
    df.coalesce(1).write.mode("append").parquet(str(path))
    return df


def run(spark, home):
    read = lambda n: spark.readStream.schema(SCHEMA).parquet(str(home / n))
    out = copied_stream(read("user"), read("agent"), delay="30 days")
    out.writeStream.format("parquet").option("checkpointLocation", str(home / "ck")).trigger(availableNow=True).start(str(home / "out")).awaitTermination()


def flat(df):
    ref = lambda r: None if r is None else tuple(r)
    return sorted((r["id"], r["pos"], ref(r["agent_ref"]), ref(r["user_ref"])) for r in df.collect())


def test_stream_equals_batch_after_restarts_and_disorder(spark, tmp_path):
    user, agent = rows(1, 40, "u"), rows(2, 40, "a")
    put(spark, tmp_path / "agent", agent[:20])
    put(spark, tmp_path / "user", user[:25])
    run(spark, tmp_path)
    put(spark, tmp_path / "agent", agent[20:])  # older and newer than what was read before
    put(spark, tmp_path / "user", user[25:])
    run(spark, tmp_path)
    put(spark, tmp_path / "user", [("late", "c", "short", 1_767_225_600 + 100 * 86_400)])  # moves the watermark past all
    run(spark, tmp_path)
    run(spark, tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = lambda n: spark.read.schema(SCHEMA).parquet(str(tmp_path / n))
    want = flat(copied_shingles(batch("user"), batch("agent")))
    assert flat(got) == want
    assert any(r[2] for r in want) and any(r[3] for r in want) and any(not r[2] for r in want)
    assert got.where(F.col("agent_ref.secs") < F.col("secs") - 48 * 3600).count() == 0


def test_late_runs_are_dropped_and_state_ends(spark, tmp_path):
    read = lambda n: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / n))

    def go():
        q = copied_stream(read("user"), read("agent"), delay="1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
        q = q.trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return q

    day = 86_400
    put(spark, tmp_path / "agent", [("a1", "c", PHRASES[0], 10 * day)])
    put(spark, tmp_path / "user", [("u1", "c", PHRASES[0], 11 * day), ("end", "c", "short", 12 * day), ("x", "c", PHRASES[1], 12 * day)])
    go()
    put(spark, tmp_path / "user", [("lost", "c", PHRASES[0], 9 * day), ("far", "c", PHRASES[1], 40 * day)])
    go()
    put(spark, tmp_path / "user", [("farther", "c", PHRASES[2], 80 * day)])
    q = go()
    got = {r["id"]: r["agent_ref"] for r in spark.read.parquet(str(tmp_path / "out")).where("pos = 0").collect()}
    assert set(got) >= {"u1", "x", "far"} and "lost" not in got and got["u1"]["id"] == "a1" and got["far"] is None
    # the state has nothing left but the last message's runs, which wait for the watermark
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * len(PHRASES[2].split())
