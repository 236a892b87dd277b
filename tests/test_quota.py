"""Quotas in batches and in streams of any split, with replays."""

import datetime
import random

import pytest

from ledgerlark.operators.quota import RESULT, quota_states
from ledgerlark.streaming.quota import quota_stream

SCHEMA = "user_id long, seq long, at timestamp, kind string, timezone string, n int, order_id string, plan_id string, pages int, day int"


def event(user, seq, hour, kind, zone=None, n=None, order=None, plan=None, pages=None):
    return (user, seq, datetime.datetime(2024, 3, 1) + datetime.timedelta(hours=hour), kind, zone, n, order, plan, pages, 0)


def test_resets_caps_and_orders(spark):
    events = [
        event(1, 1, 0, "use", n=9), event(1, 2, 1, "payment", order="a", plan="monthly_x", pages=10), event(1, 3, 2, "use", n=30), event(1, 4, 3, "payment", order="a", plan="yearly", pages=99),
        event(1, 5, 4, "payment", order="b", plan=None, pages=-5), event(1, 6, 18, "check", "UTC"), event(1, 7, 20, "check", "Asia/Kolkata"), event(1, 8, 20, "use"), event(1, 9, 21, "check", "America/New_York"),
        event(1, 10, 50, "payment", plan="yearly", pages=7), event(2, 1, 0, "check", "bad" and None), event(2, 2, 0, "other"), event(2, 3, 30, "use", n=0), event(2, 4, 31, "check"),
    ]
    found = {(r["user_id"], r["seq"]): r for r in quota_states(spark.createDataFrame(events + events[2:5], SCHEMA)).collect()}
    assert len(found) == len(events)
    used = lambda u: [(r["pages_used"], r["pages_limit"]) for (x, _), r in sorted(found.items()) if x == u]
    assert used(1) == [(None, None), (0, 10), (30, 10), (30, 10), (10, 10), (10, 10), (0, 10), (1, 10), (1, 10), (1, 10)]
    assert used(2) == [(0, 5), (0, 5), (1, 5), (0, 5)]
    assert [found[1, s]["needs_reset"] for s in (6, 7, 9)] == [False, True, False] and found[1, 4]["already_processed"] and not found[1, 5]["already_processed"]
    assert (found[1, 3]["tier"], found[1, 5]["tier"], found[2, 1]["tier"], found[1, 10]["pages_added"]) == ("daily", "free", "free", None)


@pytest.mark.parametrize("seed, batches", [(1, 1), (2, 4), (3, 13)])
def test_a_stream_of_any_split_and_replay_gives_the_same(spark, tmp_path, seed, batches):
    rng = random.Random(seed)
    events = []
    for user in range(5):
        hour = 0
        for seq in range(60):
            hour += rng.randint(0, 9)
            zone = rng.choice([None, "UTC", "Asia/Kolkata", "America/New_York"])
            events.append(event(user, seq, hour, rng.choice(["check", "use", "use", "payment", "other"]), zone, rng.choice([None, 0, 3]), rng.choice([None, "a", "b", "c", "d", "e"]), rng.choice([None, "yearly_x", "monthly", "p"]), rng.choice([None, -1, 4, 20])))
    expected = sorted(map(repr, quota_states(spark.createDataFrame(events, SCHEMA)).collect()))
    cuts = sorted(rng.sample(range(1, 60), batches - 1))
    source = tmp_path / "in"
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60])):
        part = [e for e in events if a <= e[1] < b] + [e for e in events if e[1] < b and rng.random() < 0.2]  # some come again
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / f"{i:02d}"))
        found = []
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(source))
        query = quota_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n, i=i: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"{i}-{n}"))).trigger(availableNow=True).start()
        query.awaitTermination(120)
    found = spark.read.schema(RESULT).parquet(*[str(p) for p in (tmp_path / "out").iterdir()]).collect()
    assert sorted(map(repr, found)) == expected


def test_no_events(spark):
    assert quota_states(spark.createDataFrame([], SCHEMA)).count() == 0
