"""Running values over ranges, retention of crossings and the standing of transfers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from maskwright.operators import disclosure, ordered


def test_running_values_equal_those_of_one_loop(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", None]), i, r.choice([None, 1, 2, 30]), r.choice([None, "x", "y"]), r.random() < 0.2, "kept") for i in range(400)]
    df = spark.createDataFrame(rows, "key string, n int, v int, word string, mark boolean, _other string")
    sums, last, want = {}, {}, {}
    for key, n, v, word, mark, _ in rows:
        sums[key] = sums.get(key, 0) + (v or 0)
        if mark:
            last[key] = word
        want[n] = (sums[key], last.get(key))
    for ranges in (1, 7, 64):
        got = ordered.running_sums(df, ["key"], [F.col("n")], {"total": F.col("v")}, ranges)
        assert got.columns == [*df.columns, "total"]
        assert {x.n: x.total for x in got.collect()} == {n: t for n, (t, _) in want.items()}
        marked = ordered.last_marked(df, ["key"], [F.col("n")], F.col("mark"), F.col("word"), "said", ranges)
        assert {x.n: x.said for x in marked.collect()} == {n: w for n, (_, w) in want.items()}
    held = ordered.ranged(df, ["key"], [F.col("n")], 7)
    assert held.where("key = 'hot'").select("_range").distinct().count() > 1
    assert ordered.running_sums(df.limit(0), ["key"], [F.col("n")], {"total": F.col("v")}).count() == 0


def test_retention_keeps_the_newest(spark):
    df = spark.createDataFrame([("s", i, 10 if i != 4 else None) for i in range(10)] + [("t", 1, 100)], "session string, id int, bytes int")
    got = {(x.session, x.id): (x.record_kept, x.body_kept) for x in disclosure.retention(df, ["session"], records=6, bodies=30).collect()}
    assert [got["s", i] for i in range(10)] == [(False, False)] * 4 + [(True, False)] * 3 + [(True, True)] * 3 and got["t", 1] == (True, False)
    one = disclosure.retention(df.where("session = 's'"), ["session"]).where("record_kept").select("id", "body_kept").collect()
    assert {tuple(x) for x in one} == {(x.id, x.kept) for x in disclosure.retained(df.where("session = 's'")).collect()}


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def test_transfers_stand_as_last_decided_and_within_their_period(spark):
    rows = [
        ("a1", "w", "r", "allowed", "p", at(2), None, at(5), 1), ("a2", "w", "r", "refused", "p", at(6), None, None, 1), ("a3", "w", "r", "allowed", "p", at(8), at(9), None, 1), ("a4", "w", "r", "withdrawn", "p", at(12), None, None, 1),
        ("b1", "tie", "r", "refused", "p", at(1), None, None, 1), ("b2", "tie", "r", "allowed", "p", at(1), None, None, 1), ("../x", "w", "r", "allowed", "p", at(0), None, None, 1), (None, "w", "r", "allowed", "p", at(0), None, None, 1), ("n1", None, "r", "allowed", "p", at(0), None, None, 1),
    ]
    df = spark.createDataFrame(rows, "id string, what string, run string, verdict string, by string, at timestamp, valid_from timestamp, valid_to timestamp, hidden int")
    decided = disclosure.transfers(df, ["hidden", "run"])
    assert decided.columns == ["id", "what", "run", "verdict", "by", "at", "valid_from", "valid_to", "hidden"] and decided.count() == 7
    asked = spark.createDataFrame([(h, "w", at(h)) for h in (1, 2, 4, 5, 7, 8, 9, 12, 30)] + [(50, "tie", at(1)), (51, "unknown", at(1)), (52, None, at(1))], "ask_id int, what string, at timestamp")
    got = {x.ask_id: (x.decision, x.standing) for x in disclosure.standing(asked, decided).collect()}
    assert got == {
        1: (None, "undecided"), 2: ("a1", "allowed"), 4: ("a1", "allowed"), 5: ("a1", "lapsed"), 7: ("a2", "refused"), 8: ("a3", "early"), 9: ("a3", "allowed"), 12: ("a4", "withdrawn"), 30: ("a4", "withdrawn"),
        50: ("b2", "allowed"), 51: (None, "undecided"), 52: ("n1", "allowed"),
    }
    later = {x.ask_id: x.standing for x in disclosure.standing(asked.where("what = 'w'"), decided, F.lit(at(3))).collect()}
    assert later == {1: "early", 2: "allowed", 4: "allowed", **{h: "lapsed" for h in (5, 7, 8, 9, 12, 30)}}  # as was known at three
    assert disclosure.standing(asked.limit(0), decided).count() == 0
