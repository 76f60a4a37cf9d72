"""State that is carried between batches: what runs again changes nothing, what is not touched stays."""

import pandas as pd
from pyspark.sql import functions as F

from feedlens.streaming import backfill, cards, deals, outbox


def ids(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, list string")


def test_deals_keep_places_and_put_newcomers_behind(spark, tmp_path):
    state = str(tmp_path / "s")
    first = ids(spark, *[(n, "a") for n in range(20)], (3, "a"), (None, "a"), (50, None), (3, "b"))
    deals.deal(first, state, 0, "x")
    one = {(r["id"], r["list"]): r["place"] for r in deals.places(spark, state).collect()}
    assert sorted(p for (_, k), p in one.items() if k == "a") == list(range(1, 21)) and one[(50, None)] == 1 and one[(3, "b")] == 1
    assert [i for (i, k), _ in sorted(one.items(), key=lambda x: x[1]) if k == "a"] != list(range(20))
    second = ids(spark, *[(n, "a") for n in range(5, 30)], (60, None))
    for _ in range(2):  # a deal that runs again gives the same
        deals.deal(second, state, 1, "x")
        two = {(r["id"], r["list"]): r["place"] for r in deals.places(spark, state).collect()}
        assert all(two[k] == p for k, p in one.items()) and two[(60, None)] == 2
        assert sorted(two[(n, "a")] for n in range(20, 30)) == list(range(21, 31))
    shown = {r["id"]: r["place"] for r in deals.in_order(second.where("list = 'a'"), state).collect()}
    assert shown == {n: two[(n, "a")] for n in range(5, 30)}
    deals.deal(ids(spark), state, 2, "x")
    assert deals.places(spark, state).count() == len(two)


def votes(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id long, article_id long, vote string, at string").withColumn("queued_at", F.to_timestamp_ntz("at")).drop("at")


def test_outbox_last_write_stop_and_resend(spark, tmp_path):
    state, fails = str(tmp_path / "s"), F.expr("article_id = 5 and number < 2")
    waits = lambda n: sorted((r["user_id"], r["article_id"], r["vote"], r["sent"]) for r in outbox.passes(spark, state).where(f"number = {n}").collect())
    outbox.flush(votes(spark, (1, 7, "more", "2024-01-01"), (1, 2, "more", "2024-01-01"), (1, 2, "less", "2024-01-02"), (1, 5, "less", "2024-01-03"), (2, 9, "more", "2024-01-01"), (None, 1, "more", "2024-01-01")), state, 0, fails)
    assert waits(0) == [(1, 2, "less", True), (1, 5, "less", False), (1, 7, "more", False), (2, 9, "more", True)]
    for _ in range(2):
        outbox.flush(votes(spark, (1, 7, "less", "2023-12-01"), (1, 5, "more", "2024-01-04"), (1, 1, "more", "2024-01-04")), state, 1, fails)
        assert waits(1) == [(1, 1, "more", True), (1, 5, "more", False), (1, 7, "more", False)]
    outbox.flush(votes(spark), state, 2, fails)
    assert waits(2) == [(1, 5, "more", True), (1, 7, "more", True)]
    outbox.flush(votes(spark), state, 3, fails)
    assert waits(3) == []


def shown(*rows):
    return pd.DataFrame(rows, columns=["id", "score", "has_image", "small"])


def test_cards_are_decided_once():
    rows = shown(*[(n, s, n != 4, False) for n, s in enumerate((0.9, 0.95, 0.9, 0.1, 0.95, 0.95, None, 0.2, 0.3, 0.95, *[0.0] * 30))])
    decided = {}
    # four of 39 scores are large: 0.95; the first is 1, 4 has no image, 5 is too near, 9 is far enough
    assert [k for k, x in zip(rows["id"], cards.decide(rows, decided)) if x] == [1, 9]
    changed = rows.assign(score=1 - rows["score"].fillna(0))
    assert [k for k, x in zip(rows["id"], cards.decide(changed, decided)) if x] == [1, 9]
    again = pd.concat([changed, shown((100, 2.0, True, False))])
    assert [k for k, x in zip(again["id"], cards.decide(again, decided)) if x] == [1, 9, 100]
    again.loc[again["id"] == 9, "small"] = True
    assert [k for k, x in zip(again["id"], cards.decide(again, decided)) if x] == [1, 100]
    assert [k for k, x in zip(rows["id"], cards.decide(rows, decided)) if x] == [1]
    assert cards.decide(shown((1, None, True, False)), {}) == [False] and cards.decide(shown((1, 0.0, True, False)), {}) == [True]


def test_cards_stream_takes_lists_one_after_the_other(spark, tmp_path):
    schema = "session string, render long, place long, id long, score double, has_image boolean, small boolean"
    for n, rows in enumerate(([("s", 1, 1, 1, 0.5, True, False), ("s", 1, 2, 2, 0.9, True, False), ("t", 1, 1, 1, 0.1, False, False)], [("s", 2, 1, 1, 0.9, True, False), ("s", 2, 2, 2, 0.1, True, False), ("s", 3, 1, 2, 0.1, True, True)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        cards.show(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.schema(cards.SHOWN).parquet(str(tmp_path / "out")).collect())
    assert got == [("s", 1, 1, 1, False), ("s", 1, 2, 2, True), ("s", 2, 1, 1, False), ("s", 2, 2, 2, True), ("s", 3, 1, 2, False), ("t", 1, 1, 1, False)]


SCHEMA = "id long, a string, b long, part long"


def test_backfill_writes_touched_partitions_only(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = [(n, "old" if n % 4 == 0 else None, None, n % 3) for n in range(12)]
    spark.createDataFrame(rows, SCHEMA).write.partitionBy("part").parquet(target)
    files = lambda: {p: sorted(x.name for x in (tmp_path / "t" / f"part={p}").glob("*.parquet")) for p in range(3)}
    late = spark.createDataFrame([(1, "new", 5), (4, "new", None), (99, "x", 1), (None, "x", 1), (1, "a", 7)], "id long, a string, b long")
    before = files()
    assert backfill.fill(spark, target, SCHEMA, "part", late, "id", ["a", "b"]) == 1
    after = files()
    assert after[0] == before[0] and after[2] == before[2] and after[1] != before[1]
    read = lambda: {r["id"]: (r["a"], r["b"]) for r in spark.read.schema(SCHEMA).parquet(target).collect()}
    want = {n: (a, b) for n, a, b, _ in rows} | {1: ("new", 7)}
    assert read() == want
    assert backfill.fill(spark, target, SCHEMA, "part", late, "id", ["a", "b"]) == 0 and files() == after
    assert backfill.fill(spark, target, SCHEMA, "part", late.withColumn("part", F.lit(2).cast("long")), "id", ["a"], over=True) == 0
    assert backfill.fill(spark, target, SCHEMA, "part", late, "id", ["a"], over=True) == 1 and read() == want | {4: ("new", None)}


def test_missing_values_are_made_in_batches_until_none_is_left(spark, tmp_path):
    target = str(tmp_path / "t")
    spark.createDataFrame([(n, "kept" if n % 4 == 0 else None, n, n % 3) for n in range(60)], SCHEMA).coalesce(1).write.partitionBy("part").parquet(target)
    for _ in range(2):
        done = backfill.fill_missing(spark, target, SCHEMA, "part", "id", {"a": F.concat(F.lit("made "), F.col("b").cast("string"))}, str(tmp_path / "w"), rows_a_batch=7)
        done.awaitTermination(120)
    listed = len(list((tmp_path / "w" / "listed").glob("*.parquet")))
    assert listed >= 7 and len(list((tmp_path / "w" / "checkpoint" / "commits").glob("[0-9]*"))) == listed
    got = {r["id"]: r["a"] for r in spark.read.schema(SCHEMA).parquet(target).collect()}
    assert got == {n: "kept" if n % 4 == 0 else f"made {n}" for n in range(60)}


def test_batches_grow_with_a_long_list_and_not_their_number(spark, tmp_path):
    target = str(tmp_path / "t")
    spark.createDataFrame([(n, None, n, n % 3) for n in range(60)], SCHEMA).coalesce(1).write.partitionBy("part").parquet(target)
    made = {"a": F.concat(F.lit("made "), F.col("b").cast("string"))}
    backfill.fill_missing(spark, target, SCHEMA, "part", "id", made, str(tmp_path / "w"), rows_a_batch=1).awaitTermination(300)
    assert len(list((tmp_path / "w" / "listed").glob("*.parquet"))) == 60
    assert len(list((tmp_path / "w" / "checkpoint" / "commits").glob("[0-9]*"))) == 20
    assert {r["id"]: r["a"] for r in spark.read.schema(SCHEMA).parquet(target).collect()} == {n: f"made {n}" for n in range(60)}
