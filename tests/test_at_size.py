"""Plans that must not depend on a table being small: no broadcast of rows that grow, no rows of null keys in one task."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import discoforge.plans.queries  # noqa: F401  registers all
from discoforge.operators import keys, similar
from discoforge.plans import audio, messages, replicate
from discoforge.plans.registry import ORACLE_SQL, QUERIES
from discoforge.sources import tables
from tests.comparing import SF, duck, rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contained_texts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["", *["".join(rng.choice("ab 𝄞é") for _ in range(rng.choice([1, 2, 3, 4, 7, 8, 9, 15, 17, 33]))) for _ in range(150)]]
    parts = [(b, x) for b in ("p", "q", None) for x in texts[:80]]
    wholes = [(b, x) for b in ("p", "q", None) for x in texts[40:]] * 2
    got = similar.contained(spark.createDataFrame(parts, "block string, text string"), spark.createDataFrame(wholes, "block string, text string")).collect()
    want = {(b, x, y) for b, x in parts for c, y in wholes if b and b == c and x and x in y}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_contained_broadcasts_no_runs(spark):
    texts = spark.range(50).selectExpr("'b' as block", "concat('song ', id) as text")
    assert "BroadcastHashJoin" not in plan(similar.contained(texts, texts))
    assert not similar.contained(texts.limit(0), texts).collect()


def test_listings_are_not_broadcast(spark):
    files = spark.range(50).selectExpr("concat('/masters/K', id % 3, '/Song ', id, '.wav') as path", "concat('Song ', id, '.wav') as name")
    rows = files.selectExpr("path as file", "name as title")
    found = audio.relocated(audio.verified(audio.resolve(rows, [("file", ["file"])], [], "Mount/", ["masters"]), files), files, "title")
    assert "BroadcastHashJoin" not in plan(found)
    assert all(r["exists"] and r["found_path"] == r["file"] for r in found.collect())


def test_a_place_of_many_tracks_and_many_wanted_rows_is_no_product(spark, monkeypatch):
    chosen_from = []
    monkeypatch.setattr(replicate, "first_wins", lambda df, *more: (chosen_from.append(df), keys.first_wins(df, *more))[1])
    tracks = spark.range(300).selectExpr("'K' as catalogue_no", "1 as sequence_no", "concat('I', id % 3) as isrc", "id as ord")
    wanted = spark.range(200).selectExpr("id", "case when id % 2 = 0 then 'K' end as catalogue_no", "1 as sequence_no", "concat('I', id % 4) as isrc")
    found = {r["id"]: r["ord"] for r in replicate.canonical_track(tracks, wanted).collect()}
    assert found == {n: 0 if n % 2 == 0 else 1 for n in range(200) if n % 4 != 3}
    assert chosen_from[-1].count() <= 2 * 200


def test_tagged_rows_are_all_there(spark):
    df = spark.range(3000).selectExpr("id", "' A ' as tag")
    assert tables.tagged(df, "tag", "A").count() == 3000
    assert tables.tagged(df, "tag", "A", 10).count() == 10


def test_or_key_pairs_are_not_shuffled(spark):
    left = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 7), (None, 1)], "a int, b int")
    right = spark.createDataFrame([(1, 1), (2, 1), (3, 7), (None, None), (3, 7)], "c int, d int")
    met = keys.or_key_join(left, right, [("a", "c"), ("b", "d")])
    want = {(x, y) for x in left.collect() for y in right.collect() if (x[0] == y[0] is not None) or (x[1] == y[1] is not None)}
    assert sorted(map(str, met.collect())) == sorted(str(Row(**x.asDict(), **y.asDict())) for x, y in want)
    assert plan(met).index("SortMergeJoin") < plan(met).index("HashAggregate")  # nothing is made distinct after a join


def test_rows_without_a_key_meet_in_no_one_task(spark):
    left = spark.range(2000).selectExpr("id", "case when id < 20 then id % 15 end as code", "map('a', id) as held")
    right = spark.range(10).selectExpr("id as code", "id as ord", "id * 10 as value")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = keys.prioritised_join(left, right, [("code", F.col("code"), F.col("code"))], ["ord"]).withColumn("at", F.spark_partition_id())
        rows = out.select("id", "match.value", "match_via", "at").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r["id"], r["value"], r["match_via"]) for r in rows) == [(n, n % 15 * 10 if n < 20 and n % 15 < 10 else None, "code" if n < 20 and n % 15 < 10 else None) for n in range(2000)]
    assert max(Counter(r["at"] for r in rows).values()) < 1000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")
def test_recordings_and_releases_are_not_broadcast(spark, monkeypatch):
    plans, positions = [], messages.cuts.positions
    monkeypatch.setattr(messages.cuts, "positions", lambda df, *more: (plans.append(plan(df)), positions(df, *more))[1])
    got = QUERIES["message_files"](spark, SF).toPandas()
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
    assert rows(got) == rows(duck(ORACLE_SQL["message_files"]))
