"""Rollups of artists with any number of records."""

from pyspark.sql import types as T

from discoforge.operators import rollups


def test_artist_rollup_holds_no_list_of_a_group(spark):
    rows = [("b", "x", "t", None, 3, 1), ("a", "x", "s", "u1", 9, 2), ("a", "y", "r", "u0", 7, 1), ("a", None, "q", None, 8, 3)]
    songs = spark.createDataFrame(rows, "artist string, album string, title string, url string, record_id long, nth int")
    out = rollups.artist_rollup(songs, ["nth"])
    assert not [f.name for f in out.schema if isinstance(f.dataType, T.ArrayType)]
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["artist"], r["songs"], r["albums"], r["sample"], r["first_id"], r["last_id"]) for r in out.collect()] == [("a", 3, 2, ("r", "u0"), 7, 9), ("b", 1, 1, None, 3, 3)]
    assert [tuple(r) for r in rollups.artist_record_ids(songs, ["nth"]).collect()] == [("a", 7), ("a", 9), ("a", 8), ("b", 3)]
