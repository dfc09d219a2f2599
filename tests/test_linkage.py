import itertools
import random

import pytest
from pyspark.sql import functions as F

from discoforge.operators import keys, rollups, search, writes
from discoforge.plans import audio, presence, replicate

TRACK = "group string, isrc string, title string, artist string, sequence_no long, filename string, record_id string, ord long"


def source(spark, rows):
    return spark.createDataFrame([("g", *r, f"id{n}", n) for n, r in enumerate(rows)], TRACK)


def test_matrix_joins_by_code_file_and_title(spark):
    a = source(spark, [("za1", "One", "A", 1, "f1.wav"), (None, "Two songs", None, 2, None), (None, "Three", None, 3, None)])
    b = source(spark, [("ZA1 ", None, "B", None, None), (None, None, "B2", None, "F1.mp3"), (None, "Two song", None, 2, None), (None, "Other", None, 3, None)])
    sheet = source(spark, [("ZA9", "Two songs", "S", 2, None), ("ZA7", "New", "S", 1000, None)])
    got = presence.matrix({"a": a, "b": b, "sheet": sheet}, sheet="sheet").orderBy("position").collect()
    assert [(r["title"], r["in_a"], r["in_b"], r["in_sheet"]) for r in got] == [("One", True, True, False), ("Two songs", True, True, True), ("Three", True, False, False), ("Other", False, True, False), ("New", False, False, True)]
    assert got[0]["b_id"] == "id1" and got[0]["artist"] == "A" and got[1]["isrc"] == "ZA9"


def test_matrix_is_greedy_where_keys_conflict(spark):
    a = source(spark, [("X1", "One", None, 1, "a.wav"), ("X2", "Two", None, 2, "b.wav")])
    b = source(spark, [("X1", None, None, None, "b.wav"), (None, None, None, None, "b.wav")])
    got = presence.matrix({"a": a, "b": b}).orderBy("position").collect()
    assert [(r["title"], r["in_b"], r["b_id"]) for r in got] == [("One", True, "id1"), ("Two", False, None)]


def test_exact_similarity_of_seven_tenths_counts(spark):
    a, b = source(spark, [(None, "abcdefghij", None, 1, None)]), source(spark, [(None, "abcdefgxyz", None, 1, None)])
    assert presence.matrix({"a": a, "b": b}).count() == 1
    assert presence.matrix_by_keys({"a": a, "b": b}).count() == 1


def test_both_matrices_agree_without_conflicts(spark):
    dice = random.Random(3)
    rows = [[(f"Z{i}", f"title {i}", None, i, f"f{i}.wav") for i in range(12) if dice.random() < 0.7] for _ in range(3)]
    sides = {name: source(spark, r) for name, r in zip("abc", rows)}
    pick = ["isrc", "title", "in_a", "in_b", "in_c", "a_id", "b_id", "c_id"]
    assert sorted(map(tuple, presence.matrix(sides).select(pick).collect())) == sorted(map(tuple, presence.matrix_by_keys(sides).select(pick).collect()))


def test_first_and_last_wins_are_idempotent(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), (None, 9)], "k string, v int")
    once = keys.first_wins(df, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 5)] == sorted(map(tuple, keys.first_wins(once, ["k"], ["v"]).collect()))
    assert sorted(map(tuple, keys.last_wins(df, ["k"], ["v"]).collect())) == [("a", 2), ("b", 5)]
    assert keys.distinct_first(df.union(df), ["k"], ["v"]).count() == 3


def test_replication(spark):
    source_rows = [("c1", "I1", 1, "t"), ("c1", None, 2, "t"), ("c1", "I9", 7, "t"), ("c1", "I5", 8, "t"), ("c1", "I1", 1, None)]
    src = spark.createDataFrame(source_rows, "catalogue_no string, isrc string, sequence_no long, title string")
    target = spark.createDataFrame([("r1", "c1", "I1", 5, 0), ("r2", "c1", None, 2, 1), ("r3", "c2", "I9", 1, 2)], "record_id string, catalogue_no string, isrc string, sequence_no long, ord long")
    got = {(r["isrc"], r["sequence_no"], r["title"]): (r["action"], r["record_id"]) for r in replicate.replicate(src, target, ["Track Name"]).collect()}
    assert got == {("I1", 1, "t"): ("updated", "r1"), (None, 2, "t"): ("updated", "r2"), ("I9", 7, "t"): ("exists-other-catalogue", None), ("I5", 8, "t"): ("created", None), ("I1", 1, None): ("skipped", "r1")}


def test_hydration(spark):
    schema = "catalogue_no string, isrc string, filename string, sequence_no long, s3_url string, artwork_url string"
    tracks = spark.createDataFrame([("c", " i1", None, None, None, None), ("c", None, "F.wav", None, "own", " "), ("c", None, "f.wav", 3, None, None), ("c", None, None, 99, None, None)], schema)
    held = spark.createDataFrame([("c", "I1", None, 1, "u1", None, 0), ("c", None, "F.mp3", 2, "u2", "cover", 1), ("c", None, None, 3, "u3", None, 2)], schema + ", ord long")
    got = [(r["s3_url"], r["artwork_url"], r["match_via"]) for r in replicate.hydrated(tracks, held, ["s3_url", "artwork_url"]).collect()]
    assert sorted(got, key=str) == sorted([("u1", "cover", "isrc"), ("own", "cover", "filename"), ("u3", "cover", "sequence_no"), (None, None, None)], key=str)


def test_files_serve_once(spark):
    tracks = spark.createDataFrame([("g", 1, "Song"), ("g", 2, "Song (Radio Edit)"), ("g", 3, "Song"), ("g", 4, "")], "group string, ord long, title string")
    files = spark.createDataFrame([("g", 10, "02 Song.wav"), ("g", 11, "Song.wav"), ("g", 12, "!!.wav")], "group string, ord long, name string")
    assert sorted(map(tuple, audio.match_files(tracks, files).collect())) == [("g", 1, 11), ("g", 2, 10)] or sorted(map(tuple, audio.match_files(tracks, files).collect())) == [("g", 1, 11), ("g", 3, 10)]
    assert [tuple(r) for r in audio.match_files_by_rank(tracks, files).collect()] == [("g", 1, 11)]


def test_relocation_and_listing(spark):
    rows = spark.createDataFrame([(1, "moviemac:/Mount/b/x/Song.wav", "Song"), (2, "https://h/y.wav", "y"), (3, "moviemac:/Mount/b/x/Gone.wav", "Gone")], "id int, file string, title string")
    found = audio.resolve(rows, [("file", ["file"])], [], "Mount/", ["b"])
    files = spark.createDataFrame([("/b/x/Song.wav", "Song.wav"), ("/b/x/Band_Gone.wav", "Band_Gone.wav")], "path string, name string")
    assert [r["exists"] for r in audio.verified(found, files).orderBy("id").collect()] == [True, None, False]
    assert [r["found_path"] for r in audio.relocated(found, files, "title").orderBy("id").collect()] == ["/b/x/Song.wav", None, "/b/x/Band_Gone.wav"]


def test_guards(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, None, 2)], "ord long, t string, n int")
    assert [tuple(r) for r in writes.update_row(df, 1, {"t": "x", "n": "", "odd": 1}, {"t": ""}).orderBy("ord").collect()] == [(0, "a", 1), (1, "x", None)]
    assert writes.delete_row(df, 0, {"n": 1}).count() == 1
    for bad in (lambda: writes.update_row(df, 1, {"t": "x"}, {"t": "b"}), lambda: writes.delete_row(df, 7)):
        with pytest.raises(writes.Changed):
            bad()
    with pytest.raises(ValueError, match="stays"):
        writes.replaced(df, df.limit(0))


def test_versions_stay(spark, tmp_path):
    df = spark.range(3).toDF("ord")
    writes.save(df, str(tmp_path), 1)
    writes.save(writes.append(df, df), str(tmp_path), 2)
    assert spark.read.parquet(f"{tmp_path}/v000001").count() == 3 and sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/v000002").collect()) == [0, 1, 2, 3, 4, 5]


def test_paths_are_repaired(spark):
    rows = [("movie:a.wav\nmoviemac:/B1/x/a.wav",), ("moviemac:/B1/x/a.wav\nmoviemac:/B2/x/a.wav",), ("moviemac:/Q/a.wav",), (None,)]
    got = [tuple(r) for r in writes.repaired_paths(spark.createDataFrame(rows, "p string"), "p", ["/B1", "/B2"]).collect()]
    assert got[0] == ("movie:a.wav\nmoviemac:/B1/x/a.wav\nmoviemac:/B2/x/a.wav", "updated") and [g[1] for g in got[1:]] == ["skipped", "error", "skipped"]


def test_finds(spark):
    df = spark.createDataFrame([("Abc", "x"), ("abd", None), (None, "y")], "a string, b string")
    assert search.find(df, [{"a": "AB*", "b": "*"}]).count() == 1
    assert search.find(df, [{"a": "==abd"}, {"b": "*Y*"}]).count() == 2
    assert search.find(df, [{"nope": "x"}]).count() == 0
    assert search.holds_any(df, "a", ["a"]).count() == 0 and search.holds_any(df, "ab", ["a", "zz"]).count() == 2
    cache = spark.createDataFrame([("AB 12", 2, 0), ("ab-12", 1, 1), ("AB 12", None, 2)], "catalogue string, seq int, ord long")
    assert [r["ord"] for r in search.lookup_tracks(cache, "ab 12").collect()] == [0, 2]
    assert [r["ord"] for r in search.lookup_tracks(cache, "AB_12").collect()] == [0, 2]


def test_federated_never_mixes_codes_and_names(spark):
    schema = "isrc string, title string, artist string, album string, catalogue_no string, sequence_no int, ord int"
    a = spark.createDataFrame([("i1", "T", None, "", None, 1, 0), (None, "T ", "x", None, None, 2, 1)], schema)
    b = spark.createDataFrame([("I1 ", "U", "Y", "Al", "c", 3, 0), (None, "t", " X", None, None, 4, 1)], schema)
    got = [(r["isrc"], r["title"], r["artist"], r["album"], r["sequence_no"], r["sources"]) for r in search.federated({"a": a, "b": b}).orderBy("position").collect()]
    assert got == [("I1", "T", "Y", "Al", 1, ["a", "b"]), (None, "T ", "x", None, 2, ["a", "b"])] or got == [(None, "T ", "x", None, 2, ["a", "b"]), ("I1", "T", "Y", "Al", 1, ["a", "b"])]


def test_rollups(spark):
    rows = spark.createDataFrame([("My Show", "h1", None, None, None, 2, 0), ("my show ", "h2", None, None, None, 5, 1), (" ", "h", None, None, None, 9, 2)], "show_title string, host string, artwork string, category string, language string, episode_number int, ord int")
    r = rollups.show_rollup(rows, ["ord"]).collect()
    assert len(r) == 1 and (r[0]["show_title"], r[0]["host"], r[0]["episode_count"], r[0]["max_episode_number"]) == ("My Show", "h1", 2, 5)
    results = spark.createDataFrame([(True, "updated"), (False, None)], "ok boolean, action string")
    assert tuple(rollups.tallies(results).first())[:4] == (2, 1, 1, 1)
    base = spark.createDataFrame([("Jazz",), ("Pop",)], "g string")
    assert [r["g"] for r in rollups.merged_values(base, base.select(F.upper("g").alias("g")).union(spark.createDataFrame([("Blues",)], "g string")), "g").collect()] == ["Blues", "Jazz", "Pop"]


def test_systematic_sample_in_parts_is_the_same(spark):
    df = spark.range(1000)
    whole = sorted(r[0] for r in rollups.systematic_sample(df, ["id"], 7).collect())
    assert whole == list(itertools.islice(range(0, 1000, 142), 8))


def test_repeated_rows_stay(spark):
    rows = spark.createDataFrame([("a", "g1"), ("a", "g1"), ("b", "g2"), (None, "g1"), ("a", None)], "isrc string, grp string")
    held = spark.createDataFrame([("a", "g1"), ("a", "g3"), ("a", "g2"), ("b", "g2")], "isrc string, grp string")
    got = sorted(((r["isrc"], r["grp"], r["other_group"]) for r in keys.elsewhere(rows, held, "isrc", "grp").collect()), key=str)
    assert got == sorted([("a", "g1", "g2"), ("a", "g1", "g2"), ("b", "g2", None), (None, "g1", None), ("a", None, None)], key=str)
    titles = spark.createDataFrame([("k", "The Long Road"), ("k", "The Long Road")], "b string, title string")
    assert keys.fuzzy_matches(titles, spark.createDataFrame([("k", "The Long Roads")], "b string, title string"), ["b"], "title", "title", ["title"]).count() == 2


def test_prefixes_of_several_lengths(spark):
    left = spark.createDataFrame([("60",), ("601",), ("",), (None,), ("x" * 70,)], "p string")
    right = spark.createDataFrame([("601_1.wav",), ("60.wav",), (None,), ("x" * 71,)], "name string")
    assert sorted((r["p"][:3], r["name"][:3]) for r in keys.prefix_join(left, right, "p", "name").collect()) == [("60", "60."), ("60", "601"), ("601", "601"), ("xxx", "xxx")]
    assert keys.prefix_join(left.limit(0), right, "p", "name").count() == 0


def test_positions_count_all_rows(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a int, b int").repartition(5)
    got = [(r["a"], r["b"]) for r in sorted(rollups.positions(df, ["a", "b"]).collect(), key=lambda r: r["position"])]
    assert got == sorted((i % 7, i) for i in range(500))
    assert rollups.positions(df.limit(0), ["a"]).count() == 0
