"""Order-dependent operators against row-by-row versions: places, batches of upserts, presence, file matching."""

import random

import pytest
from pyspark.sql import functions as F

from discoforge.operators import cuts, keys, rollups, similar, writes
from discoforge.plans import audio, presence


@pytest.mark.parametrize(("parts", "reuse"), [(4, "true"), (8, "false"), (200, "true")])
def test_places_at_any_number_of_ranges(spark, parts, reuse):
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_011).alias("a"), (F.col("id") % 5).alias("b"), F.rand(3).alias("c")).repartition(7)  # more rows than a sampler reads
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        once = rollups.positions(df, [F.desc("b"), "a"], "p")
        both = rollups.positions(once, ["a"], "q").select("a", "b", "p", "q").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.exchange.reuse", "true")
    by_b = sorted(both, key=lambda r: (-r["b"], r["a"]))
    assert [r["p"] for r in by_b] == list(range(1, 30_001)) and [r["q"] for r in sorted(both, key=lambda r: r["a"])] == list(range(1, 30_001))


def test_linked_rows(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, f"a{rng.randrange(60)}"]), rng.choice([None, f"b{rng.randrange(60)}"])) for i in range(120)]
    rows += [(1000 + i, f"c{i}", f"c{i + 1}x" if i % 2 else f"c{i - 1}x") for i in range(9)] + [(2000 + i, f"d{i // 2}", f"e{(i + 1) // 2}") for i in range(60)]  # a long chain
    got = cuts.linked(spark.createDataFrame(rows, "i int, x string, y string"), ["x", "y"], "u").collect()
    unit = {r["i"]: r["u"] for r in got}
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for m, r in enumerate(rows):
        for n, s in enumerate(rows[:m]):
            if (r[1] and r[1] == s[1]) or (r[2] and r[2] == s[2]):
                up[root(m)] = root(n)
    same = {}
    for n, r in enumerate(rows):
        if r[1] is None and r[2] is None:
            assert unit[r[0]] is None
        else:
            assert same.setdefault(root(n), unit[r[0]]) == unit[r[0]]
    assert len(set(same.values())) == len(same) and len(got) == len(rows)


def upserted(base, incoming):
    """One row after another: the first record holding the code, else the file name; the row's keys are the record's then."""
    records = [[rid, None, isrc, name] for rid, isrc, name in base]
    out = []
    for n, (isrc, name) in enumerate(incoming, 1):
        keys = [k or None for k in (isrc, name)]
        hit = next((r for p in (0, 1) if keys[p] for r in records if r[2 + p] == keys[p]), None)
        if keys == [None, None]:
            out.append((n, None, None, "failed"))
        elif hit is None:
            records.append([None, n, *keys])
            out.append((n, None, n, "created"))
        else:
            hit[2:] = [k or old for k, old in zip(keys, hit[2:])]
            out.append((n, hit[0], hit[1], "updated"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_row_by_row(spark, seed):
    rng = random.Random(seed)
    some = lambda x, n: rng.choice([None, "", *[f"{x}{rng.randrange(n)}" for _ in range(5)]])
    base = [(f"r{i}", some("I", 40), some("F", 40)) for i in range(30)]
    incoming = [(some("I", 60), some("F", 60)) for _ in range(200)] + [("I1", f"F{i % 3}") for i in range(50)]
    stored = spark.createDataFrame([(*b, i) for i, b in enumerate(base)], "record_id string, isrc string, filename string, ord long")
    rows = spark.createDataFrame([(n, *x) for n, x in enumerate(incoming, 1)], "at long, isrc string, filename string").repartition(5)
    got = writes.upsert_in_order(stored, rows, ["isrc", "filename"], ["ord"], ["at"])
    want = upserted([(r, a or None, b or None) for r, a, b in base], incoming)
    assert sorted(tuple(r) for r in got.select("at", "record_id", "created_by", "action").collect()) == want
    assert sum(w[3] == "updated" and w[2] is not None for w in want) > 20
    assert writes.upsert_in_order(stored.limit(0), rows.limit(0), ["isrc", "filename"], ["ord"], ["at"]).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def test_distances_and_alike_keys(monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
    words = [word() for _ in range(400)]
    for a, b in zip(words, words[1:]):
        assert similar.distance(a, b) == edits(a, b)
    for scan in (0, 10**6):
        monkeypatch.setattr(similar.Alike, "SCAN", scan)
        index = similar.Alike(0.7)
        for n, w in enumerate(words[:200]):
            index.add(w, n)
        for w in words[200:]:
            scored = [(1 - edits(w, x) / max(len(w), len(x), 1), -n) for n, x in enumerate(words[:200])]
            best = max(scored)
            assert index.best(w) == (-best[1] if best[0] >= 0.7 else None)


def presence_of(tracks, sheet):
    """Rows of one group, one track after another. tracks: (rank, ord, code, file, seq, title, key)."""
    rows, by_code, by_file = [], {}, {}
    for rank, _, code, file, seq, title, key in sorted(tracks, key=lambda t: t[:2]):
        file = None if rank == sheet else file
        row = by_code.get(code) if code else None
        row = by_file.get(file) if row is None and file else row
        if row is None and seq is not None and (title or rank == sheet):
            near = [(1 - edits(r["key"], key) / max(len(r["key"]), len(key), 1), -n) for n, r in enumerate(rows) if r["seq"] == seq]
            best = max(near, default=(0, 0))
            row = rows[-best[1]] if best[0] >= 0.7 else None
        if row is None:
            row = {"code": None, "title": None, "key": "", "seq": None, "file": None, "ids": {}}
            rows.append(row)
        if code:
            by_code[code] = row
        if file:
            by_file[file] = row
        if title and not row["title"]:
            row["key"] = key
        row["code"], row["title"], row["file"] = row["code"] or code, row["title"] or title or None, row["file"] or file
        row["seq"] = seq if row["seq"] is None else row["seq"]
        row["ids"][rank] = _
    return [(r["code"], r["title"], r["seq"], r["file"], r["ids"].get(0), r["ids"].get(1), r["ids"].get(2)) for r in sorted(rows, key=lambda r: 999 if r["seq"] is None else r["seq"])]


@pytest.mark.parametrize("scan", [0, 200])
def test_matrix_equals_track_by_track(spark, monkeypatch, scan):
    monkeypatch.setattr(similar.Alike, "SCAN", scan)
    rng = random.Random(11)
    tracks = []
    for group in ("g1", "g2", None):
        for rank in range(3):
            for n in range(60):
                title = rng.choice([None, "", "ab", *["".join(rng.choice("ab") for _ in range(rng.randrange(3, 9))) for _ in range(6)]])
                tracks.append((group, rank, 1000 * rank + n, rng.choice([None, *[f"C{rng.randrange(50)}" for _ in range(2)]]), rng.choice([None, None, f"f{rng.randrange(50)}.wav"]), rng.choice([None, *range(6)]), title))
    schema = "group string, isrc string, title string, artist string, sequence_no long, filename string, record_id string, ord long"
    sides = {name: spark.createDataFrame([(g, c, t, None, s, f, str(o), o) for g, k, o, c, f, s, t in tracks if k == rank], schema).repartition(3) for rank, name in enumerate("abs")}
    got = presence.matrix(sides, sheet="s").orderBy("group", "position").collect()
    for group in ("g1", "g2", None):
        own = [(k, o, c, f and f[:-4], s, t, t or "") for g, k, o, c, f, s, t in tracks if g == group]
        want = [(c, t, s, f and f + ".wav", *[i if i is None else str(i) for i in ids]) for c, t, s, f, *ids in presence_of(own, 2)]
        mine = [(r["isrc"], r["title"], r["sequence_no"], r["filename"], r["a_id"], r["b_id"], r["s_id"]) for r in got if r["group"] == group]
        assert mine == want


def test_files_equal_track_by_track(spark):
    rng = random.Random(6)
    names = ["song", "song radio", "a", "radio", "my song", "so", "b side", "a b", ""]
    tracks = [(g, n, rng.choice(names)) for g in ("x", "y", None) for n in range(40)]
    files = [(g, 100 + n, rng.choice(names) + rng.choice(["", " 2", " take"])) for g in ("x", "y", None) for n in range(35)]
    want = []
    for group in ("x", "y", None):
        left = [f for f in files if f[0] == group and f[2].strip()]
        for _, n, title in [t for t in tracks if t[0] == group and t[2]]:
            fit = [f for f in left if f[2].strip() == title] or [f for f in left if title in f[2].strip() or f[2].strip() in title]
            if fit:
                left.remove(fit[0])
                want.append((group, n, fit[0][1]))
    got = audio.match_files(spark.createDataFrame(tracks, "group string, ord long, title string").repartition(3), spark.createDataFrame(files, "group string, ord long, name string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 60


def test_large_groups(spark):
    """One group of more rows than a task of rows could hold one after another in lists."""
    n = 30_000
    tracks = spark.range(n).select(F.lit("g").alias("group"), F.col("id").alias("ord"), F.concat(F.lit("song "), F.lpad(F.col("id").cast("string"), 7, "0")).alias("title"))
    files = spark.range(n).select(F.lit("g").alias("group"), (n - F.col("id")).alias("ord"), F.concat(F.lit("song "), F.lpad(F.col("id").cast("string"), 7, "0"), F.lit(" edit.wav")).alias("name"))
    got = audio.match_files(tracks, files)
    assert got.count() == n and got.where(f"track_ord + file_ord <> {n}").isEmpty()
    pairs = similar.contained(tracks.select(F.lit("g").alias("block"), F.col("title").alias("text")), files.select(F.lit("g").alias("block"), F.lower("name").alias("text")))
    assert pairs.count() == n


@pytest.mark.parametrize("rows", [0, 10**6])
def test_fuzzy_matches_with_and_without_the_index(spark, monkeypatch, rows):
    monkeypatch.setattr(keys, "INDEXED_ROWS", rows)
    rng = random.Random(9)
    title = lambda: "".join(rng.choice("ab c") for _ in range(rng.randrange(13)))
    left, right = [[(rng.choice(["x", "y", None]), title(), n) for n in range(120)] for _ in range(2)]
    schema = "b string, title string, n int"
    got = keys.fuzzy_matches(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["b"], "title", "title", ["n"])
    want = []
    for b, t, n in left:
        key = t.replace(" ", "")
        scored = [(1 - edits(key, u.replace(" ", "")) / max(len(key), len(u.replace(" ", "")), 1), -m) for c, u, m in right if b is not None and c == b]
        best = max(scored, default=(0, 0))
        if best[0] >= 0.7:
            want.append((n, -best[1], round(best[0], 9)))
    assert sorted((r["n"], r["r_n"], round(r["score"], 9)) for r in got.collect()) == want and len(want) > 40


def test_stored_lookups_move_only_what_asks(spark, tmp_path):
    from discoforge.sources import lookups

    held = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    lookups.save_lookup(held, "lookup_of_test", "key", F.concat(F.lit("K"), F.col("k").cast("string")), ["id"], 4, path=str(tmp_path / "t"))
    out = lookups.look_up(spark.createDataFrame([("K7",), ("K7",), ("none",), (None,)], "key string"), spark, "lookup_of_test", "key")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert sorted(((r["key"], r["found_id"]) for r in out.collect()), key=str) == sorted([("K7", 907), ("K7", 907), ("none", None), (None, None)], key=str)


def test_text_index_finds_what_a_scan_finds(spark, tmp_path):
    from discoforge.sources import lookups

    rng = random.Random(3)
    rows = [(n, "".join(rng.choice("abé /") for _ in range(rng.randrange(12))), rng.choice([None, "", "Ab", "c/d"])) for n in range(400)]
    df = spark.createDataFrame(rows, "id int, x string, y string")
    lookups.text_index(df, "id", ["x", "y"]).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    for terms in (["AB"], ["ab", "é"], ["a"], ["aba", "c/d"], ["zz"], ["b c"], []):
        got = {r["id"] for r in lookups.search_index(df, index, "id", ["x", "y"], terms).collect()}
        assert got == {n for n, x, y in rows if all(t.lower() in f"{x}\0{y or ''}".lower() for t in terms)}
    found = lookups.search_index(df, index, "id", ["x", "y"], ["aba"])
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().executedPlan().toString() or "EqualTo(gram" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("numbers", [True, False])
def test_rows_of_one_key_need_no_pass(spark, monkeypatch, numbers):
    rng, passed, runs = random.Random(4), [], writes.in_order
    monkeypatch.setattr(writes, "in_order", lambda both, *more: (passed.append(both), runs(both, *more))[1])
    base = [(f"r{i}", rng.choice([None, f"I{i % 40}"]), rng.choice([None, f"F{i % 30}"])) for i in range(60)]
    lone = [rng.choice([(f"I{n}", None), (" ", f"F{n}"), (None, None), ("", f"G{n}")]) for n in (rng.randrange(50) for _ in range(200))]
    mixed = lone + [(rng.choice([None, f"I{n}"]), f"F{n}") for n in (rng.randrange(8) for _ in range(40))]
    rng.shuffle(mixed)
    stored = spark.createDataFrame([(*b, i) for i, b in enumerate(base)], "record_id string, isrc string, filename string, ord long")
    for incoming in (lone, mixed):
        rows = spark.createDataFrame([(10 * n, *x) for n, x in enumerate(incoming, 1)], "at long, isrc string, filename string").repartition(5)
        got = writes.upsert_in_order(stored, rows, ["isrc", "filename"], ["ord"], ["at"], numbers)
        wide = [(10 * n, rid, by if numbers or by is None else 10 * by, action) for n, rid, by, action in upserted(base, [(a and a.strip(), b) for a, b in incoming])]
        assert sorted((r["at"], r["record_id"], r["created_by"], r["action"]) for r in got.collect()) == wide
        assert len(passed) == (incoming is mixed)
    assert 40 < passed[0].where("not _held").count() < 200


@pytest.mark.parametrize("count", [1, 3])
def test_only_combinations_of_several_keys_go_in_rounds(spark, monkeypatch, count):
    rounds, keep = [], cuts.written
    monkeypatch.setattr(cuts, "written", lambda df: (rounds.append(df), keep(df))[1])
    rng = random.Random(2)
    rows = [tuple(rng.choice([None, None, rng.randrange(12)]) for _ in range(count)) for _ in range(60)]
    got = cuts.components(spark.createDataFrame(rows, ", ".join(f"k{n} int" for n in range(count))), [f"k{n}" for n in range(count)], "u").collect()
    number = {tuple(r)[:count]: r["u"] for r in got}
    nodes = sorted({r for r in rows if any(k is not None for k in r)}, key=str)
    least = {r: n for n, r in enumerate(nodes)}
    for _ in nodes:
        for r in nodes:
            least[r] = min(least[s] for s in nodes if s == r or any(a is not None and a == b for a, b in zip(r, s)))
    assert len(got) == len(nodes) == len(number) and len({(least[r], number[r]) for r in nodes}) == len(set(least.values())) == len(set(number.values()))
    assert all(df.where(" + ".join(f"int(k{n} is not null)" for n in range(count)) + " < 2").isEmpty() for df in rounds[1:])
    assert len(rounds) > 1 if count > 1 else len(rounds) == 1


def test_columns_go_along_with_each_result(spark):
    rows = spark.range(2500).selectExpr("id % 7 as u", "id", "array(id, 1) as held", "map('a', id) as m").repartition(5)
    twice = lambda: lambda n: [(n, "x")] * (n % 3)
    got = cuts.in_order(rows, "u", ["id"], twice, ["id"], "n long, s string", ["held", "m"]).collect()
    assert sorted((r["n"], tuple(r["held"]), r["m"]["a"], r["s"]) for r in got) == [(n, (n, 1), n, "x") for n in range(2500) for _ in range(n % 3)]
