"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every corpus operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from discoforge.llm import decontaminate, embeddings, langid, licenses, lmscore, minhash, mix, pages, quality, secrets

TALE = "The old miller walked along the river bank and counted seven grey herons before noon."
OTHER = "Ein kleiner Hund lief durch den Garten und suchte seinen Ball unter dem alten Baum."
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(12_000))
ROWS = [
    (1, TALE, "en", "a"),
    (1, TALE, "en", "a"),
    (2, TALE, "en", None),
    (3, None, None, "a"),
    (4, "", "en", "a"),
    (5, " \n\t ", "de", "b"),
    (6, LONG, "en", "b"),
    (None, TALE, None, None),
    (7, "...!", None, "c"),
    (8, OTHER + " " + OTHER, "de", "c"),
    (9, "\U0001f600 password = hunter2hunter2 and more. Licensed under the MIT License.", "en", "c"),
]
CLASHING = ["h", "n", "key", "size", "low", "component", "spans", "block", "w", "_k", "nth", "base", "quota", "shard", "seats", "t", "a", "b", "f", "rep", "kept", "item_id", "grade", "q", "span_doc", "SPANS_", "text_hash"]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return out.select("*", *[F.lit(None if i % 2 else "x").alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, TALE, "x"), (1, TALE, "y"), (2, None, "x"), (3, "", "x"), (4, "Ball", "x"), (None, OTHER, "x"), (5, LONG, "x")], "item_id long, text string, h string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, None, None), (8, 0, 1), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


def by_id(frame, key="doc_id"):
    rows = frame.collect()
    return {r[key]: r for r in rows}, len(rows)


def test_near_duplicates(docs):
    found, n = by_id(minhash.near_duplicates(docs))
    assert n == len(ROWS)
    assert [found[k]["component_id"] for k in (1, 2, 8)] == [1, 1, 8]
    assert [found[k]["n_shingles"] for k in (3, 4, 5, 7)] == [0, 0, 0, 1]
    assert all(found[k]["kept"] for k in (1, 3, 4, 5, 6, None)) and not found[2]["kept"]
    assert found[None]["component_id"] is None
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.one_of_each_group(docs)
    assert kept.columns == docs.columns  # of the four rows with TALE one stays, whatever their ids
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8, 9]
    nameless = minhash.one_of_each_group(docs.where("doc_id is null or doc_id > 5"))
    assert sorted(r["doc_id"] or 0 for r in nameless.collect()) == [0, 6, 7, 8, 9]
    assert minhash.one_of_each_group(docs.limit(0)).count() == 0


def test_licenses(docs):
    found, n = by_id(licenses.scan(docs))
    assert n == len(ROWS)
    assert found[9]["licenses"] == ["MIT"] and found[9]["sentences"] == ["mit-ref-2"]
    assert found[3]["licenses"] == found[4]["licenses"] == found[6]["sentences"] == []
    assert licenses.scan(docs.limit(0)).count() == 0


def test_leaks(docs, benchmark):
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, benchmark).collect()}
    assert set(found) == {(1, 1), (2, 1), (None, 1), (6, 5), (8, 4)}
    assert found[1, 1]["similarity"] == 1 and found[8, 4]["start_word"] == 10
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 7, 9]
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, benchmark.limit(0)).count() == len(ROWS)


def test_secrets(docs):
    found, n = by_id(secrets.find_secrets(docs))
    assert n == len(ROWS)
    assert [tuple(x) for x in found[9]["base"]] == [(2, 0, 27)]
    assert found[3]["spans"] == found[4]["spans"] == []
    masked, n = by_id(secrets.mask(docs))
    assert n == len(ROWS) and secrets.mask(docs).columns == docs.columns
    assert masked[9]["text"] == "\U0001f600 <SECRET> and more. Licensed under the MIT License."
    assert masked[9]["n_chars"] == len(masked[9]["text"])
    assert masked[3]["text"] is None and masked[4]["text"] == "" and masked[6]["text"] == LONG
    assert secrets.find_secrets(docs.limit(0)).count() == secrets.mask(docs.limit(0)).count() == 0


def test_scores(docs):
    found, n = by_id(lmscore.scores(docs))
    assert n == len(ROWS)
    assert (found[3]["n_words"], found[3]["log_score"]) == (0, 0.0) == (found[5]["n_words"], found[5]["log_score"])
    assert found[1]["log_score"] == pytest.approx(found[2]["log_score"]) and found[6]["n_words"] == 12_000
    assert lmscore.scores(docs.limit(0)).count() == 0


def test_mix(docs):
    rows = mix.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["source"] for r in rows} == {None, "a", "b", "c"}
    taken, aim = {}, {r["source"]: r["target"] for r in rows}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - aim[s]) <= 2 * mix.BLOCK_WORDS for s in aim)
    assert sorted(map(tuple, mix.mix(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mix.mix(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mix.mix(docs.where("text is null")).collect()] == [0]


def test_language(docs):
    found, n = by_id(langid.identify(docs))
    assert n == len(ROWS)
    assert [found[k]["lang_pred"] for k in (3, 4, 5, 7)] == ["und"] * 4
    assert all(found[k]["score"] == 0 and found[k]["rejected"] for k in (3, 4, 5, 7))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.identify(docs.limit(0)).count() == 0
    nameless = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nameless.collect()} == {"und"}


def test_quality(docs, labels):
    found, n = by_id(quality.graded(docs, labels))
    assert n == len(ROWS)
    assert all(found[k]["tail_prob"] == 0 and not found[k]["kept"] for k in (3, 4, 5))
    assert all(0 <= r["tail_prob"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in found.values())
    assert quality.graded(docs.limit(0), labels).count() == 0
    unrated, _ = by_id(quality.graded(docs, labels.limit(0)))
    assert unrated[1]["kept"] and not unrated[4]["kept"]
    assert quality.good_ones(docs, labels).columns == docs.columns


def test_pages(spark):
    html = "<html><body><nav>Home</nav><p>First  line &amp; more</p><p>Second</p></body></html>"
    rows = [(1, "http://a.example/x/1", html), (1, "http://a.example/x/1", html), (2, None, None), (3, "", ""), (4, "http://b.example/", "<p>" + LONG), (None, "no url", "plain words")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit("x"))
    found, n = by_id(pages.main_text(table), "page_id")
    assert n == len(rows)
    assert found[1]["text"] == "First line & more\nSecond" and found[1]["n_chars"] == len(found[1]["text"])
    assert (found[2]["text"], found[2]["n_chars"], found[2]["url"]) == ("", 0, None)
    assert found[4]["text"] == LONG and found[None]["text"] == "plain words"
    assert pages.main_text(table.limit(0)).count() == 0


def test_embeddings(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [float("inf"), 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("label", F.lit(1))
    found, n = by_id(embeddings.near_duplicates(table), "vec_id")
    assert n == len(rows)
    assert found[1]["component_id"] == found[2]["component_id"] == 1 and found[1]["kept"] and not found[2]["kept"]
    assert all(found[k]["n_links"] == 0 and found[k]["component_id"] == k for k in (3, 4, 5, 6, 7, 8, 9, 10, None))
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, benchmark, labels, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == docs.columns, name
            at = corpus_pipeline.stash(at)
        corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
