"""Ranked search, merge-type vocabularies and whitening against plain versions, edges included."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

from discoforge.llm import contract, pieces, ranking, whitening
from tests.comparing import SF

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(docs, items, top=50):
    """Every document scored for every item, by the rule."""
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total, df = sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * len(held)) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(lower(text))) if t in c)
            if score > 0:
                scores.append((-score, (d is None, d or 0), d))
        out += [(item, n + 1, d, -s) for n, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2])[:top])]
    return sorted(out, key=str)


def searched(spark, docs, items, **k):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranking.search(d.repartition(3), i, **k).collect()), key=str)


def test_search_equals_scoring_all(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LEAF", 3)
    monkeypatch.setattr(ranking, "FANOUT", 2)
    monkeypatch.setattr(ranking, "SHARD_DOCS", 40)
    rng = random.Random(4)
    words = [f"W{int(rng.paretovariate(0.7))}" for _ in range(5000)]
    docs = [(n, " ".join(rng.choices(words, k=rng.choice((1, 5, 40))))) for n in range(400)]
    docs += [(1000 + n, docs[7][1]) for n in range(90)]  # ties beyond the last place
    items = [(n, " ".join(rng.choices(words, k=8))) for n in range(15)] + [(20, docs[7][1])]
    assert searched(spark, docs, items) == ranked(docs, items)
    assert searched(spark, docs, items, top=3) == ranked(docs, items, 3)
    monkeypatch.setattr(ranking, "TERMS_AT_ONCE", 30)  # several passes
    assert searched(spark, docs, items) == ranked(docs, items)
    monkeypatch.setattr(ranking, "SHARD_POSTINGS", 50)
    assert searched(spark, docs, items) == ranked(docs, items)


def test_search_of_odd_rows(spark):
    docs = [(1, "Ärger_über-Öl, x1"), (2, None), (3, ""), (None, "x1 x1 öl"), (4, " \x00\t"), (5, "x1 " * 40000), (1, "ärger Öl"), (6, "the " * 3)]
    items = [(1, "X1 Öl"), (None, "ÄRGER über x1"), (2, None), (3, "?!"), (4, "absent"), (5, "the"), (1, "Öl x1 X1")]
    got = searched(spark, docs, items)
    assert got == ranked(docs, items)
    empty = spark.createDataFrame([], "doc_id long, text string, score long")
    asked = spark.createDataFrame([(1, "a", "b")], "item_id long, text string, rank string")
    assert ranking.search(empty, asked).count() == 0
    assert ranking.search(spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, score long"), asked.limit(0)).count() == 0
    assert [tuple(r) for r in ranking.search(spark.createDataFrame([(1, "a c", 7), (2, "b", 8), (3, "b", 9)], "doc_id long, text string, score long"), asked).collect()][0][:3] == (1, 1, 1)


def test_agenda_equals_the_library():
    own = pieces.Agenda(open(MODEL, "rb").read())
    rng = random.Random(2)
    letters = "ab \t\n▁é한😀\0the<s>0123▁  ﬁＡé​"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert own.encode(text) == own.library.encode(text), text
        assert own._merged_short(list(text)) == own._merged_long(list(text))
    own.check()
    own.kept["▁wrong"] = (5,)
    with pytest.raises(pieces.DifferentIds):
        own.check("wrong")
    own.kept.clear()
    own.kept.fresh = [("▁wrong", (5,))]
    with pytest.raises(pieces.DifferentIds):
        own.check()
    for text in ("ab" * 30000, "", " ", "▁" * 100, "x" * 5000, "internationalisation " * 500):
        assert own.encode(text) == own.library.encode(text)


def test_pieces_of_odd_rows(spark):
    rows = [(1, "Hello  world\n"), (None, None), (2, ""), (2, ""), (3, "é" * 20000 + " tail"), (4, "<0x0A></s>")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def of(doc, text):
        ids = library.encode(text or "")
        return doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    assert sorted(map(tuple, pieces.digests(docs, MODEL).collect()), key=str) == sorted((of(*r) for r in rows), key=str)
    encoded = pieces.encode(docs, MODEL)
    assert sorted((tuple(r) for r in pieces.decode(encoded, MODEL).collect()), key=str) == sorted(((d, library.decode(library.encode(t or ""))) for d, t in rows), key=str)
    assert pieces.encode(docs.limit(0), MODEL).count() == 0 == pieces.digests(docs.limit(0), MODEL).count()


def test_supplied_texts_and_vectors(spark):
    got = contract.QUERIES["op12_agenda_pieces"](spark, SF).toPandas()
    texts = pd.read_parquet(f"{SF}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {d: hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest() for d, t in zip(texts["doc_id"], texts["text"])}
    assert dict(zip(got["doc_id"], got["ids_sha256"])) == want and len(got) == len(texts)
    vectors = pd.read_parquet(f"{SF}/embeddings.parquet")
    whole(contract.QUERIES["op13_upper_triangle_whitening"](spark, SF).toPandas(), vectors["vec_id"], vectors["embedding"], 16)


def whole(got, ids, vectors, components):
    """Checks whitened rows against numpy over exact integers."""
    usable = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in zip(ids, vectors)]
    fit = np.array(sorted({tuple(x) for _, x in usable}))
    n, sums = len(fit), [sum(map(int, c)) for c in fit.T]
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == len(usable) * min(components, fit.shape[1]) and (got["n"] == n).all()
    by_id = {i: x for i, x in usable}
    for vec_id, own in got.groupby("vec_id"):
        x = by_id[vec_id]
        own = own.sort_values("component")
        assert (own["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))).all()
        for k, (w, e) in enumerate(zip(own["whitened"], own["explained"])):
            assert abs(e - values[k] / values.sum()) <= 1e-4 * values[k] / values.sum()
            plain = (np.array(x) - fit.mean(axis=0)) @ axes[:, k] / math.sqrt(values[k])
            assert abs(abs(w) - abs(plain)) < 1e-6
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component string")


@pytest.mark.parametrize("d", [3, 8, 19])
def test_whitening_equals_numpy(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(150, d)) @ rng.normal(size=(d, d))
    x[5:40] = x[4]  # a third are copies
    rows = [(i, [float(c) for c in v], "a", "b") for i, v in enumerate(x)]
    whole(whitening.whiten(vectors_of(spark, rows).repartition(5)).toPandas(), range(150), x, 16)


def test_whitening_of_odd_rows(spark):
    usable = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [3.0, 5.0]), (3, [3.0, 5.0]), (None, [1.0, 0.0])]
    odd = [(4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0]), (10, [1e300, 1.0])]
    table = vectors_of(spark, [(i, v, "a", "b") for i, v in usable + odd])
    got = whitening.whiten(table).toPandas()
    assert Counter(map(str, got["vec_id"].astype("Int64").tolist())) == {"1": 2, "2": 2, "3": 4, "<NA>": 2} and (got["n"] == 3).all()
    assert whitening.whiten(table.where("vec_id > 3")).toPandas()["vec_id"].tolist() == [9]
    assert whitening.whiten(table.limit(0)).count() == 0
    same = whitening.whiten(vectors_of(spark, [(1, [2.0, 2.0], "a", "b"), (2, [2.0, 2.0], "a", "b")])).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(0, None, None, None)] * 4
    flat = whitening.whiten(vectors_of(spark, [(i, [float(i), 7.0], "a", "b") for i in range(9)])).toPandas()
    assert flat[flat["component"] == 2]["whitened"].isna().all() and flat[flat["component"] == 1]["whitened"].notna().all()
    far = whitening.whiten(vectors_of(spark, [(1, [1e12 / 64, 0.0], "a", "b"), (2, [-1e12 / 64, 3.0], "a", "b"), (3, [0.0, 1.0], "a", "b")])).toPandas()
    assert far[far["vec_id"] == 1]["deviation"].isna().all()
