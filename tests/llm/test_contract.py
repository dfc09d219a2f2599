"""Corpus queries against their SQL, brute force, planted cases and held-out rows."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from discoforge.llm import contract, decontaminate, embeddings, langid, lmscore, minhash, mix, pages, quality, secrets
from tests.comparing import SF, duck, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
supplied = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


@supplied
@pytest.mark.parametrize("name", sorted(set(contract.ORACLE_SQL)))
def test_query_equals_its_sql(spark, name):
    got, want = contract.QUERIES[name](spark, SF).toPandas(), duck(contract.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def shingles(text, n):
    w = WORDS.findall((text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(sets, percent=80):
    """Least id that each id reaches over pairs of sets alike in percent of their members."""
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(k for k in sets if sets[k])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {k: root(k) for k in sets}


def copies(seed, groups, size, words=60):
    """Texts around the threshold: each of a group differs from the first in a few words."""
    rng = random.Random(seed)
    out = {}
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
            out[len(out)] = " ".join(own)
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = copies(1, 12, 8) | {1000 + i: t for i, t in copies(2, 1, 60).items()}  # one large bucket too
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle_words=4)
    want = classes({k: shingles(t, 4) for k, t in texts.items()})
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 16)
    texts = copies(3, 2, 70)
    for g in range(2):  # near the edge of the group: its members link with few of the others
        own = texts[70 * g].split()
        for i in range(12):
            texts[200 + 20 * g + i] = " ".join([f"y{g}"] * (i // 3) + own[: 60 - i])
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle_words=4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == classes({k: shingles(t, 4) for k, t in texts.items()})


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BAND_BYTES", 20 * 24 * 8)
    monkeypatch.setattr(embeddings, "LEADING", 4)
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 400)] + 0.3 * rng.normal(size=(400, 24))).astype(np.float32)
    x[10:14] = x[10]
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(400), "embedding": [list(map(float, v)) for v in x]}), "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(table).toPandas().set_index("vec_id").sort_index()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert (got["n_links"].to_numpy() == near.sum(axis=1)).all() and near.sum() > 400
    least = np.arange(400)
    for _ in range(400):
        least = np.minimum(least, np.where(near, least[None, :], 400).min(axis=1))
    assert (got["component_id"].to_numpy() == least).all()


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(3000)}"
    items = {i: [word() for _ in range(rng.choice((3, 5, 12, 30, 700)))] for i in range(20)}
    docs = {}
    for d in range(120):
        held = list(items[d % 20])
        for _ in range(rng.randrange(3)):
            held[rng.randrange(len(held))] = word()
        docs[d] = [word() for _ in range(rng.randrange(80))] + held + [word() for _ in range(rng.randrange(80))]
    got = decontaminate.leaks(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"))
    want = {}
    for i, item in items.items():
        step = math.ceil(len(item) / math.ceil(len(item) / decontaminate.PART_WORDS))
        for at in range(0, len(item), step):
            part = item[at : at + step]
            k = min(5, len(part))
            bag = lambda w, k=k: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
            mine = bag(part)
            for d, w in docs.items():
                if not mine & bag(w):
                    continue
                for start in range(len(w) - len(part) + 1):
                    theirs = bag(w[start : start + len(part)])
                    s = sum((mine & theirs).values()) / sum((mine | theirs).values())
                    if s >= 0.8:
                        want[d, i] = max(want.get((d, i), 0), s)
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in got.collect()} == want
    assert len(want) > 30


def base_spans(text):
    out = []
    for kind, (pattern, least, group) in enumerate([(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), (r"AKIA[A-Z0-9]+", 20, 0), (r"[0-9a-f]+", 24, 0)]):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "", re.A) if len(m[group]) >= least]
    return sorted(out)


@supplied
def test_base_secrets_equal_patterns(spark):
    docs = read("documents")
    got = {r["doc_id"]: r for r in contract.op4_linked_secrets(spark, SF).collect()}
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        spans = base_spans(text)
        label = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        assert got[doc_id]["base_sha256"] == hashlib.sha256(label.encode()).hexdigest()
        assert set(label.split(",")) - {""} <= set(got[doc_id]["spans"].split(","))


def test_weak_parts_count_only_together(spark):
    secret = "Zx9Qm3Lk7Wv2Rt5Yp8Nb"
    texts = [f"client_id: acme-77 then {secret}", f"only {secret} here", "client_id: acme-77 alone", f"client_id: acme-77\n\n{secret}", f"client_id: acme-77 {'pad ' * 60}{secret}", f"{secret} at https://api.example.com/v1"]
    found = {r["doc_id"]: {secrets.KINDS[s["kind"]] for s in r["spans"]} for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: {"ident", "weak"}, 1: set(), 2: set(), 3: set(), 4: {"ident", "weak"}, 5: {"weak", "endpoint"}}


def test_scores_equal_brute_force(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30))) for i in range(60)}
    got = {r["doc_id"]: r["log_score"] for r in lmscore.scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block_chars=200).collect()}
    bags = {i: [Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) for n in (1, 2, 3)] for i, w in ((i, t.split()) for i, t in texts.items())}
    every = [sum((b[n] for b in bags.values()), Counter()) for n in range(3)]
    for i, text in texts.items():
        w, c = text.split(), [every[n] - bags[i][n] for n in range(3)]
        total, log = 0, 0.0
        total = sum(c[0].values())
        for j in range(len(w)):
            s = max(c[0][(w[j],)], lmscore.UNSEEN) / total
            for n in (2, 3):
                if j + 1 >= n:
                    gram = tuple(w[j + 1 - n : j + 1])
                    s = c[n - 1][gram] / c[n - 2][gram[:-1]] if c[n - 1][gram] else lmscore.BACKOFF * s
            log += math.log(s)
        assert got[i] == pytest.approx(log)


def test_apportionment_equals_divisors(spark):
    rng = random.Random(8)
    parties = [(g, f"p{p}", rng.choice((0, 1, 7, 7, 40, 333, rng.randrange(1, 2000))), seats) for g, seats in enumerate((0, 1, 5, 64, 1000)) for p in range(9)]
    got = mix.sainte_lague(spark.createDataFrame(parties, "g int, name string, votes long, seats long"), ["g"], "votes", "seats", ["name"])
    found = {(r["g"], r["name"]): r["quota"] for r in got.collect()}
    for g, seats in enumerate((0, 1, 5, 64, 1000)):
        votes = {n: v for h, n, v, _ in parties if h == g and v}
        won = Counter(n for _, n, _ in sorted(((-v / (2 * k - 1), n, k) for n, v in votes.items() for k in range(1, seats + 1)))[:seats])
        assert {n: found[g, n] for n in votes} == {n: won[n] for n in votes}
    assert all(found[g, n] == 0 for g, n, v, _ in parties if not v)


@supplied
def test_language_of_held_out_documents(spark):
    got = contract.op7_kneser_ney_language(spark, SF).toPandas().merge(read("documents")[["doc_id", "lang"]], on="doc_id")
    held = got[got["held_out"] & got["lang"].notna()]
    assert len(held) > 20 and (held["lang"] == held["lang_pred"]).mean() >= 0.95


def test_kneser_ney_sums_to_one():
    counts = [np.unique(np.concatenate([langid.grams(langid.codes(t)) for t in texts]), return_counts=True) for texts in (["abcab ab", "bcab"], ["cab ba"])]
    models = langid.Models(["x", "y"], counts)
    every = models.keys[1]
    for context in ("ab", "zq", "ca"):
        start = langid.grams(langid.codes(context))[-2] & langid._mask(3)
        total = np.exp(models.log_probs((start << np.uint64(16)) | every)).sum(axis=0)
        assert (total <= 1 + 1e-5).all() and (total > 0.5).all()


@supplied
def test_quality_of_unseen_documents(spark):
    """Learns from even ids of the larger tables where they are, and is asked for the odd ones."""
    sf = SF.replace("sf0.001", "sf0.01") if os.path.isdir(SF.replace("sf0.001", "sf0.01")) else SF
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.graded(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = (got["quality"] == 1) & (got["toxic"] == 0)
    assert got[good]["kept"].mean() > 0.9 and got[~good]["kept"].mean() < 0.35


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 600)
    buckets = [np.unique(np.concatenate([rng.integers(0, 50, 5), 100 + rng.integers(0, 8, 3) + 10 * g])) for g in grades]
    model = quality.fit(buckets, grades, np.bincount(grades) / 600)
    assert (np.diff(model.thresholds) > 0).all()
    chance = model.chances(np.array([model.weights[b].sum() for b in buckets]))
    assert np.allclose(chance.sum(axis=1), 1) and (chance.argmax(axis=1) == grades).mean() > 0.9


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        kept = [x for x, k in zip(a, pages.shared(a, b)) if k]
        at = iter(b)
        assert all(x in at for x in kept) and len(kept) == lcs(a, b)


def test_neighbours_lose_their_shared_lines(spark):
    page = lambda own: f"<html><body><div>Site name</div><div>Pick a topic</div><div>{own}</div><div>All rights kept</div></body></html>"
    rows = [(1, "https://x.example/news/1", page("One tale")), (2, "https://x.example/news/2", page("Two tales")), (3, "https://y.example/", page("Three"))]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1], got[2]) == ("One tale", "Two tales") and got[3].startswith("Site name")


def test_articles_are_kept_whole(spark):
    article = "<article><h1>Title</h1><p>Quoted  passage<br>goes on &eacute;&#33;</p><script>no()</script><div class='comments'><p>First!</p></div><p>{}</p></article>"
    page = "<html><head><title>t</title></head><body><nav><ul><li>Home</ul></nav><div class=ad>Buy</div>" + article + "<footer>f</footer></body></html>"
    rows = [(i, f"https://x.example/{i}", page.replace("{}", f"end {i}")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title\nQuoted passage goes on é!\nend {i}" for i in range(3)}


@supplied
def test_pipeline_stages_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.stash(stage(spark, at, SF))
        assert at.columns == docs.columns
        seen[name] = at.toPandas().set_index("doc_id")
    graded, single, clean, masked = seen.values()
    verdict = contract.op8_ordinal_quality(spark, SF).toPandas()
    assert set(graded.index) == set(verdict[verdict["kept"]]["doc_id"])
    best = classes({k: shingles(t, 5) for k, t in graded["text"].items()})
    assert set(single.index) == {k for k, v in best.items() if k == v}
    leaking = set(decontaminate.leaks(spark.createDataFrame(single.reset_index()[["doc_id", "text"]]), spark.read.parquet(f"{SF}/benchmark.parquet")).toPandas()["doc_id"])
    assert set(clean.index) == set(single.index) - leaking
    assert set(masked.index) == set(clean.index)
    for k, text in clean["text"].items():
        assert not base_spans(masked["text"][k]) and (masked["text"][k] == text or "<SECRET>" in masked["text"][k])
        if not base_spans(text) and "<SECRET>" not in masked["text"][k]:
            assert masked["text"][k] == text
    mixed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(mixed["doc_id"]) == set(masked.index) and (mixed["taken"] <= 3 * mixed["size"]).all()
