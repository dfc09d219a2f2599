"""Kneser-Ney probabilities and the ordinal fit against plain versions, and what the language models reject."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from discoforge.llm import langid, quality


def plain_models(languages, order=4):
    """P(last code | codes before it) of each language by the textbook recursion, over lists of code sequences."""
    every = {n: set() for n in range(1, order + 1)}
    counts = []
    for texts in languages:
        own = {order: Counter()}
        for codes in texts:
            padded = [1] * (order - 1) + list(codes)
            own[order].update(tuple(padded[i : i + order]) for i in range(1, len(codes)))
        for n in range(order - 1, 0, -1):
            own[n] = Counter(g[1:] for g in own[n + 1])  # how many different codes stand before it
        counts.append(own)
        for n in own:
            every[n] |= set(own[n])
    return [textbook(own, len(every[1])) for own in counts]


def textbook(own, codes):
    """The recursion of one language; below all n-grams each of its codes, and one more, is as likely."""
    discount, total, kinds = {}, {}, {}
    for n in own:
        ones, twos = (sum(c == k for c in own[n].values()) for k in (1, 2))
        discount[n] = ones / (ones + 2 * twos) if ones else 0.5
        total[n], kinds[n] = defaultdict(int), defaultdict(int)
        for g, c in own[n].items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(gram):
        n = len(gram)
        below = 1 / (codes + 1) if n == 1 else p(gram[1:])
        if not total[n][gram[:-1]]:
            return below
        return (max(own[n][gram] - discount[n], 0) + discount[n] * kinds[n][gram[:-1]] * below) / total[n][gram[:-1]]

    return p


def test_models_equal_the_textbook():
    texts = [["abcab ab", "bcab and a ban", "cabbage"], ["das ab und cab", "ba da ba"]]
    codes = [[langid.codes(t) for t in own] for own in texts]
    models = langid.Models(["x", "y"], [np.unique(np.concatenate([langid.grams(c) for c in own]), return_counts=True) for own in codes])
    plain = plain_models([[list(map(int, c)) for c in own] for own in codes])
    for text in ("abcab ab", "das und", "a cabban", "ünd zq bab"):
        own = list(map(int, langid.codes(text)))
        padded = [1] * 3 + own
        got = np.exp(models.log_probs(langid.grams(langid.codes(text))))
        for i in range(1, len(own)):
            for k in range(2):
                assert got[i - 1, k] == pytest.approx(plain[k](tuple(padded[i : i + 4])), rel=1e-4)


def test_long_texts_in_pieces(monkeypatch):
    texts = ["abcab ab and a ban of cab " * 40, "", "ban", "abc " * 90]
    models = langid.Models(["x", "y"], [np.unique(langid.grams(langid.codes(t)), return_counts=True) for t in ("abcab and a ban", "of cab bag")])
    whole = models.entropies(texts)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.allclose(models.entropies(texts), whole, equal_nan=True) and np.isnan(whole[1]).all()


def test_foreign_texts_are_rejected(spark):
    english = "the river ran along the old stone wall and the people of the town walked there in the evening with their dogs and children"
    german = "der kleine hund lief durch den garten und suchte seinen ball unter dem alten baum während die kinder im haus spielten"
    rng = np.random.default_rng(2)
    mixed = lambda text: " ".join(rng.permutation(text.split())[:14])
    rows = [(i, mixed(english if i % 2 else german), "en" if i % 2 else "de") for i in range(160)]
    rows += [(1000, "こんにちは世界、今日はとても良い天気ですね", None), (1001, "быстрая коричневая лиса прыгает через ленивую собаку", None), (1002, "zzqx kjwv qqpz xxkr vvbn wqzx", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k]["rejected"] for k in (1000, 1001, 1002))
    known = [got[i] for i in range(160)]
    assert sum(r["rejected"] for r in known) <= 4
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in known)


def likelihood(rows, grades, weight, weights, thresholds):
    """Weighted mean log-likelihood less the ridge, by the definition of the cumulative-link model."""
    out = 0.0
    for r, g, w in zip(rows, grades, weight):
        below = 1 / (1 + np.exp(-(thresholds - weights[r].sum())))
        chances = np.diff(np.concatenate([[0], below, [1]]))
        out += w * np.log(chances[g])
    return out - quality.RIDGE / 2 * (weights**2).sum()


def test_the_ordinal_fit_is_a_maximum():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 300)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 4), 100 + rng.integers(0, 6, 3) + 4 * g])) for g in grades]
    share = np.array([0.2, 0.3, 0.5])
    model = quality.fit(rows, grades, share)
    weight = (share / np.bincount(grades))[grades]
    weights, thresholds = model.weights.astype(np.float64), model.thresholds
    best = likelihood(rows, grades, weight, weights, thresholds)
    used = np.nonzero(weights)[0]
    assert len(used) > 5
    for _ in range(40):  # no step to any side gains more than what the last rounds still moved
        by = np.zeros(len(weights))
        by[used] = rng.normal(size=len(used)) * 0.05
        assert likelihood(rows, grades, weight, weights + by, thresholds) < best + 2e-3
        assert likelihood(rows, grades, weight, weights, thresholds + rng.normal(size=2) * 0.05) < best + 2e-3
    start = likelihood(rows, grades, weight, weights * 0, np.log(np.cumsum(share)[:-1] / (1 - np.cumsum(share)[:-1])))
    assert best > start + 0.3
