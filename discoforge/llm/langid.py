"""Language ID: interpolated Kneser-Ney character models per language, kept in sorted arrays of packed n-grams."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

ORDER = 4
#: Documents of a language that the models may be fitted to, and more of them that calibrate the score.
FIT_DOCS, CALIBRATE_DOCS = 300, 60
#: Characters that are looked up together.
CHUNK = 1 << 20
#: Rejected are texts further above all but this share of the calibrating documents than so many nats a character: other
#: topics of a known language stay well below, other languages and scripts lie above.
REJECTED_SHARE, REJECTED_MARGIN = 0.005, 0.5
#: Hashes of ids fall on so many places.
_PLACES = 1 << 62
UNKNOWN = "und"
_BITS = 16


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and 16 bits for its lower case."""
    alpha, lower = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            alpha[c] = True
            lower[c] = ord(x.lower()[0])
    return alpha, np.where(lower > 0xFFFF, (lower * np.uint64(0x9E37)) & np.uint64(0xFFFF) | np.uint64(0x8000), lower)


def codes(text: str | None) -> np.ndarray:
    """Letters in lower case with 1 for each run of other characters between them, and 1 at both ends; empty without letters."""
    alpha, lower = _letters()
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = alpha[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    out = np.where(letter, lower[points], np.uint64(1))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = out[keep]
    if out[-1] != 1:
        out = np.append(out, np.uint64(1))
    return out if out[0] == 1 else np.insert(out, 0, np.uint64(1))


def grams(seq: np.ndarray, n: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each code but the first, packed by 16 bits; codes before the start are 1."""
    padded = np.concatenate([np.ones(n - 1, np.uint64), seq])
    out = np.zeros(len(seq), np.uint64)
    for k in range(n):
        out = (out << np.uint64(_BITS)) | padded[k : k + len(seq)]
    return out[1:]


def _index(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted keys, -1 if absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << _BITS * n) - 1)


class Models:
    """One model a language. keys[n]: sorted n-grams of any language; logs[n]: log probabilities, a column a language; gammas[n]: log back-off weights of contexts of n codes."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        levels = []  # by language and order: n-grams with their counts, below the top order the number of codes before them
        for keys, n in counts:
            own = {ORDER: (keys, n.astype(np.float64))}
            for order in range(ORDER - 1, 0, -1):
                above = own[order + 1][0]
                own[order] = tuple(np.unique(above & _mask(order), return_counts=True))
            levels.append(own)
        self.keys = {n: np.unique(np.concatenate([own[n][0] for own in levels])) for n in range(1, ORDER + 1)}
        self.contexts = {n: np.unique(self.keys[n + 1] >> np.uint64(_BITS)) for n in range(0, ORDER)}
        self.logs, self.gammas = {}, {}
        prob_below = [np.full(1, 1.0 / (len(self.keys[1]) + 1)) for _ in langs]
        for n in range(1, ORDER + 1):
            probs, gammas = [], []
            for own, lower in zip(levels, prob_below):
                keys, c = own[n]
                c = c.astype(np.float64)
                once, twice = (c == 1).sum(), (c == 2).sum()
                discount = once / (once + 2 * twice) if once else 0.5
                place = np.searchsorted(self.contexts[n - 1], keys >> np.uint64(_BITS)) if n > 1 else np.zeros(len(keys), np.int64)
                total = np.bincount(place, c, len(self.contexts[n - 1]))
                kinds = np.bincount(place, minlength=len(self.contexts[n - 1]))
                gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
                every = self.keys[n]
                context = np.searchsorted(self.contexts[n - 1], every >> np.uint64(_BITS)) if n > 1 else np.zeros(len(every), np.int64)
                below = lower[np.searchsorted(self.keys[n - 1], every & _mask(n - 1))] if n > 1 else np.full(len(every), lower[0])
                p = gamma[context] * below
                at = np.searchsorted(every, keys)
                p[at] += np.maximum(c - discount, 0) / total[place]
                probs.append(p)
                gammas.append(gamma)
            prob_below = probs
            self.logs[n], self.gammas[n - 1] = np.log(np.array(probs).T).astype(np.float32), np.log(np.array(gammas).T).astype(np.float32)
        self.floor = float(np.log(1.0 / (len(self.keys[1]) + 1)))
        self.heat, self.most = 1.0, np.inf

    def log_probs(self, wanted: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log probability of the last code of each n-gram, a column a language; unseen n-grams back off."""
        at = _index(self.keys[n], wanted)
        out = self.logs[n][at]
        miss = at < 0
        if miss.any():
            rest = wanted[miss]
            if n == 1:
                out[miss] = self.floor + self.gammas[0][0]
            else:
                context = _index(self.contexts[n - 1], rest >> np.uint64(_BITS))
                gamma = np.where((context >= 0)[:, None], self.gammas[n - 1][context], np.float32(0))
                out[miss] = gamma + self.log_probs(rest & _mask(n - 1), n - 1)
        return out

    def entropies(self, texts) -> np.ndarray:
        """Cross-entropy a character of each text, a column a language; NaN without letters. All characters count."""
        sums, counts, held, rows, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), [], [], 0

        def settle():
            kinds, at = np.unique(np.concatenate(held), return_inverse=True)
            logs = self.log_probs(kinds)
            starts = np.cumsum([0] + [len(h) for h in held[:-1]])
            for k in range(len(self.langs)):
                np.add.at(sums[:, k], rows, np.add.reduceat(logs[:, k].astype(np.float64)[at], starts))

        for i, text in enumerate(texts):
            every = grams(codes(text))
            counts[i] = len(every)
            for start in range(0, len(every), CHUNK):
                held.append(every[start : start + CHUNK])
                rows.append(i)
                size += len(held[-1])
                if size >= CHUNK:
                    settle()
                    held, rows, size = [], [], 0
        if held:
            settle()
        return np.where(counts[:, None] > 0, -sums / np.maximum(counts, 1)[:, None], np.nan)

    def predict(self, texts) -> pd.DataFrame:
        """lang_pred, score, entropy and rejected of each text. Of equal entropies the first language by name wins."""
        h = self.entropies(texts)
        known = ~np.isnan(h[:, 0]) if len(self.langs) else np.zeros(len(texts), bool)
        best = np.zeros(len(texts), np.int64)
        score, entropy = np.zeros(len(texts)), np.full(len(texts), np.nan)
        if known.any():
            own = h[known]
            best[known] = own.argmin(axis=1)
            entropy[known] = own.min(axis=1)
            score[known] = 1 / np.exp(-self.heat * (own - own.min(axis=1, keepdims=True))).sum(axis=1)
        names = np.array([*self.langs, UNKNOWN], object)
        return pd.DataFrame({"lang_pred": names[np.where(known, best, len(self.langs))], "score": score, "entropy": entropy, "rejected": ~known | (entropy > self.most)})

    def calibrate(self, texts: list[str], truth: np.ndarray) -> None:
        """Fit the heat of the score's softmax to known texts by likelihood, and the entropy above which a text is rejected."""
        h = self.entropies(texts)
        some = ~np.isnan(h[:, 0])
        if not some.any():
            return
        h, truth = h[some], truth[some]
        gap = h - h.min(axis=1, keepdims=True)

        def loss(heat: float) -> float:
            return float((heat * gap[np.arange(len(h)), truth] + np.log(np.exp(-heat * gap).sum(axis=1))).mean())

        self.heat = min((2.0**k for k in np.arange(-2, 7, 0.25)), key=loss)
        self.most = float(np.quantile(h.min(axis=1), 1 - REJECTED_SHARE)) + REJECTED_MARGIN


def held_out(doc_id):
    """Column: crc32 of the id as text, modulo 3, is 1. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> Models | None:
    """Models of the languages that docs (doc_id, text, lang) name; None if they name none.

    Of each language at most FIT_DOCS + CALIBRATE_DOCS documents take part, those with the least hashes of their
    ids, with their whole texts; of several rows of an id the least text. They are ranked among the lowest hashes
    only, about four times as many, so a language of any size has a small ranking. Only counts of n-grams and the
    calibrating texts reach the driver. Every sixth of them, the first excepted, calibrates.
    """
    named = docs.where("lang is not null and text is not null and doc_id is not null")
    place, most, near = F.xxhash64("doc_id").bitwiseAND(F.lit(_PLACES - 1)), FIT_DOCS + CALIBRATE_DOCS, F.lit(False)
    for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect():  # a row a language
        near |= (F.col("lang") == r["lang"]) & (place < F.lit(min(_PLACES, _PLACES * 4 * most // r["n"])))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    chosen = named.where(near).select("doc_id", "lang").distinct().withColumn("nth", nth).where(F.col("nth") <= most).select("doc_id", "lang", "nth")
    sample = stash(named.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang", "nth").agg(F.min("text").alias("text")).select("lang", "text", "nth"))

    def count(batches):
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *[grams(codes(t)) for t in texts]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n})

    calibrating = (F.col("nth") % 6 == 0) & (F.col("nth") > 1)
    counted = sample.where(~calibrating).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    known = sample.where(calibrating).select("lang", "text").toPandas().sort_values(["lang", "text"])
    langs = sorted(counted["lang"].unique())
    if not langs:
        return None
    parts = []
    for lang in langs:
        own = counted[counted["lang"] == lang]
        keys, n = own["gram"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64)
        order = np.argsort(keys)
        parts.append((keys[order], n[order]))
    models = Models(langs, parts)
    known = known[known["lang"].isin(langs)]
    models.calibrate(list(known["text"]), np.searchsorted(langs, list(known["lang"])).astype(np.int64) if len(known) else np.zeros(0, np.int64))
    return models


def predictor(models: Models | None) -> Callable:
    """Column function of text: struct of lang_pred, score, entropy and rejected."""

    @F.pandas_udf("lang_pred string, score double, entropy double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if models is None:
            return pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "entropy": np.nan, "rejected": True}, index=range(len(texts)))
        return models.predict(list(texts))

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, rejected) of each row of docs; the prediction sees text only.

    Learns from rows that are not held out and have a language. lang_pred has the lowest cross-entropy a
    character over the whole text; score is its calibrated share among the languages; rejected marks texts that
    fit no language, which keep their lang_pred. Null texts and texts without letters get 'und', score 0 and
    rejected. Rows without an id are not held out and teach nothing. Without any named language all rows get
    'und'. Other columns are ignored; an empty table gives an empty result.
    """
    out = held_out(F.col("doc_id"))
    models = train(docs.select("doc_id", "text", "lang").where(~out))
    return docs.select("doc_id", out.alias("held_out"), predictor(models)("text").alias("p")).select("doc_id", "held_out", "p.*")
