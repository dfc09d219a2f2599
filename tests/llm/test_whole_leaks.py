"""Leaks whose words stand in another order than in the benchmark item."""

import random
from collections import Counter

import pytest

from discoforge.llm import decontaminate


def bag(words):
    return Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))


def test_leaks_in_another_order(spark):
    rng = random.Random(4)
    words = lambda n: [f"u{rng.randrange(5000)}" for _ in range(n)]
    items = {i: words(100) for i in range(6)}
    items[5] = items[5][:40] + items[5][:60]  # repeated shingles
    docs = {}
    for i, item in items.items():
        docs[10 * i] = words(30) + item[50:] + item[:50] + words(20)  # halves swapped
        docs[10 * i + 1] = item[25:] + item[:25]
        docs[10 * i + 2] = words(7) + item[70:] + item[:30] + item[30:70] + words(90)
        docs[10 * i + 3] = words(9) + item[60:] + words(30) + item[:60]  # too far apart
        docs[10 * i + 4] = item[80:] + item[60:80] + item[40:60] + item[20:40] + item[:20]  # four seams: under the threshold
        docs[10 * i + 5] = items[(i + 1) % 6][:50] + item[:50]  # halves of two items
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{name} long, text string")
    want = {}
    for i, item in items.items():
        for d, w in docs.items():
            for start in range(len(w) - len(item) + 1):
                mine, theirs = bag(item), bag(w[start : start + len(item)])
                s = (mine & theirs).total() / (mine | theirs).total()
                if s >= 0.8 and s > want.get((d, i), (0,))[0]:
                    want[d, i] = (s, start)
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["start_word"]) for r in decontaminate.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want
    assert {(10 * i + n, i) for i in range(6) for n in range(3)} <= set(want)
    assert not {d for d, _ in want} & {10 * i + n for i in range(5) for n in (3, 5)}


def test_starts_hold_enough(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(200):
        n = rng.randrange(1, 12)
        at = sorted(rng.sample(range(40), rng.randrange(1, 25)))
        rows.append((at, n, rng.randrange(1, min(n, len(at)) + 1)))
    got = spark.createDataFrame(rows, "at array<int>, n int, need int").select("at", "n", "need", decontaminate._starts("at", "n", "need").alias("s")).collect()
    for at, n, need, s in got:
        assert s == [x for x in range(41) if sum(x <= p < x + n for p in at) >= need]
