"""The whole page query against a plain reading of its rules, whatever the number of ranges."""

import random

import pytest
from pyspark.sql import functions as F

from discoforge.llm import pages

LINES = [f"line {i} of the site" for i in range(12)]


def site(rng):
    """Pages of three hosts: templates, copies, articles, teasers, and rows without url."""
    rows = []
    for n in range(90):
        host = rng.choice(["a", "a", "a", "b", "c"])
        own = [f"tale {n} {i} " + "word " * rng.randrange(1, 30) for i in range(rng.randrange(1, 6))]
        body = [rng.choice(LINES) for _ in range(rng.randrange(8))] + own + [rng.choice(LINES)]
        html = "".join(f"<div>{x}</div>" for x in body)
        form = rng.randrange(4)
        if form == 1:
            html = f"<div>{LINES[0]}</div><article>{html}</article><div>{LINES[1]}</div>"
        if form == 2:
            html += f"<article>{LINES[2]}</article>"
        url = rng.choice([f"https://{host}.example/{rng.choice('xy')}/{rng.randrange(20)}?p={n}", f"https://{host}.example/{n}", None])
        rows.append((n, url, f"<html><body><nav>Home</nav>{html}</body></html>"))
    rows += [rows[3], (200, rows[5][1], rows[5][2]), (201, rows[5][1], rows[5][2]), (None, None, None)]
    return rows


def plain(rows, seal):
    """page_id, url and text of each row: neighbours by order, nearest first, then the same rules."""
    laid = []
    for page_id, url, html in rows:
        rest = (url or "").split("://", 1)[-1]
        host, _, path = rest.partition("/")
        path = "/" + path.split("?")[0] if url else ""
        laid.append(((host, path, url or "", "" if page_id is None else str(page_id), seal[html]), page_id, url, html))
    laid.sort(key=lambda r: r[0])
    out = []
    for i, (key, page_id, url, html) in enumerate(laid):
        near = []
        for n in (1, 2):
            beside = [laid[j] for j in (i - n, i + n) if 0 <= j < len(laid) and laid[j][0][0] == key[0]]
            near += sorted(beside, key=lambda r: -pages.nearness(r[0][1], key[1]))
        out.append((page_id, url, pages.article(pages.blocks(html), *[pages.blocks(r[3]) for r in near] or [None])))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [10**9, 3000, 300])
def test_ranges_do_not_matter(spark, monkeypatch, chars):
    monkeypatch.setattr(pages, "RANGE_CHARS", chars)
    rows = site(random.Random(5))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    seal = {r["html"]: r["h"] for r in table.select("html", F.xxhash64("html").alias("h")).distinct().collect()}
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in pages.main_text(table).collect()), key=str)
    assert got == plain(rows, seal)


def test_a_teaser_is_no_body():
    body = [("The tale of a river, told at length", pages.PLAIN), ("and its many bends and mills", pages.PLAIN)]
    assert pages.article([("Menu", pages.PLAIN), *body, ("Read on", pages.MAIN)], [("Menu", pages.PLAIN), ("Other", pages.PLAIN)]) == "The tale of a river, told at length\nand its many bends and mills\nRead on"
    page = [("Menu", pages.PLAIN), ("Sale today", pages.PLAIN), ("A tale", pages.MAIN), ("A quote", pages.MAIN), ("goes on at some length", pages.MAIN)]
    assert pages.article(page, [("Menu", pages.PLAIN), ("A quote", pages.MAIN), ("Other", pages.MAIN)]) == "A tale\nA quote\ngoes on at some length"
