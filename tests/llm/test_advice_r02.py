"""Cases of the second review: work that was once left out."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickledger.llm import exact_search, main_text, near_duplicates


def test_links_hidden_among_texts_just_under_the_threshold(spark):
    """2,000 texts at 70 of 90 words to each other, 30 planted pairs at 72 of 88: no bucket may hide one."""
    common = [f"c{i}" for i in range(70)]
    own = [[f"u{d}x{i}" for i in range(10)] for d in range(2000)]
    places = np.random.default_rng(3).permutation(2000)[:60].reshape(30, 2)
    for a, b in places:
        own[b][:2] = own[a][:2]
    rows = [(d, " ".join(common + own[d])) for d in range(2000)]
    sets = [set(common + words) for words in own]
    expected = {d: d for d in range(2000)}
    for a in range(2000):
        for b in range(a):
            shared = 70 + len(sets[a].intersection(own[b]))
            if shared * 100 >= (160 - shared) * 80:
                expected[a] = b
    assert sum(d != c for d, c in expected.items()) == 30
    found = near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", words=1)
    assert {r["id"]: r["component_id"] for r in found.collect()} == expected


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_rare_shingles_miss_no_close_pair(spark, percent):
    """Sets of all sizes around a few bases, against every pair of them."""
    rng = np.random.default_rng(percent)
    sets = {}
    for d in range(300):
        size = int(rng.choice([1, 2, 5, 30, 63, 64, 65, 90, 130, 300]))
        base = np.arange(size) + 1000 * int(rng.integers(0, 3))
        moved = rng.random(size) < rng.choice([0, 0.02, 0.08, 0.12, 0.3])
        sets[d] = np.unique(np.where(moved, rng.integers(5000, 5400, size), base))
    component = {d: d if d % 3 else 0 for d in sets}
    schema = "rep long, n long, component long"
    docs = spark.createDataFrame([(d, len(x), component[d]) for d, x in sets.items()], schema)
    grams = spark.createDataFrame([(d, x.tolist()) for d, x in sets.items()], "id long, grams array<long>")
    candidates = near_duplicates._candidates(docs, grams, percent)
    found = near_duplicates._confirmed(candidates, grams, percent).collect()
    expected = set()
    for a, x in sets.items():
        for b, y in sets.items():
            shared = len(np.intersect1d(x, y))
            if a < b and component[a] != component[b] and shared * 100 >= (len(x) + len(y) - shared) * percent:
                expected.add((a, b))
    assert expected and {(min(p), max(p)) for p in found} == expected and len(found) == len(expected)


def test_size_classes(spark):
    made = spark.range(1, 5000).selectExpr("id", f"{near_duplicates._size_class('id')} AS c")
    rows = made.selectExpr("id", "c", f"{near_duplicates._smallest_of_class('c')} AS low").orderBy("id").collect()
    first = {}
    for r in rows:
        first.setdefault(r["c"], r["id"])
    assert all(r["low"] == first[r["c"]] for r in rows)
    assert sorted(first) == list(range(1, rows[-1]["c"] + 1)) and all(r["c"] == r["id"] for r in rows[:64])


def test_search_keeps_vectors_with_large_components(spark):
    """Scaled components beyond 2**27 take part, also where a long does not hold the score."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(60)]
    rows[20] = 20, [3e7, 1.0, -2.5, 0.0, 1.0, 4.0]
    rows[31] = 31, [-4e7, 2.0, 0.5, 1.5, 0.0, 1.0]
    rows[32] = 32, [5e7, 2.25, 0.5, 1.5, 0.0, 1.0]
    rows[33], rows[34] = (33, [1e30, 0.0, 0.0, 0.0, 0.0, 1.0]), (34, [2e30, 0.0, 0.0, 0.0, 0.0, 1.0])
    rows[40] = 40, [-1e307, 0.0, 0.0, 0.0, 0.0, 1.0]
    whole = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in rows}
    expected = {}
    for q in range(0, 60, 20):
        scores = {i: sum(a * b for a, b in zip(whole[q], v, strict=True)) for i, v in whole.items() if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:15]
        expected |= {(q, r): (i, min(max(scores[i], -(2**63)), 2**63 - 1)) for r, i in enumerate(best, 1)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_search.top_k(df, F.col("vec_id") % 20 == 0, k=15, shard_rows=25).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == expected


LONG = " ".join(["The council met on Monday to talk about the new bridge over the river and its cost."] * 4)


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class='has-sidebar'><article><p>{}</p></article></div></body>",
        "<body><div id='with-banner'><main><p>{}</p></main></div></body>",
        "<body><article><p><svg viewBox='0 0 1 1'/>{}</p></article><svg><text>icon</text></svg></body>",
        "<body><article><p><math />{}</p></article></body>",
        "<html><head><meta charset='utf-8'><title>t</title><article><p>{}</p></article></html>",
    ],
)
def test_main_text_keeps_whole_articles(page):
    assert main_text.main_text(page.format(LONG)) == LONG


@pytest.mark.parametrize(
    "page",
    [
        "<body><article><p>{}</p><div class='comments'><article><p>Nice one, thanks for this, I read it all with joy.</p></article></div></article></body>",
        "<body><article><p>{}</p></article><aside><article><p>Nice one, thanks for this, I read it all with joy.</p></article></aside></body>",
    ],
)
def test_main_text_still_drops_articles_beside(page):
    assert main_text.main_text(page.format(LONG)) == LONG
