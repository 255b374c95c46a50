"""Ranked search against scores of all documents in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from countloom.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    n_terms = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for i, b in bags:
            n = sum(b.values())
            m = 50 + (50 * n * n_docs) // n_terms if n_terms else 50
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_equal_plain_ones(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical, "DOCUMENTS", 40)
    monkeypatch.setattr(lexical, "RANGE", 16)
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(rng.randrange(10**6), " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))) for _ in range(300)]
    docs += [docs[0]] * 30 + [(None, docs[0][1])] * 2 + [(7, None), (8, ""), (9, " .- "), (10, "é 漢字 w1"), (11, "w2 " * 20_000)]
    items = [(k, " ".join(rng.choice(pool).upper() for _ in range(rng.randrange(1, 25)))) for k in range(12)] + [(20, docs[0][1]), (20, "w1 w2"), (20, "w1 w2"), (21, None), (22, "..."), (23, "nowhere"), (None, "w3")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    wanted = plain(docs, items, 10)
    assert rows_of(lexical.search(d, q, top=10)) == wanted
    assert rows_of(lexical.search(d, q, top=10, pairs=40)) == wanted  # several blocks of items


def test_edge_cases(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha3 word"), (2, "")], "item_id long, text string")
    assert rows_of(lexical.search(edge_docs, items)) == plain([(r["doc_id"], r["text"]) for r in edge_docs.collect()], [(1, "alpha3 word"), (2, "")], 50)
    assert lexical.search(no_docs, items).count() == 0 and lexical.search(edge_docs, items.filter("false")).count() == 0


def test_documents_below_the_threshold_are_skipped():
    """Two terms, one of them in every document: once the heap is full of the rare one, the rest is not scored."""
    n = 5000
    docs = np.concatenate([np.arange(n), np.arange(0, n, 100)])
    term = np.repeat([0, 1], [n, n // 100])
    impact = np.where(term == 0, 5, 1000)
    heaps = lexical.Heaps(1, 10)
    scored = lexical.wand(docs, term * n + docs, impact, np.array([5, 1000]), np.array([[0, 1]]), np.array([0]), n, heaps, np.arange(n), np.zeros(n, bool))
    assert heaps.rows[1].tolist() == [1005] * 10 and heaps.rows[2].tolist() == list(range(0, 1000, 100))
    assert scored < n // 4  # ties with the tenth best are scored until the heap is full of the rare one


def test_large_numbers_stay_whole():
    lengths = np.array([3, 10**12])
    got = lexical.impacts(np.array([2, 7]), np.array([0, 1]), np.array([1500, 900]), lengths, 10**9, 10**13)
    norm = [50 + 50 * 10**9 * int(x) // 10**13 for x in lengths]
    assert got.tolist() == [1500 * (2 * 10**9 // (2000 + 20 * norm[0])), 900 * (7 * 10**9 // (7000 + 20 * norm[1]))]
