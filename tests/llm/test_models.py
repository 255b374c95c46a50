"""Quality and toxicity against plain versions of their methods."""

import itertools
import math
import random

import numpy as np
import pytest

from countloom.llm import quality, toxicity


def plain_em(counts, labellers, rounds):
    """The same expectation-maximisation over single documents in plain Python, without patterns."""
    docs = [[p // 3**k % 3 for k in range(labellers)] for p, n in counts.items() for _ in range(n)]
    prior = 0.8
    chance = {1: [[0.005, 0.995] for _ in range(labellers)], 0: [[0.25, 0.75] for _ in range(labellers)]}
    post = None
    for _ in range(rounds):
        new = []
        for votes in docs:
            like = {c: (prior if c else 1 - prior) * math.prod(chance[c][k][v] for k, v in enumerate(votes) if v != quality.NONE) for c in (0, 1)}
            new.append(like[1] / (like[0] + like[1]))
        if post is not None and max(abs(a - b) for a, b in zip(post, new)) < 1e-9:
            post = new
            break
        post = new
        prior = min(max((sum(post) + 8) / (len(docs) + 10), 1e-3), 1 - 1e-3)
        for c, share, add in ((1, post, (0.05, 9.95)), (0, [1 - x for x in post], (2.5, 7.5))):
            for k in range(labellers):
                spoke = sum(w for w, v in zip(share, docs) if v[k] != quality.NONE)
                for vote in (0, 1):
                    chance[c][k][vote] = (sum(w for w, v in zip(share, docs) if v[k] == vote) + add[vote]) / (spoke + 10)
    out = {}
    for votes, x in zip(docs, post):
        out[sum(v * 3**k for k, v in enumerate(votes))] = x
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors_equal_those_of_single_documents(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(400):
        good = rng.random() < 0.8
        votes = [quality.NONE if rng.random() < 0.2 else int(rng.random() < (0.97 if good else 0.5)) for _ in range(4)]
        p = sum(v * 3**k for k, v in enumerate(votes))
        counts[p] = counts.get(p, 0) + 1
    got, _, _ = quality.expectation_maximisation(counts, 4, 60)
    wanted = plain_em(counts, 4, 60)
    assert set(got) == set(wanted) and all(abs(got[p] - wanted[p]) < 1e-6 for p in got)


def test_quality_query_scores_every_document_by_its_scorer(spark):
    """The query's rows against the scorer applied to each text alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scorer, posterior = quality.fit(docs)
    got = {r["doc_id"]: r for r in quality.score_documents(docs, scorer, posterior).collect()}
    for r in docs.collect():
        text = (r["text"] or "").encode()
        stats = quality.document_stats(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        wanted = float(scorer(*stats)[0])
        assert got[r["doc_id"]]["score"] == pytest.approx(wanted, abs=1e-9) and got[r["doc_id"]]["kept"] == (wanted >= quality.LEAST)


def plain_kernel(a: str, b: str) -> float:
    """Normalised kernel of three letters in order with up to two skipped: all index triples, one by one."""

    def features(w):
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i <= 4:
                u = w[i] + w[j] + w[k]
                out.setdefault(u, []).append(toxicity.DECAY ** (k - i - 2))
        return out

    x, y = features(a), features(b)
    product = sum(sum(x[u]) * sum(y[u]) for u in x if u in y)
    size = lambda f: math.sqrt(sum(v * v for vs in f.values() for v in vs))
    return product / (size(x) * size(y))


def test_kernel_equals_the_sum_over_all_subsequences():
    words = ["blockhead", "blxockhead", "scoundrel", "garden", "gardener", "abcabcabc", "window", "reading"]
    got = toxicity.Landmarks(words).kernel(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-9)


def test_folded_weights_give_the_machine_over_landmarks():
    """A word's decision by one weight per subsequence is the kernel machine's over its landmarks."""
    landmarks = toxicity.Landmarks(["blockhead", "scoundrel", "garden", "window"])
    by_landmark = np.array([1.0, 0.5, -0.7, -0.2])
    weights = landmarks.weights(by_landmark)
    for word in ("blockhead", "bl0ckhead", "gardens", "nothing"):
        data = np.frombuffer(word.encode(), np.uint8)
        code, of, _, owner = toxicity.letters(data, np.array([0, len(data)]))
        got = toxicity.decisions(code, of, len(owner), weights, 0.25)[0]
        assert got == pytest.approx(float(landmarks.kernel([word])[0] @ by_landmark) + 0.25, abs=1e-9)
