"""Quality by weak labels: expectation-maximisation weighs heuristic labellers, their posteriors train a hashed linear scorer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import as_text, batch_words, bounded_batches, mix64, slices, table, text_buffer, worker_cache

#: Documents that train the scorer, at most: those of the smallest hash of the id.  All documents count in the EM.
TRAINING = 8000
DIMENSIONS = 1 << 16
#: A document is kept where its score is at least this.
LEAST = 0.5
GOOD, BAD, NONE = 1, 0, 2

_STATS = 9


def document_stats(data: np.ndarray, offsets: np.ndarray):
    """(words, statistics of every document): one row a document, the columns that the labellers read."""
    words, doc, begin, end = batch_words(data, offsets)
    n_docs = len(offsets) - 1

    def classes() -> np.ndarray:
        out = np.zeros(256, np.uint8)  # 1 upper case, 2 lower case, 4 odd symbol, 8 digit, 16 sentence end
        out[65:91] = 1
        out[97:123] = 2
        out[[ord(c) for c in "|*#%&$~^<>{}[]\\!"]] = 4
        out[48:58] = 8
        out[[ord(c) for c in ".?"]] = 16
        return out

    kinds = worker_cache("classes", classes)[data]

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    n = np.bincount(doc, minlength=n_docs).astype(float)
    some = np.maximum(n, 1)
    length = end - begin
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    by_doc = lambda mask: np.bincount(doc[mask], minlength=n_docs)
    order = np.lexsort((words, doc))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    pairs = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    of = doc[:-1][doc[1:] == doc[:-1]]
    pairs = pairs[doc[1:] == doc[:-1]]
    order2 = np.lexsort((pairs, of))
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[order2][1:] != pairs[order2][:-1]) | (of[order2][1:] != of[order2][:-1])
    letters = per_doc(kinds & 3 > 0)
    stats = np.stack([
        by_doc(same) / some,
        per_doc(kinds == 4) / some,
        per_doc(kinds == 1) / np.maximum(letters, 1),
        by_doc((length <= 3) & ((kinds[begin] & 3 > 0) | (data[begin] > 127))) / some,
        np.bincount(doc[order][new], minlength=n_docs) / some,
        per_doc(kinds == 16) / some,
        np.bincount(doc, weights=length, minlength=n_docs) / some,
        per_doc(kinds == 8) / np.maximum(np.diff(offsets), 1),
        np.bincount(of[order2][fresh], minlength=n_docs) / np.maximum(n - 1, 1),
    ], axis=1)
    return n, stats, words, doc


def votes(n: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """What every labeller says of every document: GOOD, BAD or NONE.  Blank documents are BAD to all."""

    def between(value, bad, good):
        low = good > bad
        out = np.full(len(value), NONE)
        out[value >= good if low else value <= good] = GOOD
        out[value <= bad if low else value >= bad] = BAD
        return out

    repeat, symbols, upper, short, distinct, ends, length, digits, pairs = stats.T
    long = n >= 20
    said = np.stack([
        between(repeat, 0.15, 0.05),
        between(symbols, 0.15, 0.05),
        between(upper, 0.35, 0.2),
        np.where(long, between(short, 0.06, 0.15), NONE),
        np.where(long & (n < 2000), between(distinct, 0.3, 0.45), NONE),
        np.where(long, between(ends, 0.005, 0.03), NONE),
        np.where(long, between(np.abs(length - 5.5), 6.0, 3.5), NONE),
        np.where(long, between(digits, 0.3, 0.1), NONE),
        np.where(long, between(pairs, 0.6, 0.8), NONE),
    ], axis=1)
    said[n == 0] = BAD
    return said


def pattern_of(said: np.ndarray) -> np.ndarray:
    return said @ (3 ** np.arange(said.shape[1]))


def expectation_maximisation(counts: dict[int, int], labellers: int = _STATS, rounds: int = 200):
    """Posterior of good for every pattern of votes, from how often each pattern occurs.

    Every labeller has a chance of each vote for good and for bad documents; the counts have at most
    3 ** labellers rows whatever the corpus.  Returns (posterior by pattern, prior, chances[class, labeller, vote]).
    """
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    said = patterns[:, None] // 3 ** np.arange(labellers) % 3
    prior = 0.8
    chances = np.empty((2, labellers, 3))
    # junk is of several kinds, so a labeller objects to a part of it only, and hardly ever to a good document
    chances[1] = [0.005, 0.995, 1.0]
    chances[0] = [0.25, 0.75, 1.0]
    post = np.full(len(patterns), prior)
    columns = np.arange(labellers)
    for _ in range(rounds):
        # a labeller that abstains says nothing
        logs = np.where(said == NONE, 0.0, np.log(chances)[:, columns, said]).sum(axis=2) if len(patterns) else np.zeros((2, 0))
        gap = np.clip(logs[1] + np.log(prior) - logs[0] - np.log(1 - prior), -500, 500)
        after = 1 / (1 + np.exp(-gap))
        done = len(after) == 0 or np.abs(after - post).max() < 1e-9
        post = after
        if done:
            break
        good, bad = weight * post, weight * (1 - post)
        prior = np.clip((good.sum() + 8) / (weight.sum() + 10), 1e-3, 1 - 1e-3)
        for vote in (GOOD, BAD):
            hit, spoke = said == vote, said != NONE
            chances[1, :, vote] = (good @ hit + (0.05, 9.95)[vote]) / (good @ spoke + 10)
            chances[0, :, vote] = (bad @ hit + (2.5, 7.5)[vote]) / (bad @ spoke + 10)
    return dict(zip(patterns.tolist(), post.tolist())), float(prior), chances


def shape_features(stats: np.ndarray) -> np.ndarray:
    """Hashed places of a document's statistics, each cut into a few ranges."""
    steps = np.array([20, 8, 12, 12, 10, 40, 1, 12, 10])
    cells = np.minimum((stats * steps).astype(np.int64), 15)
    return (cells + 16 * np.arange(stats.shape[1])) * 40503 % 4093 + (DIMENSIONS - 4096)


class Scorer:
    """Logistic scorer of hashed words (their mean weight) and of shape features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def __call__(self, n, stats, words, doc) -> np.ndarray:
        place = (words % np.uint64(DIMENSIONS - 4096)).astype(np.int64)
        mean = np.bincount(doc, weights=self.weights[place], minlength=len(n)) / np.maximum(n, 1)
        value = 1 / (1 + np.exp(-np.clip(mean + self.weights[shape_features(stats)].sum(axis=1) + self.bias, -50, 50)))
        return np.where(n > 0, value, 0.0)


def train(samples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-5) -> Scorer:
    """samples: hashed words with their counts (rows of two), shape features, posterior of good."""
    weights, squares, bias = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1.0), 0.0
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(samples)):
            words, shape, wanted = samples[i]
            words, count = words[:, 0], words[:, 1]
            share = count / max(1, count.sum())
            value = (weights[words] * share).sum() + weights[shape].sum() + bias
            error = 1 / (1 + np.exp(-np.clip(value, -50, 50))) - wanted
            for place, scale in ((words, share), (shape, 1.0)):
                step = error * scale + decay * weights[place]
                squares[place] += step**2
                weights[place] -= rate * step / np.sqrt(squares[place])
            bias -= 0.05 * error
    return Scorer(weights, bias)


def _texts(docs: DataFrame, id_column: str) -> DataFrame:
    return as_text(docs.select(F.col(id_column).cast("long").alias("id"), "text"))


def fit(docs: DataFrame, id_column: str = "doc_id") -> tuple[Scorer, dict[int, float]]:
    """The scorer and the posteriors by pattern of votes.  No label is read.

    All documents count in the votes; the scorer trains on about TRAINING of them, without labels.  Null and empty texts are bad to
    all labellers; repeated rows count as often as they stand in the votes and once in training; an empty table gives a scorer that keeps nothing
    but is never asked; other columns are ignored.
    """
    spark = docs.sparkSession
    source = _texts(docs, id_column)

    def patterns(batches):
        import pyarrow as pa

        counts: dict[int, int] = {}
        for batch in slices(batches, 0):
            n, stats, _, _ = document_stats(*text_buffer(batch.column(0)))
            for p, c in zip(*np.unique(pattern_of(votes(n, stats)), return_counts=True)):
                counts[int(p)] = counts.get(int(p), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["p", "n"])

    found = source.select("text").mapInArrow(patterns, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    posterior, _, _ = expectation_maximisation({r["p"]: r["n"] for r in found})
    total = sum(r["n"] for r in found)
    # a share of the hashes that TRAINING documents fill
    bound = int(-(1 << 63) + (1 << 64) * min(1.0, TRAINING / max(1, total))) if total > TRAINING else (1 << 63) - 1

    def features(batches):
        import pyarrow as pa

        for batch in slices(batches, 0):
            n, stats, words, doc = document_stats(*text_buffer(batch.column(0)))
            # places with their counts, so that a text has at most DIMENSIONS of them however long it is
            code, held = np.unique(doc * np.int64(DIMENSIONS) + (words % np.uint64(DIMENSIONS - 4096)).astype(np.int64), return_counts=True)
            place = np.stack([code % DIMENSIONS, held], axis=1).astype(np.int32)
            cuts = np.searchsorted(code // DIMENSIONS, np.arange(len(n) + 1))
            shape = shape_features(stats).astype(np.int32)
            said = pattern_of(votes(n, stats))
            yield pa.RecordBatch.from_arrays(
                [pa.array([place[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([s.tobytes() for s in shape], pa.binary()), pa.array(said)],
                ["words", "shape", "p"])

    # hashes are dealt evenly, so the rows are about TRAINING; repeats count once, and the limit in their order makes it a bound
    chosen = source.withColumn("h", F.xxhash64(F.lit("quality"), "id", "text")).filter(F.col("h") <= bound).dropDuplicates(["h"]).orderBy("h").limit(2 * TRAINING)
    rows = chosen.select("text").mapInArrow(features, "words binary, shape binary, p long").collect()
    samples = sorted((bytes(r["words"]), bytes(r["shape"]), posterior[r["p"]]) for r in rows)
    scorer = train([(np.frombuffer(w, np.int32).reshape(-1, 2), np.frombuffer(s, np.int32), y) for w, s, y in samples])
    return scorer, posterior


def score_documents(docs: DataFrame, scorer: Scorer, posterior: dict[int, float], id_column: str = "doc_id") -> DataFrame:
    """Per row: id, score (0 for null, empty and blank texts), posterior of the weak labels, kept."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            n, stats, words, doc = document_stats(*text_buffer(batch.column(1)))
            score = scorer(n, stats, words, doc)
            weak = [posterior.get(p, 0.5) for p in pattern_of(votes(n, stats)).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(weak, pa.float64())], ["id", "score", "posterior"])

    out = _texts(docs, id_column).mapInArrow(run, "id long, score double, posterior double")
    return out.withColumnRenamed("id", id_column).withColumn("kept", F.col("score") >= LEAST)


def kept_documents(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of docs, whole and with all their columns, that the classifier keeps: blank, empty and null texts go, repeated rows share their fate."""
    scorer, _ = fit(docs, id_column)
    bounded_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, place):
            column = batch.column(place)
            filled = column.fill_null("") if column.null_count else column
            yield batch.filter(pa.array(scorer(*document_stats(*text_buffer(filled))) >= LEAST))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and fate of every document; repeated rows, nulls and empty texts as score_documents and fit state."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, *fit(docs))
