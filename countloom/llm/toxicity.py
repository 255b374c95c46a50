"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import as_text, slices, stored, table, text_buffer, worker_cache

#: Labelled documents of each class that train the model, at most about; words that do, at most.
TRAINING, TOXIC_WORDS, CLEAN_WORDS, LANDMARKS = 8000, 600, 12000, 160
THRESHOLD = 0.7
#: A letter takes one of 64 codes; a subsequence of three letters may skip up to two letters in all.
CODES, DECAY = 64, 0.7
GAPS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
SHARES = [DECAY ** (d - 2) for _, d in GAPS]
BEST = 2


def _codes() -> np.ndarray:
    """Letter codes of bytes: a-z without case, bytes of other letters by their low bits, -1 for blanks, 0 for what is skipped."""
    out = np.zeros(256, np.int8)
    for i in range(26):
        out[65 + i] = out[97 + i] = i + 1
    out[0x80:0xC0] = 27 + np.arange(64) % 36
    # a lead byte says less than what follows it and is skipped, so that accents cost one letter
    out[[0x20, 9, 10, 11, 12, 13]] = -1
    for digit, letter in zip("0134578", "oieastb"):
        out[ord(digit)] = out[ord(letter)]
    out[ord("@")], out[ord("$")] = 1, 19
    return out


def letters(data: np.ndarray, offsets: np.ndarray):
    """Letters of all texts with word and document: marks inside words are skipped, spelled-out letters become one word."""
    code = worker_cache("letters", _codes)[data] if len(data) else np.zeros(0, np.int8)
    blank = code < 0
    starts = offsets[:-1]
    border = np.zeros(len(data) + 1, bool)
    border[starts] = True
    border[:-1] |= blank
    word = np.cumsum(border[:-1])
    use = code > 0
    code, word = code[use].astype(np.int64), word[use]
    doc = np.searchsorted(offsets, np.flatnonzero(use), side="right") - 1
    if not len(word):
        return code, word, doc, np.zeros(0, np.int64)
    first = np.concatenate([[True], word[1:] != word[:-1]])
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, len(word)))
    owner = doc[head]
    joined = np.zeros(len(head), bool)
    joined[1:] = (size[1:] == 1) & (size[:-1] == 1) & (owner[1:] == owner[:-1])
    number = np.cumsum(~joined) - 1
    word = np.repeat(number, size)
    return code, word, doc, owner[~joined]


def subsequences(code: np.ndarray, word: np.ndarray):
    """For every gap pattern: (place of the subsequence in the feature space, its word)."""
    for (j, k), share in zip(GAPS, SHARES):
        if len(code) <= k:
            continue
        inside = word[:-k] == word[k:]
        middle = code[j : len(code) - k + j]
        yield (code[:-k] * CODES + middle)[inside] * CODES + code[k:][inside], word[:-k][inside], share


def decisions(code: np.ndarray, word: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    """Decision of every word: its normalised kernel with the support vectors, as one sum over its own subsequences."""
    total, norm = np.zeros(n), np.zeros(n)
    for place, of, share in subsequences(code, word):
        total += np.bincount(of, weights=weights[place] * share, minlength=n)
        norm += np.bincount(of, minlength=n) * share**2
    return total / np.sqrt(np.maximum(norm, 1e-12)) + bias


def best_of(value: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """The BEST largest decisions of each document, cut to -1 to 1, largest first; -1 where it has fewer words."""
    out = np.full((n_docs, BEST), -1.0)
    order = np.lexsort((-value, owner))
    owner, value = owner[order], value[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = place < BEST
    out[owner[keep], place[keep]] = np.clip(value[keep], -1.0, 1.0)
    return out


def word_features(words: list[str]):
    """(place, word, value) of every subsequence of the words, normalised as decisions() does; places may repeat within a word."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    sizes = [len(w.encode()) + 1 for w in words]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    offsets[-1] = len(data)
    code, word, _, owner = letters(data, offsets)
    found = [(place, owner[of], np.full(len(place), share)) for place, of, share in subsequences(code, word)]
    place, of, value = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    norm = np.sqrt(np.bincount(of, weights=value**2, minlength=len(words)))
    return place, of, value / np.maximum(norm[of], 1e-6)


class Landmarks:
    """Kernel of words with a fixed list of landmark words; only the landmarks' own subsequences are kept."""

    def __init__(self, words: list[str]):
        place, of, value = word_features(words)
        self.places, where = np.unique(place, return_inverse=True)
        self.table = np.zeros((len(self.places), len(words)))
        np.add.at(self.table, (where, of), value)

    def kernel(self, words: list[str], step: int = 400) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]))
        for at in range(0, len(words), step):
            place, of, value = word_features(words[at : at + step])
            where = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
            use = self.places[where] == place
            np.add.at(out, at + of[use], self.table[where[use]] * value[use, None])
        return out

    def weights(self, by_landmark: np.ndarray) -> np.ndarray:
        out = np.zeros(CODES**3)
        out[self.places] = self.table @ by_landmark
        return out


class Model:
    """weights over subsequences, bias, and the logistic map from a document's best decisions to its score."""

    def __init__(self, weights, bias, slope, offset):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def best(self, data, offsets) -> np.ndarray:
        code, word, _, owner = letters(data, offsets)
        return best_of(decisions(code, word, len(owner), self.weights, self.bias), owner, len(offsets) - 1)

    def score(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(best @ self.slope + self.offset, -50, 50)))


def support_vectors(positive: list[tuple[str, float]], negative: list[tuple[str, float]], rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine on Nystroem features of words; returned as one weight for every subsequence.

    The landmarks are the heaviest toxic words and the clean words that most look like them; features are
    kernel values against the landmarks, whitened by the inverse root of the landmarks' own kernel.
    """
    if not positive:
        return np.zeros(CODES**3), -1.0
    toxic = [w for w, _ in positive]
    marks = toxic[: LANDMARKS // 2]
    near = Landmarks(marks).kernel([w for w, _ in negative]).max(axis=1) if negative else []
    order = sorted(range(len(negative)), key=lambda i: (-near[i], negative[i][0]))
    marks = marks + [negative[i][0] for i in order[: LANDMARKS - len(marks)]]
    landmarks = Landmarks(marks)
    values, vectors = np.linalg.eigh(landmarks.kernel(marks))
    root = vectors @ np.diag(np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0)) @ vectors.T
    words = positive + negative
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    share = np.array([w for _, w in words])
    share[y > 0] *= 0.5 / share[y > 0].sum()
    if len(negative):
        share[y < 0] *= 0.5 / share[y < 0].sum()
    z = landmarks.kernel([w for w, _ in words]) @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    # squared hinge by Newton steps: convex and smooth enough for a full solve over the landmarks
    v = np.zeros(z.shape[1])
    ridge = np.diag(np.append(np.full(z.shape[1] - 1, 1e-4), 1e-6))
    for _ in range(rounds):
        inside = y * (z @ v) < 1
        a = z[inside] * share[inside, None]
        after = np.linalg.solve(a.T @ z[inside] + ridge, a.T @ y[inside])
        if np.abs(after - v).max() < 1e-9:
            break
        v = 0.5 * v + 0.5 * after
    return landmarks.weights(root @ v[:-1]), float(v[-1])


def _held_out(column):
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> Model:
    """Learns from labelled rows outside the held-out third: crc32 of the id as text, modulo 3, is not 1.

    At most about TRAINING documents of each label, those of the smallest hashes, give their words; a word is toxic where far more
    toxic than clean documents have it than chance allows.  Labels or ids that are null are left out, a document with several labels is toxic
    if one says so, repeated ids train with each of their texts; without toxic rows every document gets the same low score.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_column).isNotNull() & ~_held_out(F.col(id_column)))
    known = known.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Model(np.zeros(CODES**3), -1.0, np.zeros(BEST), -3.0)
    spot = F.pmod(F.xxhash64(F.lit("toxic"), "id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, TRAINING / n_toxic)).otherwise(min(1.0, TRAINING / max(1, n_clean)))
    # about 2 * TRAINING rows of two numbers whatever the corpus; the limit makes it a bound
    chosen = known.filter(spot < share).orderBy(F.xxhash64(F.lit("toxic"), "id"), "id").limit(3 * TRAINING)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), "text")
    rows = as_text(rows.join(F.broadcast(chosen), "id"))

    def words(batches):
        import re

        import pyarrow as pa

        split = re.compile(r"[^\W\d_]{3,24}")
        toxic: dict[str, int] = {}
        clean: dict[str, int] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = toxic if label else clean
                for w in set(split.findall(text.lower())):
                    counts[w] = counts.get(w, 0) + 1
        both = list(set(toxic) | set(clean))
        for at in range(0, len(both), 10000):
            part = both[at : at + 10000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([toxic.get(w, 0) for w in part], pa.int64()), pa.array([clean.get(w, 0) for w in part], pa.int64())], ["w", "t", "c"])

    counted = rows.select("toxic", "text").mapInArrow(words, "w string, t long, c long").groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t_all, c_all = min(n_toxic, TRAINING), max(1, min(n_clean, TRAINING))
    base = t_all / (t_all + c_all)
    seen = F.col("t") + F.col("c")
    purity = (F.col("t") / t_all) / (F.col("t") / t_all + F.col("c") / c_all)
    # how surprising so many toxic documents are: the binomial large-deviation rate in nats
    rate = F.col("t") / seen
    surprise = seen * (rate * F.log(rate / base) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    counted = stored(counted, "words")
    certain = 10.0 if t_all >= 30 else 4.0
    strong = counted.filter((F.col("t") >= 2) & (purity >= 0.85)).withColumn("s", surprise).filter(F.col("s") >= certain)
    positive = [(r["w"], float(r["s"])) for r in strong.orderBy(F.desc("s"), "w").limit(TOXIC_WORDS).collect()]
    fair = counted.filter((F.col("c") > 0) & (purity < 0.6))
    common = fair.orderBy(F.desc("c"), "w").limit(CLEAN_WORDS // 2)
    other = fair.orderBy(F.xxhash64("w"), "w").limit(CLEAN_WORDS // 2)
    negative = sorted({(r["w"], 1.0) for r in common.union(other).select("w").collect()})
    weights, bias = support_vectors(positive, negative)
    machine = Model(weights, bias, np.zeros(BEST), 0.0)

    def scored(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            best = machine.best(*text_buffer(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0)), *(pa.array(b) for b in best.T)], ["toxic", *(f"b{i}" for i in range(BEST))])

    schema = "toxic int, " + ", ".join(f"b{i} double" for i in range(BEST))
    found = rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(scored, schema).collect()
    found = sorted(tuple(r) for r in found)
    machine.slope, machine.offset = calibrated(np.array([r[1:] for r in found]), np.array([r[0] for r in found], float), n_toxic / (n_toxic + n_clean))
    return machine


def calibrated(best: np.ndarray, y: np.ndarray, prior: float, rounds: int = 50):
    """Logistic regression of the label on the best decisions, weighed back to the labels' own shares; rising in each."""
    x = np.hstack([best, np.ones((len(best), 1))])
    weight = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    v = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * best.shape[1] + [1e-6]) * len(x) * 1e-2
    active = np.ones(x.shape[1], bool)
    for _ in range(4):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ v, -50, 50)))
            slope = x.T @ (weight * (y - p)) - ridge @ v
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
            step = np.zeros_like(v)
            step[active] = np.linalg.solve(hess[np.ix_(active, active)], slope[active])
            v += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        falling = (v[:-1] < 0) & active[:-1]
        if not falling.any():
            break
        active[:-1] &= ~falling
        v[:-1][falling] = 0
    return v[:-1], float(v[-1])


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, score from 0 to 1.  Null, empty and wordless texts get the score of a text without any likeness."""
    # 2 MB, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.offset))

    def run(batches):
        import pyarrow as pa

        model = Model(*shared.value)
        for batch in slices(batches, 1):
            score = model.score(model.best(*text_buffer(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    source = as_text(docs.select(F.col(id_column).cast("long").alias("id"), "text"))
    return source.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_column)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; null and empty texts get the score of a text without likeness, rows without an id are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
