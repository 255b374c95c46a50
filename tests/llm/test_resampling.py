"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from countloom.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [w.encode() for w in words] + [f"{a} {b}".encode() for a, b in zip(words, words[1:])]


def plain(docs, goal, buckets, least, percent, salt):
    """Every row's (doc_id, n_words, n_features, weight, score, rank), one by one; docs: (doc_id, text)."""
    here, there = Counter(), Counter()
    for _, t in docs:
        here.update(zlib.crc32(f) % buckets for f in features(t)[1])
    for t in goal:
        there.update(zlib.crc32(f) % buckets for f in features(t)[1])
    s_all, t_all = sum(here.values()), sum(there.values())
    gain = lambda b: math.floor(1000 * math.log((there[b] + 1) * (s_all + buckets) / ((here[b] + 1) * (t_all + buckets))))
    rows = []
    for i, t in docs:
        words, runs = features(t)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((tuple(r) + (place.get(id(r)),) for r in rows), key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def test_checksums_of_words_and_pairs():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (1, 2, 3, 9, 63, 64, 65, 66, 500, 7, 1)]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    begin = end - [len(w) for w in words]
    single = resampling.word_checksums(data, begin, end)
    assert [int(x) for x in single] == [zlib.crc32(w) for w in words]
    both = resampling.followed_by(single[:-1], single[1:], data, begin[1:], end[1:])
    assert [int(x) for x in both] == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]
    assert len(resampling.word_checksums(data, begin[:0], end[:0])) == 0


def test_streams_hold_all_features(spark):
    docs = [(1, "One two, THREE-four"), (2, ""), (3, None), (4, "é1 漢字 " + "x" * 300)]
    for row in resampling.bucket_streams(spark.createDataFrame(docs, "doc_id long, text string"), buckets=50_000).collect():
        stream = np.frombuffer(row["stream"], "<u2")
        for k, i in enumerate(row["ids"]):
            wanted = sorted(zlib.crc32(f) % 50_000 for f in features(dict(docs)[i])[1])
            assert sorted(stream[row["offsets"][k] : row["offsets"][k + 1]].tolist()) == wanted


@pytest.mark.parametrize("seed,buckets,least,percent", [(1, 97, 3, 25), (2, 65_536, 1, 100), (3, 1, 0, 50)])
def test_rows_equal_plain_ones(spark, seed, buckets, least, percent):
    rng = random.Random(seed)
    pool = ["a", "B", "the", "é", "漢字", "x9", "Zz"]
    text = lambda: "".join(rng.choice(pool) + rng.choice([" ", "-", "", "\x00", ". "]) for _ in range(rng.randrange(30)))
    docs = [(i, text()) for i in range(60)] + [(105, "the the the"), (105, "the the the"), (None, "a b c d e"), (70, None), (71, ""), (72, "word " * 40_000)]
    goal = [text() for _ in range(10)] + [None, ""]
    got = resampling.resample(
        spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(5), spark.createDataFrame([(t,) for t in goal], "text string"), buckets, least, percent)
    assert rows_of(got) == plain(docs, goal, buckets, least, percent, resampling.SALT)


def test_edge_cases(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([("alpha3 beta4",), (None,)], "text string")
    got = rows_of(resampling.resample(edge_docs, bench))
    assert got == plain([(r["doc_id"], r["text"]) for r in edge_docs.collect()], ["alpha3 beta4", None], resampling.BUCKETS, 20, 25, 7)
    assert resampling.resample(no_docs, bench).count() == 0
    assert rows_of(resampling.resample(edge_docs, bench.filter("false"))) == plain([(r["doc_id"], r["text"]) for r in edge_docs.collect()], [], resampling.BUCKETS, 20, 25, 7)
    with pytest.raises(ValueError):
        resampling.resample(edge_docs, bench, buckets=70_000)
