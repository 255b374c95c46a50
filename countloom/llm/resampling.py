"""Target-distribution importance resampling by an external sort-count of hashed word runs."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.llm.common import as_text, discard, lowered, slices, stored, table, text_buffer, word_places, worker_cache

#: Buckets of the production query; a stream holds 16-bit numbers, so 65,536 at most.
BUCKETS = 10_000
#: Documents need so many words to be drawn, and so many of 100 are drawn.
LEAST_WORDS, PERCENT = 20, 25
SALT = 7
#: Words of more bytes are hashed one by one.
_LONG = 64
_ONES = np.uint32(0xFFFFFFFF)


# ---------------------------------------------------------------- checksums of many words at once

def _tables():
    """The byte table of CRC-32, and for every length up to _LONG what so many zero bytes make of a checksum, byte by byte."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    shift = np.zeros((_LONG + 1, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_LONG):
        shift[n + 1] = byte[shift[n] & 255] ^ (shift[n] >> 8)
    return byte, shift


def word_checksums(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every word data[begin:end]."""
    byte, _ = worker_cache("crc", _tables)
    length = end - begin
    order = np.argsort(-length, kind="stable")
    at, ordered = begin[order], length[order]
    state = np.full(len(begin), _ONES)
    n_long = int(np.searchsorted(-ordered, -_LONG, side="left"))  # words longer than _LONG stand first
    for place in range(int(ordered[n_long]) if n_long < len(ordered) else 0):
        to = int(np.searchsorted(-ordered, -place, side="left"))
        part = state[n_long:to]
        state[n_long:to] = byte[(part ^ data[at[n_long:to] + place]) & 255] ^ (part >> 8)
    out = np.empty(len(begin), np.uint32)
    out[order] = state ^ _ONES
    for k in order[:n_long]:
        out[k] = zlib.crc32(data[begin[k] : end[k]].tobytes())
    return out


def followed_by(first: np.ndarray, second: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of "a b" from those of a and b; data[begin:end] is b.  A checksum is linear: that of a is carried over the bytes of b."""
    byte, shift = worker_cache("crc", _tables)
    state = first ^ _ONES
    state = byte[(state ^ np.uint32(32)) & 255] ^ (state >> 8) ^ _ONES
    length = np.minimum(end - begin, _LONG)
    out = second.copy()
    for k in range(4):
        out ^= shift[length, k, (state >> np.uint32(8 * k)) & 255]
    for k in np.flatnonzero(end - begin > _LONG):
        out[k] = zlib.crc32(data[begin[k] : end[k]].tobytes(), int(state[k]))
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """(words of every document, buckets of its features, their offsets): of each word its own bucket and that of it with the next one."""
    n_docs = len(offsets) - 1
    data = lowered(data)
    begin, end, doc = word_places(data, offsets, "terms")
    words = np.bincount(doc, minlength=n_docs).astype(np.int64)
    places = np.concatenate([[0], np.cumsum(np.maximum(2 * words - 1, 0))])
    if len(begin) == 0:
        return words, np.zeros(0, np.uint16), places
    single = word_checksums(data, begin, end)
    both = np.zeros((len(begin), 2), np.uint16)
    both[:, 0] = single % np.uint32(buckets)
    both[:-1, 1] = followed_by(single[:-1], single[1:], data, begin[1:], end[1:]) % np.uint32(buckets)
    paired = np.ones((len(begin), 2), bool)
    paired[:-1, 1] = doc[1:] == doc[:-1]
    paired[-1, 1] = False
    return words, both[paired], places


# ---------------------------------------------------------------- streams, counts, weights

def bucket_streams(texts: DataFrame, key: str | None = "doc_id", column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Packed streams: a row holds the ids, numbers of words and feature offsets of some documents, and their buckets as 16-bit numbers.

    A row holds the whole texts of about 256 KB; a longer text is a row of its own.
    """

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, 1):
            words, stream, places = feature_buckets(*text_buffer(part.column(1)), buckets)
            lists = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [lists(part.column(0)), lists(pa.array(words)), lists(pa.array(places)), pa.array([stream.astype("<u2").tobytes()], pa.binary())],
                names=["ids", "words", "offsets", "stream"])

    whole = as_text(texts, column).select((F.col(key).cast("long") if key else F.lit(None).cast("long")).alias("id"), F.col(column).alias("t"))
    return whole.mapInArrow(run, "ids array<long>, words array<long>, offsets array<long>, stream binary")


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): each stream is sorted and its runs counted; a task adds them up, Spark adds up the tasks."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                run_sorted = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
                if len(run_sorted):
                    first = np.concatenate([[0], np.flatnonzero(run_sorted[1:] != run_sorted[:-1]) + 1])
                    total[run_sorted[first]] += np.diff(np.append(first, len(run_sorted)))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    return streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(here: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket, from its counts in the corpus and in the target, each with one added."""
    all_here, all_target = sum(here.values()), sum(target.values())
    gain = lambda s, t: math.floor(1000 * math.log(float((t + 1) * (all_here + buckets)) / float((s + 1) * (all_target + buckets))))
    return np.array([gain(here.get(b, 0), target.get(b, 0)) for b in range(buckets)], np.int64)


def noise(doc_id: int | None, salt: int) -> int:
    """A thousand times a Gumbel variate that depends on the id alone, floored.  A null id counts as an empty one."""
    h = int(hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def document_scores(streams: DataFrame, gains: np.ndarray, salt: int = SALT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): gains are gathered along a stream and summed between its offsets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(0)[k].values
                words, places = (np.asarray(batch.column(c)[k].values) for c in (1, 2))
                gathered = gains[np.frombuffer(batch.column(3)[k].as_buffer(), "<u2")]
                n = np.diff(places)
                some = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if len(some):
                    weight[some] = np.floor_divide(np.add.reduceat(gathered, places[:-1][some]), n[some])
                score = weight + np.array([noise(i, salt) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(n), pa.array(weight), pa.array(score)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return streams.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scores: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scores with the rank of the drawn rows: of those with enough words the given part with the highest scores, ties to smaller ids.

    Scores are whole numbers between bounds that the logarithms set (under 100,000 different ones), so their counts and
    running sum are one small table; only rows of one score are then ordered among themselves.
    """
    enough = F.col("n_words") >= least_words
    counted = scores.filter(enough).groupBy("score").count().withColumn("before", F.sum("count").over(W.orderBy(F.desc("score"))) - F.col("count"))
    drawn = counted.select(F.col("score").alias("at"), "before", F.floor(F.sum("count").over(W.partitionBy()) * percent / 100).alias("draws")).filter("before < draws")
    # a join on the score alone would also bring short documents; they have no place, nor have scores below the cut
    placed = scores.join(F.broadcast(drawn), (F.col("score") == F.col("at")) & enough, "left").drop("at")
    within = F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    first = placed.filter("before is not null").withColumn("rank", F.col("before") + within)
    first = first.withColumn("rank", F.when(F.col("rank") <= F.col("draws"), F.col("rank")).cast("long"))
    rest = placed.filter("before is null").withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).drop("before", "draws")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, salt: int = SALT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text); target has texts only.

    Features are runs of one and two words.  Null, empty and wordless texts have none, weight 0 and no rank; a row without
    an id counts and may be drawn, after others of its score; repeated rows are rows of their own with equal scores and
    ranks in a row; an empty target or corpus gives counts of 0; columns besides doc_id and text do not matter.
    """
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets: 1 to 65,536")
    streams = stored(bucket_streams(docs, "doc_id", "text", buckets), "streams")
    counts = lambda s: {r["bucket"]: r["n"] for r in bucket_counts(s, buckets).collect()}  # noqa: E731  at most `buckets` rows
    gains = bucket_gains(counts(streams), counts(bucket_streams(target, None, "text", buckets)), buckets)
    scores = stored(document_scores(streams, gains, salt), "scores")
    discard(streams)
    return ranked(scores, least_words, percent)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents drawn towards the texts of the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM crc WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
here AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM docs WHERE len(w) > 0),
goal AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM items WHERE len(w) > 0),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM here UNION SELECT f FROM goal)),
hashed AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h) // 2), lambda i: ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT)),
    lambda c, b: xor(tab[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket FROM hexed, tab),
hc AS (SELECT bucket, count(*) AS s FROM here JOIN hashed USING (f) GROUP BY 1),
gc AS (SELECT bucket, count(*) AS t FROM goal JOIN hashed USING (f) GROUP BY 1),
gains AS (SELECT b.bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM hc), 0) + {BUCKETS}) AS DOUBLE)
    / CAST((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM gc), 0) + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM range({BUCKETS}) b(bucket) LEFT JOIN hc USING (bucket) LEFT JOIN gc USING (bucket)),
weights AS (SELECT r, count(*) AS n, sum(gain) AS total FROM here JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
    CAST(coalesce(CASE WHEN total >= 0 OR total % n = 0 THEN total // n ELSE -((-total + n - 1) // n) END, 0) AS BIGINT) AS weight,
    list_reduce(list_concat([0::BIGINT], list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', sha256('{SALT}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[i]) - 1)::BIGINT)), lambda a, b: a * 16 + b) AS h
  FROM docs LEFT JOIN weights USING (r)),
final AS (SELECT doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (words >= {LEAST_WORDS}) OVER () AS n FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed"""
