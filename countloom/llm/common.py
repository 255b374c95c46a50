"""Helpers shared by the training-data operators: tables, shared storage, worker caches, words."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import countloom.llm as _package

# Workers get these functions by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(_package)

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB, so that two of them fit a Python worker however long the texts are.

    All operators set the same value, and only where the session has Spark's own, so it never matters which ran last.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("67108864b", "64m"):
        spark.conf.set(key, "4m")


def as_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Null texts count as empty."""
    bounded_batches(df.sparkSession)
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    A temporary folder stands in only on a local master, where driver and executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="countloom-")
        atexit.register(shutil.rmtree, own, True)
        context.setCheckpointDir(f"file://{own}")
    return context._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  at the end the session may have ended first
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends at the latest."""
    path = f"{shared_dir(spark)}/countloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, name: str, codec: str = "uncompressed") -> DataFrame:
    """df written once as a table in the shared folder and read back: it cuts the lineage, and lost executors cost no recomputation.

    It is not compressed unless a codec is named: codecs hold buffers beside the heap for every column of every task, and the reader of LZ4 without frames has failed on sound files.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what stored() wrote, once everything that reads it is stored itself."""
    for df in tables:
        _remove(df.sparkSession, df._stored_at)


def worker_cache(name: str, make):
    """One object per Python worker, kept between tasks."""
    kept = sys.__dict__.setdefault("_countloom_cache", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


# ---------------------------------------------------------------- words of many texts at once

_ODD = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_tables():
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[0x20, 9, 10, 11, 12, 13]] = True
    weight = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)
    other = np.arange(256) < 128  # all but digits, letters and what is not ASCII
    for first, end in ((48, 58), (65, 91), (97, 123)):
        other[first:end] = False
    return lower, {"words": space, "terms": other}, weight


def _powers(n: int) -> np.ndarray:
    size = 1 << max(16, int(n - 1).bit_length())

    def make() -> np.ndarray:
        out = np.full(size, _ODD, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return worker_cache(f"powers-{size}", make)


def _inverse_powers(n: int) -> np.ndarray:
    size = 1 << max(16, int(n - 1).bit_length())

    def make() -> np.ndarray:
        out = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return worker_cache(f"inverse-{size}", make)


def word_places(data: np.ndarray, offsets: np.ndarray, kind: str = "words"):
    """(first byte, end byte, document) of every word of a batch of UTF-8 texts laid end to end.

    Words end at 0x20 and 0x09-0x0D, terms at every ASCII character but digits and letters.
    """
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    blank = worker_cache("bytes", _byte_tables)[1][kind][data]
    # a document border also ends a word
    first = ~blank
    first[1:] &= blank[:-1]
    starts = offsets[:-1][offsets[:-1] < n]
    starts = starts[offsets[1:][: len(starts)] > starts] if len(starts) else starts
    first[starts] |= ~blank[starts]
    ends = ~blank
    ends[:-1] &= blank[1:]
    last = starts[starts > 0] - 1
    ends[last] |= ~blank[last]
    begin, end = np.flatnonzero(first), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def batch_words(data: np.ndarray, offsets: np.ndarray, kind: str = "words"):
    """Words or terms of a batch of UTF-8 texts laid end to end, A-Z lower-cased.

    Returns (hash of each word, document of each word, first byte, end byte).  A word's hash is the
    mixed polynomial of its bytes, taken from prefix sums, so the cost is a few passes over the bytes.
    """
    lower, _, weight = worker_cache("bytes", _byte_tables)
    n = len(data)
    begin, end, doc = word_places(data, offsets, kind)
    if n == 0:
        return doc.astype(np.uint64), doc, begin, end
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(weight[lower[data]] * _powers(n)[:n], out=prefix[1:])
    words = mix64((prefix[end] - prefix[begin]) * _inverse_powers(n)[begin] + (end - begin).astype(np.uint64))
    return words, doc, begin, end


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return worker_cache("bytes", _byte_tables)[0][data]


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int):
    """Distinct k-word shingles of every document: (hashes sorted within a document, bounds of the documents).

    A document of fewer than k words has its whole sequence as the one shingle; one without words has none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)])
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    rolled = words.copy()
    n = len(words)
    for i in range(1, k):
        following = np.zeros(n, np.uint64)
        following[: max(0, n - i)] = words[i:]
        rolled = rolled * multiplier + following
    rolled = mix64(rolled)
    valid = np.arange(n) + k <= first[doc + 1]
    hashes, of = rolled[valid], doc[valid]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = []
        for d in short:
            value = int(counts[d])
            for w in words[first[d] : first[d + 1]]:
                value = (value * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF
            extra.append(value)
        hashes = np.concatenate([hashes, mix64(np.array(extra, np.uint64))])
        of = np.concatenate([of, short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        hashes, of = hashes[new], of[new]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n_docs))])
    return hashes, bounds


def slices(batches, place: int, most: int = 1 << 18):
    """The batches cut so that the texts of a piece hold about `most` bytes; a longer text is a piece of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(place)), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_buffer(column):
    """(bytes, offsets) of an Arrow string column without nulls."""
    import pyarrow as pa

    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if at[0] == at[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
