"""Ranked lexical search: WAND on shards of documents, heaps of shards merged."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.llm.common import as_text, batch_words, discard, slices, stored, table, text_buffer

TOP = 50
#: (item, term) pairs of a block of items; documents are read once a block.
PAIRS = 1 << 18
#: A shard is closed at so many documents or postings; its documents go through WAND in ranges of RANGE, side by side.
DOCUMENTS, POSTINGS, RANGE = 1 << 12, 1 << 19, 1 << 9
#: Rounds of pivots between two updates of the heaps.
ROUNDS = 8
_END = np.iinfo(np.int32).max


def item_terms(items: DataFrame, item: str, column: str = "text") -> DataFrame:
    """(item, text_hash, terms): hashes of the distinct terms of every item; rows equal in id and text are one item, without terms none."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, 2):
            words, doc, _, _ = batch_words(*text_buffer(part.column(2)), "terms")
            order = np.lexsort((words, doc))
            words, doc = words[order], doc[order]
            new = np.ones(len(words), bool)
            new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
            words, doc = words[new], doc[new]
            places = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(places), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), terms], names=["item", "text_hash", "terms"])

    whole = as_text(items, column).select(F.col(item).cast("long").alias("item"), F.sha2(column, 256).alias("text_hash"), F.col(column).alias("t")).dropDuplicates(["item", "text_hash"])
    return whole.mapInArrow(run, "item long, text_hash string, terms array<long>").filter(F.size("terms") > 0)


# ---------------------------------------------------------------- the index

def shards(docs: DataFrame, vocabulary: np.ndarray, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Shards: ids and lengths of their documents, and postings (document, frequency) of the terms of the sorted vocabulary of hashes.

    terms holds places in the vocabulary, starts where the postings of each begin.
    """

    def run(batches):
        import pyarrow as pa

        ids, lengths, found, held, size = [], [], [], 0, 0

        def shard():
            code, n = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            tf = np.bincount(n, weights=np.concatenate([t for _, t in found]), minlength=len(code)).astype(np.int64)
            term, doc = code >> 32, code & 0xFFFFFFFF
            first = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool)
            starts = np.append(np.flatnonzero(first), len(term))
            one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, kind))
            row = [pa.ListArray.from_arrays(pa.array([0, held], pa.int32()), pa.concat_arrays(ids)), one(np.concatenate(lengths), pa.int64()), one(term[first], pa.int32()),
                   one(starts, pa.int32()), one(doc, pa.int32()), one(tf, pa.int64())]
            return pa.RecordBatch.from_arrays(row, names=["ids", "lengths", "terms", "starts", "docs", "tfs"])

        for part in slices(batches, 1):
            words, doc, _, _ = batch_words(*text_buffer(part.column(1)), "terms")
            place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            hit = vocabulary[place] == words
            code, tf = np.unique((place[hit] << 32) + doc[hit] + held, return_counts=True)
            ids.append(part.column(0))
            lengths.append(np.bincount(doc, minlength=part.num_rows))
            found.append((code, tf))
            held, size = held + part.num_rows, size + len(code)
            if held >= DOCUMENTS or size >= POSTINGS:
                yield shard()
                ids, lengths, found, held, size = [], [], [], 0, 0
        if held:
            yield shard()

    whole = as_text(docs, column).select(F.col(key).cast("long").alias("id"), F.col(column).alias("t"))
    return whole.mapInArrow(run, "ids array<long>, lengths array<long>, terms array<int>, starts array<int>, docs array<int>, tfs array<long>")


def statistics(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, documents holding each term of the vocabulary): a row a term and task, summed by Spark."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, terms, starts = (np.asarray(batch.column(c)[k].values) for c in range(3))
                total[0] += np.count_nonzero(lengths)
                total[1] += lengths.sum()
                total[terms + 2] += np.diff(starts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["place", "n"])

    rows = index.select("lengths", "terms", "starts").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(n_terms + 2, np.int64)
    for r in rows:  # at most one a term of the block of items
        total[r["place"]] = r["n"]
    return int(total[0]), int(total[1]), total[2:]


def impacts(tf: np.ndarray, doc: np.ndarray, weight: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting adds to a score: whole numbers, divisions rounding down."""
    if int(lengths.max(initial=0)) * 50 * n_docs < 1 << 62:
        norm = 50 + (50 * n_docs * lengths) // n_terms
    else:
        norm = np.array([50 + 50 * n_docs * int(n) // n_terms for n in lengths], np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc]))


# ---------------------------------------------------------------- WAND

class Heaps:
    """The best `top` (score, id) of every item; equal scores by id, a missing one last."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]  # item, score, id, whether it is null
        self.least = np.ones(n_items, np.int64)
        self.pending: list = []

    def push(self, item, score, doc_id, null) -> None:
        self.pending.append((item, score, doc_id, null))

    def settle(self) -> None:
        """Takes in what was pushed.  The threshold of a full heap is its worst score: equal ones may still win by their id."""
        if not self.pending:
            return
        item, score, doc_id, null = (np.concatenate([a, *new]) for a, new in zip(self.rows, zip(*self.pending)))
        self.pending = []
        order = np.lexsort((doc_id, null, -score, item))
        item, score, doc_id, null = item[order], score[order], doc_id[order], null[order]
        first = np.searchsorted(item, item)
        keep = np.arange(len(item)) - first < self.top
        self.rows = [item[keep], score[keep], doc_id[keep], null[keep]]
        last = np.flatnonzero(np.arange(len(item)) - first == self.top - 1)
        self.least[item[last]] = score[last]


def wand(docs: np.ndarray, keys: np.ndarray, impact: np.ndarray, most: np.ndarray, slots: np.ndarray, items: np.ndarray, n_docs: int, heaps: Heaps, ids, null) -> int:
    """Runs the items (slots: their terms' places in the shard, -1 where absent) over one shard; returns the documents scored.

    docs, impact: the shard's postings by term and document; keys: term * n_docs + document, rising; most: the largest
    impact of each term.  A lane is an item and a range of documents.  In a round every lane sorts its cursors by
    document, takes as pivot the first document at which the largest impacts of the cursors up to it can reach the
    heap's threshold, moves the cursors before it there, and scores it if what stands on it can still reach the threshold.
    """
    begins = np.arange(0, n_docs, RANGE)
    lane_item = np.repeat(items, len(begins))
    slot = np.repeat(slots, len(begins), axis=0)
    low = np.tile(begins, len(items))[:, None]
    absent = slot < 0
    base = np.where(absent, 0, slot) * n_docs
    cursor = np.searchsorted(keys, base + low)
    end = np.searchsorted(keys, base + np.minimum(low + RANGE, n_docs))
    end[absent] = 0
    bound = np.where(absent, 0, most[np.where(absent, 0, slot)])
    padded = np.append(docs, _END)
    at = np.where(cursor < end, padded[np.minimum(cursor, len(docs))], _END)
    scored = rounds = 0
    while len(lane_item):
        order = np.argsort(at, axis=1)
        reach = np.cumsum(np.take_along_axis(bound, order, 1), axis=1)
        need = heaps.least[lane_item][:, None]
        can = reach >= need
        place = np.argmax(can, axis=1)
        lanes = np.arange(len(lane_item))
        pivot = at[lanes, order[lanes, place]]
        alive = can[lanes, place] & (pivot < _END)
        if not alive.all():
            lane_item, base, cursor, end, bound, at, pivot, need = (a[alive] for a in (lane_item, base, cursor, end, bound, at, pivot, need))
            if not len(lane_item):
                break
        row, col = np.nonzero(at < pivot[:, None])
        moved = np.searchsorted(keys, base[row, col] + pivot[row])
        cursor[row, col] = moved
        at[row, col] = np.where(moved < end[row, col], padded[moved], _END)
        on = at == pivot[:, None]
        hopeful = np.where(on, bound, 0).sum(axis=1) >= need[:, 0]
        row, col = np.nonzero(on)
        if hopeful.any():
            total = np.bincount(row, weights=impact[cursor[row, col]], minlength=len(pivot)).astype(np.int64) if impact.max(initial=0) * on.shape[1] < 1 << 52 else _whole_sums(row, impact[cursor[row, col]], len(pivot))
            good = hopeful & (total >= need[:, 0])
            scored += int(hopeful.sum())
            heaps.push(lane_item[good], total[good], ids[pivot[good]], null[pivot[good]])
        cursor[row, col] += 1
        at[row, col] = np.where(cursor[row, col] < end[row, col], padded[np.minimum(cursor[row, col], len(docs))], _END)
        rounds += 1
        if rounds % ROUNDS == 0:
            heaps.settle()
    heaps.settle()
    return scored


def _whole_sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, row, values)
    return out


def search_shards(index: DataFrame, terms_of: list[np.ndarray], names: list, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(number, item, doc_id, score): the heaps of all shards of a task, whose thresholds go on from shard to shard."""
    # items of about as many terms go together, so that little of a matrix is empty
    groups: dict[int, list[int]] = {}
    for number, terms in enumerate(terms_of):
        groups.setdefault(int(len(terms) - 1).bit_length(), []).append(number)
    matrices = []
    for members in groups.values():
        matrix = np.full((len(members), max(len(terms_of[m]) for m in members)), -1)
        for line, m in enumerate(members):
            matrix[line, : len(terms_of[m])] = terms_of[m]
        matrices.append((np.array(members), matrix))

    def run(batches):
        import pyarrow as pa

        heaps = Heaps(len(terms_of), top)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(0)[k].values
                lengths, terms, starts, docs, tfs = (np.asarray(batch.column(c)[k].values) for c in range(1, 6))
                if not len(docs):
                    continue
                null = np.asarray(ids.is_null())
                plain = np.asarray(ids.fill_null(0))
                term = np.repeat(np.arange(len(terms)), np.diff(starts))
                impact = impacts(tfs, docs, weights[terms][term], lengths, n_docs, n_terms)
                most = np.maximum.reduceat(impact, starts[:-1])
                keys = term * len(lengths) + docs
                for members, matrix in matrices:
                    place = np.minimum(np.searchsorted(terms, matrix), len(terms) - 1)
                    slots = np.where((terms[place] == matrix) & (matrix >= 0), place, -1)
                    some = (slots >= 0).any(axis=1)
                    wand(docs, keys, impact, most, slots[some], members[some], len(lengths), heaps, plain, null)
        number, score, doc_id, null = heaps.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int64()), pa.array([names[n] for n in number], pa.int64()), pa.array(doc_id, pa.int64(), mask=null), pa.array(score, pa.int64())],
            names=["number", "item", "doc_id", "score"])

    return index.mapInArrow(run, "number long, item long, doc_id long, score long")


def merged(heaps: DataFrame, top: int) -> DataFrame:
    """The heaps of all tasks as one of each item: first those of some tasks together, then all."""
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = heaps.withColumn("part", F.spark_partition_id() % 64)
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("number", "part").orderBy(*best))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(*best))).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, item: str = "item_id", top: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents (doc_id, text) of every item (item_id, text), exactly.

    Null, empty and wordless texts have no terms: such documents are not found and not counted, such items have no rows.
    Rows that repeat a document are documents of their own; equal scores go by id, a missing id last.  Rows equal in
    item id and text are one item; of items that share an id only, each has its ranks.  Other columns do not matter.
    Terms are known by 64-bit hashes: with 10^5 terms of items and 10^9 of documents, two of one hash have a chance of 10^-5.
    Items are collected in blocks of about `pairs` terms, whose vocabulary goes to all tasks.
    """
    terms = stored(item_terms(items, item), "items")
    blocks = max(1, -(-int(terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // pairs))
    out = None
    for block in range(blocks):
        mine = terms.filter(F.pmod(F.xxhash64("item", "text_hash"), F.lit(blocks)) == block).orderBy(F.col("item").asc_nulls_last(), "text_hash").collect()
        hashes = [np.array(r["terms"], np.int64).view(np.uint64) for r in mine]
        vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(1, np.uint64)
        index = stored(shards(docs, vocabulary), "shards")
        n_docs, n_terms, df = statistics(index, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        found = stored(merged(search_shards(index, [np.searchsorted(vocabulary, h) for h in hashes], [r["item"] for r in mine], weights, n_docs, max(n_terms, 1), top), top), "found")
        discard(index)
        out = found if out is None else out.unionByName(found)
    discard(terms)
    return out.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op13_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), n),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN v USING (term), n GROUP BY 1, 2, 3),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {TOP}"""
