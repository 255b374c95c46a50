"""N-gram Jaccard join by parity sketches: XOR-hashed segments, pigeonhole join per size band, exact verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.llm.common import as_text, batch_words, discard, mix64, shingle_hashes, slices, stored, table, text_buffer
from countloom.llm.components import components

#: Buckets of up to ALL members are compared pair by pair; larger ones by stars first, then sketches.
#: Entries that a task packs at once; a key of more than ALL of them leaves its bucket at once and is dealt by rows.
ALL, TILE, FLUSH = 32, 2048, 400_000
BAND, SPARE = 1.4, 0.15
#: Bits of a set's sketch: for sets of up to 256 elements, up to 512, and larger.  Wider ones fold to narrower ones.
BITS = ((256, 1024), (512, 2048), (1 << 62, 4096))


class Bands:
    """Size bands: every pair shares the band of its smaller size, and with it the number of segments.

    Two sets of Jaccard similarity num/den at least differ in at most m * (den - num) // num elements, m being the smaller
    size.  With that bound d of the band's largest size and d + 1 + spare segments, at least 1 + spare segments
    hold the same elements in both sets.
    """

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        edges = [1]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
        self.num, self.den = num, den
        self.edges = np.array(edges, np.int64)
        self.bound = (self.edges[1:] - 1) * (den - num) // num
        self.spare = np.ceil(self.bound * SPARE).astype(np.int64) + 2
        self.segments = self.bound + 1 + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def slots(self, sizes: np.ndarray) -> list[np.ndarray]:
        """Bands in which sets of these sizes take part; -1 for none.  Bands whose sets must be equal are left out."""
        top, low = self.of(sizes), self.of(np.maximum(1, -(-sizes * self.num // self.den)))
        out = []
        for back in range(int((top - low).max(initial=0)) + 1):
            band = top - back
            band = np.where((band >= low) & (sizes > 0), band, -1)
            out.append(np.where((band >= 0) & (self.bound[band] > 0), band, -1))
        return out


def segment_keys(hashes: np.ndarray, bounds: np.ndarray, bands: Bands, seed: int):
    """Keys of the non-empty segments of every set: (set, key, band) and empty segments per slot [(band, empty)].

    A segment of the sketch is the XOR of its elements' hashes: an element changes one segment, so the
    number of segments in which two sketches differ is at most the size of the symmetric difference.
    """
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spread = mix64(hashes ^ np.uint64(0xA5A5A5A5 + 7919 * seed))
    sets, keys, of, empties = [], [], [], []
    for band in bands.slots(sizes):
        parts = np.where(band >= 0, bands.segments[band], 0)
        first = np.concatenate([[0], np.cumsum(parts)])
        use = band[owner] >= 0
        segment = first[owner[use]] + (spread[use] % parts[owner[use]].astype(np.uint64)).astype(np.int64)
        parity = np.zeros(first[-1], np.uint64)
        np.bitwise_xor.at(parity, segment, hashes[use])
        held = np.bincount(segment, minlength=first[-1])
        of_set = np.repeat(np.arange(len(sizes)), parts)
        place = np.arange(first[-1]) - first[of_set]
        full = held > 0
        empties.append((band, np.bincount(of_set[~full], minlength=len(sizes))))
        label = mix64((band[of_set] * 131 + seed + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
        sets.append(of_set[full]), keys.append(mix64(parity[full] ^ label[full])), of.append(band[of_set[full]])
    return np.concatenate(sets), np.concatenate(keys), np.concatenate(of), empties


def weak(empties, bands: Bands, n: int) -> np.ndarray:
    """Sets whose empty segments alone may be all those that a partner shares, in some band."""
    out = np.zeros(n, bool)
    for band, empty in empties:
        out |= (band >= 0) & (empty > bands.spare[band])
    return out


def all_keys(hashes: np.ndarray, bounds: np.ndarray, bands: Bands, seeds: int = 3):
    """Keys of sets: (set, key).  Weak sets also take part under further seeds and at last with their empty segments' stand-in.

    A pair is missed under a seed only if both sets are weak under it, and both then take part in the next.
    """
    n = len(bounds) - 1
    sets, keys, _, empties = segment_keys(hashes, bounds, bands, 0)
    out = [(sets, keys)]
    left = weak(empties, bands, n)
    for seed in range(1, seeds + 1):
        if not left.any():
            break
        chosen = np.flatnonzero(left)
        sizes = np.diff(bounds)[chosen]
        part = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.repeat(left, np.diff(bounds))
        sets, keys, _, empties = segment_keys(hashes[inside], part, bands, seed)
        out.append((chosen[sets], keys))
        again = np.zeros(n, bool)
        again[chosen] = weak(empties, bands, len(chosen))
        if seed == seeds:
            for band, _ in empties:  # weak under every seed: such sets of a band meet in one bucket
                some = again[chosen] & (band >= 0)
                out.append((chosen[some], mix64(band[some].astype(np.uint64) + np.uint64(0x5EED))))
        left = again
    return np.concatenate([s for s, _ in out]), np.concatenate([k for _, k in out])


def bit_sketches(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Parity sketches: an element flips one bit, so the Hamming distance is a lower bound of the symmetric difference.

    The place of an element in a narrow sketch is that in a wide one modulo the width, so the XOR of a wide one's
    parts is the narrow one.
    """
    sizes = np.diff(bounds)
    width = np.select([sizes <= most for most, _ in BITS], [bits // 64 for _, bits in BITS])
    start = np.concatenate([[0], np.cumsum(width)])
    words = np.zeros(start[-1], np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bit = mix64(hashes + np.uint64(0x51)) % (width[owner].astype(np.uint64) * np.uint64(64))
    np.bitwise_xor.at(words, start[owner] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return [words[a:b] for a, b in zip(start, start[1:])]


def folded(blobs: list[bytes], width: np.ndarray) -> np.ndarray:
    """Sketches as rows, those wider than their `width` (in words) folded to it, and zeros after it."""
    out = np.zeros((len(blobs), int(width.max(initial=1))), np.uint64)
    for at, (blob, w) in enumerate(zip(blobs, width.tolist())):
        words = np.frombuffer(blob, np.uint64)
        out[at, :w] = words if len(words) == w else np.bitwise_xor.reduce(words.reshape(-1, w), axis=0)
    return out


def apart(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Largest symmetric difference of linked sets of sizes n and m; -1 where the sizes rule a link out."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    small, large = np.minimum(n, m), np.maximum(n, m)
    return np.where(large * num <= small * den, (n + m) * (den - num) // (den + num), -1)


def _sets(batch, k: int):
    data, offsets = text_buffer(batch.column(1))
    words, doc, _, _ = batch_words(data, offsets)
    hashes, bounds = shingle_hashes(words, doc, len(offsets) - 1, k)
    return hashes, bounds, np.asarray(batch.column(0))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of every set."""
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return prefix[bounds[1:]] - prefix[bounds[:-1]]


def _prints(hashes, bounds):
    return _sums(hashes, bounds), _sums(mix64(hashes ^ np.uint64(0xC0FFEE)), bounds)


def set_classes(docs: DataFrame, k: int) -> DataFrame:
    """id, n, rep: size of a document's shingle set and the smallest id of those with the same set (empty sets: null)."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            hashes, bounds, ids = _sets(batch, k)
            a, b = _prints(hashes, bounds)
            columns = (ids, np.diff(bounds), a.view(np.int64), b.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n", "p", "q"])

    sets = docs.mapInArrow(run, "id long, n long, p long, q long")
    sets = stored(sets, "sets")
    reps = sets.filter("n > 0").groupBy("n", "p", "q").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    # only sets that several documents have need the join
    shared = reps.filter("m > 1").drop("m")
    joined = sets.join(shared, ["n", "p", "q"], "left")
    return joined.select("id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "id")).alias("rep"))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, plane by plane, as high planes are nearly all zero and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width].T).tobytes()


def _numbers(blob: bytes, kind, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = planes.T
    return out.view(kind).ravel()


#: Bytes of a key that travel: with the part that it belongs to they tell enough keys apart, and every candidate is verified.
KEY_BYTES = 5


def _packed(parts: int, pending: list):
    """Entries (key, id, size, print) of a task dealt to parts by key, as rows of arrays; a document's id stands once a row.

    Keys with more than ALL entries here belong to large buckets whatever other tasks hold: their members go to part
    numbers from `parts` on, which are read row by row, and the key's own part gets one mark of size 0.  So a part gets
    at most ALL entries of a key from every flush.
    """
    import pyarrow as pa

    key, doc, size, tag = (np.concatenate(x) for x in zip(*pending))
    part = (key % np.uint64(parts)).astype(np.int32)
    key = key // np.uint64(parts)
    order = np.lexsort((key, part))
    key, doc, size, tag, part = key[order], doc[order], size[order], tag[order], part[order]
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
    count = np.diff(np.append(start, len(key)))
    large = np.repeat(count > ALL, count)
    columns: list[list] = [[], [], [], [], [], [], []]

    def put(number: int, home: int, key, doc, size, tag) -> None:
        order = np.lexsort((tag, doc))
        key, d, size, t = key[order], doc[order], size[order], tag[order]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (size[1:] != size[:-1])]))
        counts = np.diff(np.append(first, len(d))).astype(np.uint32)
        values = (number, home, _planes(key, KEY_BYTES), _planes(d[first], 8), _planes(size[first], 4), _planes(t[first], 8), _planes(counts, 4))
        for column, value in zip(columns, values):
            column.append(value)

    hot = np.flatnonzero(count > ALL)
    for n, h in enumerate(hot.tolist()):
        for at in range(start[h], start[h] + count[h], 4096):
            x = slice(at, min(at + 4096, start[h] + count[h]))
            put(parts + int(mix64(key[x][:1] + np.uint64(at))[0] % np.uint64(parts)), int(part[at]), key[x], doc[x], size[x], tag[x])
    few = np.flatnonzero(~large)
    marks = start[hot]
    size[marks] = 0
    use = np.sort(np.concatenate([few, marks]))
    key, doc, size, tag, part = key[use], doc[use], size[use], tag[use], part[use]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            put(int(part[a]), int(part[a]), key[a:b], doc[a:b], size[a:b], tag[a:b])
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "home", "keys", "ids", "sizes", "tags", "counts"])


def sketch_entries(docs: DataFrame, k: int, bands: Bands, parts: int) -> DataFrame:
    def run(batches):
        pending, held, seen = [], 0, set()
        for batch in slices(batches, 1):
            hashes, bounds, ids = _sets(batch, k)
            if not len(hashes):
                continue
            a, b = _prints(hashes, bounds)
            sizes = np.diff(bounds)
            # copies that this task has dealt with need no entries of their own: set_classes joins them
            fresh = np.zeros(len(ids), bool)
            for i, mark in enumerate(zip(a.tolist(), b.tolist(), sizes.tolist())):
                if sizes[i] and mark not in seen:
                    seen.add(mark)
                    fresh[i] = True
            if len(seen) > 100_000:
                seen.clear()
            chosen = np.flatnonzero(fresh)
            if not len(chosen):
                continue
            sets, keys = all_keys(hashes[np.repeat(fresh, sizes)], np.concatenate([[0], np.cumsum(sizes[chosen])]), bands)
            if not len(keys):
                continue
            of = chosen[sets]
            pending.append((keys, ids[of], sizes[of].astype(np.uint32), (a ^ mix64(b))[of]))
            held += len(keys)
            if held > FLUSH:
                yield _packed(parts, pending)
                pending, held = [], 0
        if pending:
            yield _packed(parts, pending)

    return docs.mapInArrow(run, "part int, home int, keys binary, ids binary, sizes binary, tags binary, counts binary")


def bucket_rows(entries: DataFrame, bands: Bands, parts: int) -> DataFrame:
    """Rows (kind, key, a, b) from the buckets: 0 candidate pairs (a, b), 1 members a of buckets over ALL.

    Sets of one size and 64-bit print in a bucket are copies, told apart no better anywhere else: their smallest id stands for them.
    """

    def rows(kind, key, a, b):
        import pyarrow as pa

        for at in range(0, len(a), 10000):
            x = slice(at, at + 10000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[x]), kind, np.int32)), pa.array(key[x]), pa.array(a[x]), pa.array(b[x])], ["kind", "key", "a", "b"])

    def run(batches):
        for number, home, key, doc, size, tag in _grouped(batches, parts):
            key = key * np.uint64(parts) + np.uint64(home)
            if number >= parts:
                yield from rows(1, key.view(np.int64), doc, doc)
                continue
            order = np.lexsort((doc, tag, size, key))
            key, doc, size, tag = key[order], doc[order], size[order].astype(np.int64), tag[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (tag[1:] != tag[:-1])
            marked = np.unique(key[size == 0])
            keep = first & (size > 0)
            key, doc, size = key[keep], doc[keep], size[keep]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            count = np.diff(np.append(start, len(key)))
            hot = (count > ALL) | np.isin(key[start], marked)
            found = [(np.zeros(0, int), np.zeros(0, int))]
            for m in np.unique(count[(count > 1) & ~hot]):
                at = start[(count == m) & ~hot][:, None] + np.arange(m)
                i, j = np.triu_indices(m, 1)
                found.append((at[:, i].ravel(), at[:, j].ravel()))
            i, j = (np.concatenate(x) for x in zip(*found))
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            near = (large * bands.num <= small * bands.den) & (doc[i] != doc[j])
            pairs = np.unique(np.stack([np.minimum(doc[i], doc[j])[near], np.maximum(doc[i], doc[j])[near]], 1), axis=0)
            yield from rows(0, np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
            members = np.repeat(hot, count)
            yield from rows(1, key[members].view(np.int64), doc[members], doc[members])

    dealt = entries.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "kind int, key long, a long, b long")


def _grouped(batches, parts: int):
    """Arrays of each part, from rows that arrive sorted by part; rows of part numbers from `parts` on come one by one."""
    current, home, pieces = None, None, []
    for batch in batches:
        for row in range(batch.num_rows):
            part, at, *blobs = (batch.column(c)[row].as_py() for c in range(batch.num_columns))
            if pieces and (part != current or part >= parts):
                yield current, home, *(np.concatenate(x) for x in zip(*pieces))
                pieces = []
            current, home = part, at
            counts = _numbers(blobs[4], np.uint32, 4)
            ids, sizes, tags = (np.repeat(_numbers(b, kind, w), counts) for b, kind, w in zip(blobs[1:4], (np.int64, np.uint32, np.uint64), (8, 4, 8)))
            pieces.append([_numbers(blobs[0], np.uint64, KEY_BYTES), ids, sizes, tags])
    if pieces:
        yield current, home, *(np.concatenate(x) for x in zip(*pieces))


def in_bitmap(spark: SparkSession, rows: DataFrame, wanted: DataFrame, both: bool = False):
    """rows whose id may be in wanted (id): a bitmap of fixed size, 2**23 bits, drops most others before anything is shuffled.  both: also those that surely aren't."""
    spot = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 23))
    words = wanted.select(F.shiftright(spot, 6).alias("_word"), spot.alias("_spot")).groupBy("_word").agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(_spot, 64) AS int))")).alias("_bits"))
    # at most 131,072 rows of two longs whatever the input
    placed = rows.withColumn("_spot", spot).withColumn("_word", F.shiftright("_spot", 6))
    hit = F.getbit("_bits", F.pmod("_spot", F.lit(64)).cast("int")) == 1
    joined = placed.join(F.broadcast(words), "_word", "left" if both else "inner")
    found = joined.filter(hit).drop("_word", "_bits", "_spot")
    return (found, joined.filter(~F.coalesce(hit, F.lit(False))).drop("_word", "_bits", "_spot")) if both else found


def sketches(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """id, n, sketch, slack: shared segments that a set can spare in every one of its bands, its empty ones taken off."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            hashes, bounds, ids = _sets(batch, k)
            words = bit_sketches(hashes, bounds)
            slack = np.full(len(ids), 1 << 30, np.int64)
            for band, empty in segment_keys(hashes, bounds, bands, 0)[3]:
                slack = np.where(band >= 0, np.minimum(slack, bands.spare[band] - empty), slack)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.diff(bounds)), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(slack)], ["id", "n", "sketch", "slack"])

    return docs.mapInArrow(run, "id long, n long, sketch binary, slack long")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """id, hashes (sorted)."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            hashes, bounds, ids = _sets(batch, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["id", "hashes"])

    return docs.mapInArrow(run, "id long, hashes binary")


def screened(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Pairs whose bit sketches are no farther apart than linked sets may be: most others go before any set travels."""
    num, den = bands.num, bands.den

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, n, m = (np.asarray(batch.column(i)) for i in range(4))
            x, y = (batch.column(i).to_pylist() for i in (4, 5))
            width = np.minimum([len(v) // 8 for v in x], [len(v) // 8 for v in y]).astype(np.int64)
            far = np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(axis=1, dtype=np.int64)
            near = far <= apart(n, m, num, den)
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], ["a", "b"])

    side = lambda p: sets.select(F.col("id").alias(p), F.col("n").alias(f"n_{p}"), F.col("sketch").alias(f"sketch_{p}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return both.mapInArrow(run, "a long, b long")


#: Partners of a set in one task at most, about; a set of more is dealt to several tasks.
PARTNERS = 128


def verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough, counted exactly.

    Sets go by one join to where they are wanted: b's to each row of a, a's own once to every task that holds rows of a.
    """
    num, den = bands.num, bands.den
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("long").alias("salts"))
    dealt = pairs.join(salts, "a").withColumn("s", F.pmod(F.xxhash64("b"), F.col("salts"))).select("a", "s", "b")
    wanted = dealt.select("a", "s", "b", F.col("b").alias("id")).union(dealt.select("a", "s").distinct().select("a", "s", F.lit(None).cast("long"), F.col("a")))

    def run(batches):
        import pyarrow as pa

        current, mine = None, None
        for batch in batches:
            a_out, b_out = [], []
            for row in range(batch.num_rows):
                a, b = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                values = np.frombuffer(batch.column(2)[row].as_buffer(), np.uint64)
                if b is None:
                    current, mine = a, values.copy()
                    continue
                assert a == current
                place = np.searchsorted(mine, values)
                place[place == len(mine)] = 0
                both = int((mine[place] == values).sum()) if len(mine) else 0
                if both and den * both >= num * (len(mine) + len(values) - both):
                    a_out.append(a), b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    parts = max(8, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = wanted.join(sets, "id").select("a", "s", "b", "hashes").repartition(parts, "a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "hashes").mapInArrow(run, "a long, b long")


def rare_enough(hot: DataFrame, slack: DataFrame) -> DataFrame:
    """hot (key, id) without what no linked pair needs: every set drops its `slack` most frequent keys.

    Linked sets share more segments than either can spare (empty ones taken off).  In one order of all keys by frequency,
    the rarest that both hold is therefore never among the `slack` most frequent of either.  Keys of small buckets are rarer than
    all of these and stay.  slack: id, slack.
    """
    sizes = hot.groupBy("key").agg(F.count("*").alias("m"))
    ranked = hot.join(sizes, "key").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("m"), "key")))
    return ranked.join(slack, "id").filter("r > slack").select("key", "id")


def star_pairs(hot: DataFrame) -> DataFrame:
    """(a, b): every member of a large bucket with up to four of it, the smallest and the largest id and two by hash."""
    by = lambda f, seed: f("id", F.xxhash64(F.lit(seed), "id"))
    pivots = hot.groupBy("key").agg(F.min("id").alias("w"), F.max("id").alias("x"), by(F.min_by, 1).alias("y"), by(F.min_by, 2).alias("z"))
    pivots = pivots.select("key", F.explode(F.array_distinct(F.array("w", "x", "y", "z"))).alias("pivot"))
    return hot.join(pivots, "key").filter("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))


def sketch_pairs(members: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of one bucket's members in different components whose sketches are close enough.

    members: key, id, component, n, sketch.  Buckets over TILE members become tiles of two parts each.
    """
    num, den = bands.num, bands.den
    sizes = members.groupBy("key").agg(F.count("*").alias("m"))
    dealt = members.join(sizes, "key").withColumn("blocks", F.ceil(F.col("m") / TILE).cast("long"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "component", "n", "sketch")

    def run(key, group):
        import pyarrow as pa

        ids, comp, n, block = (group.column(c).to_numpy() for c in ("id", "component", "n", "block"))
        blobs = group.column("sketch").to_pylist()
        # one width for the bucket: that of its narrowest sketch
        words = folded(blobs, np.full(len(blobs), min(map(len, blobs)) // 8))
        first, second = (np.flatnonzero(block == key[i].as_py()) for i in (1, 2))
        # members of the component that most are in meet only those outside it
        kinds, count = np.unique(comp[second], return_counts=True)
        main = kinds[np.argmax(count)]
        outside = second[comp[second] != main]
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for xs, ys in ((first[comp[first] == main], outside), (first[comp[first] != main], second)):
            for at in range(0, len(xs) if len(ys) else 0, 64):
                x = xs[at : at + 64]
                far = np.bitwise_count(words[x][:, None, :] ^ words[ys][None]).sum(axis=2, dtype=np.int64)
                near = (far <= apart(n[x][:, None], n[ys][None], num, den)) & (comp[x][:, None] != comp[ys])
                i, j = np.nonzero(near)
                a_out.append(np.minimum(ids[x[i]], ids[ys[j]])), b_out.append(np.maximum(ids[x[i]], ids[ys[j]]))
        pairs = np.unique(np.stack([np.concatenate(a_out), np.concatenate(b_out)], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def similarity_classes(docs: DataFrame, k: int, num: int, den: int, id_column: str = "doc_id", links: bool = False) -> DataFrame:
    """Per row: id, n_shingles (size of the set of k-word shingles), component_id (smallest id linked directly or through others).

    Two documents link where den * |A & B| >= num * |A | B|.  Words are what stands between 0x20 and 0x09-0x0D,
    A-Z lower-cased; shingles are compared by 64-bit hashes.  Null, empty and blank texts have no shingles and no links;
    with fewer than k words the whole sequence is the only shingle.  Rows that repeat an id share its component;
    rows without an id are linked with nothing and have nulls.  An empty table gives no rows; other columns are ignored.

    Large buckets are first tied by stars of four members; what then is in different components of a bucket is compared by
    bit sketches.  Buckets first lose the members that rarer segments cover (rare_enough).

    links: also n_links, the number of other documents linked directly.  Then no pair is left out because its sets are in one component
    already: every candidate is counted, so work grows with the number of links between different sets (copies count by their class's size).
    """
    spark = docs.sparkSession
    bands = Bands(num, den)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 2
    source = as_text(docs.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), "text"))
    classes = stored(set_classes(source, k), "classes")
    buckets = stored(bucket_rows(sketch_entries(source, k, bands, parts), bands, parts), "buckets")
    # copies stand for their class's smallest id
    reps = classes.filter("rep <> id").select("id", "rep").distinct()

    def by_class(rows: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            rows = rows.join(reps.select(F.col("id").alias(c), F.col("rep").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
        return rows

    def outline_of(ids: DataFrame) -> DataFrame:
        # what the bitmap lets through wrongly joins nothing; rows that repeat an id repeat a pair, which links once
        return sketches(in_bitmap(spark, source, ids), k, bands)

    pairs = by_class(buckets.filter("kind = 0").select("a", "b").distinct(), "a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hot = stored(by_class(buckets.filter("kind = 1").select("key", F.col("a").alias("id")), "id").distinct(), "hot")
    some = not hot.isEmpty()
    if some:
        slack = stored(outline_of(hot.select("id").distinct()).groupBy("id").agg(F.min("slack").alias("slack")), "slack")
        heavy = stored(rare_enough(hot, slack), "heavy")
        if links:
            alone = outline_of(heavy.select("id").distinct()).drop("slack").dropDuplicates(["id"])
            pairs = pairs.union(sketch_pairs(heavy.join(alone, "id").withColumn("component", F.col("id")), bands))
        else:
            pairs = pairs.union(star_pairs(heavy))
        discard(hot, slack)
        hot = heavy
    pairs = stored(pairs.distinct(), "pairs")
    discard(buckets)

    def counted(candidates: DataFrame) -> DataFrame:
        ends = stored(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct(), "ends")
        sets = shingle_sets(in_bitmap(spark, source, ends).join(ends, "id", "left_semi"), k)
        found = stored(verified(candidates, sets, bands), "links")
        discard(ends)
        return found

    def checked(candidates: DataFrame, outline: DataFrame) -> DataFrame:
        """Links among candidates that give the same components as all of them: first one partner of each set, then pairs left apart."""
        near = stored(screened(candidates, outline, bands), "screened")
        if links:
            found = counted(near)
            discard(near)
            return found
        one = stored(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "one")
        found = counted(one)
        known = stored(components(found), "known")
        rest = near.join(one, ["a", "b"], "left_anti")
        for c in ("a", "b"):
            rest = rest.join(known.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
        rest = stored(rest.filter("_a <> _b").select("a", "b"), "rest")
        if not rest.isEmpty():
            found = stored(found.union(counted(rest)), "links")
        discard(near, one, known, rest)
        return found

    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    wanted = stored((wanted.union(hot.select("id")) if some else wanted).distinct(), "wanted")
    outline = stored(outline_of(wanted), "sketches")
    discard(wanted)
    found = checked(pairs, outline)
    linked = stored(components(found), "linked")
    if some and not links:
        members = hot.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_ = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
        members = members.join(open_, "key").join(outline.drop("slack").dropDuplicates(["id"]), "id")
        more = stored(sketch_pairs(members, bands).join(pairs, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            further = checked(more, outline)
            before, linked = linked, stored(components(found.union(further)), "linked")
            discard(before, further)
        discard(hot, more)
    discard(pairs, outline)
    linked = linked.withColumnRenamed("node", "rep")
    out = classes.join(linked, "rep", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"), *(["rep"] if links else []))
    nothing = F.lit(None).cast("long")
    if links:
        sizes = classes.filter("n > 0").groupBy("rep").agg(F.count_distinct("id").alias("_m"))
        ends = found.select("a", "b").distinct()
        ends = ends.union(ends.select("b", "a")).join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("_m").alias("_l"))
        out = out.join(sizes, "rep", "left").join(ends, "rep", "left").select(
            id_column, "n_shingles", "component_id", (F.coalesce("_m", F.lit(1)) - 1 + F.coalesce("_l", F.lit(0))).alias("n_links"))
        rest = docs.filter(F.col(id_column).isNull()).select(nothing.alias(id_column), nothing.alias("n_shingles"), nothing.alias("component_id"), nothing.alias("n_links"))
        return out.union(rest)
    discard(found)
    return out.union(docs.filter(F.col(id_column).isNull()).select(nothing.alias(id_column), nothing.alias("n_shingles"), nothing.alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id") -> DataFrame:
    """docs without the rows whose component has a smaller id; of rows that repeat an id one stays.  Rows without an id stay."""
    spark = docs.sparkSession
    classes = similarity_classes(docs.filter(F.col(id_column).isNotNull()), k, num, den, id_column)
    dropped = classes.filter(F.col(id_column) != F.col("component_id")).select(F.col(id_column)).distinct()
    # most rows are surely not dropped and need no join
    wanted = stored(dropped.withColumnRenamed(id_column, "id"), "dropped")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_column).cast("long").alias("id"))
    maybe, never = in_bitmap(spark, rows, wanted, both=True)
    kept = maybe.join(wanted, "id", "left_anti").select("_doc.*").union(never.select("_doc.*"))
    again = docs.groupBy(id_column).agg(F.count("*").alias("m")).filter("m > 1")
    if again.isEmpty():
        return kept
    return kept.filter(F.col(id_column).isNull()).union(kept.filter(F.col(id_column).isNotNull()).dropDuplicates([id_column]))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by three-word shingles at 0.9; rows and edge cases as similarity_classes states."""
    return similarity_classes(table(spark, sf_dir, "documents"), 3, 90, 100)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
