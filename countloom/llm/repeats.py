"""Repeated byte strings: sampled suffixes sorted by hash-found common extensions, with byte verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import _byte_tables, _inverse_powers, _powers, as_text, discard, mix64, slices, stored, table, text_buffer, worker_cache
from countloom.llm.jaccard import in_bitmap

#: Bytes of an anchor.  Every window of `length` bytes has one: the k-gram in it of the smallest hash, the leftmost of several.
GRAM = 128
#: Places of one anchor that are sorted in one task at most, about; the windows of larger ones are counted by their digests.
GROUP = 20_000
#: Distinct contexts of an anchor up to which all pairs of its sorted order are looked at together with those of other anchors.
SMALL = 12
FILTER_BITS = 26
#: Windows of a text that are hashed at once; a place among them takes 28 bits beside its hash.
STRETCH = 1 << 20
PLACE = np.uint64((1 << 28) - 1)


def gram_hashes(data: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Mixed polynomial hash of every k bytes, from prefix sums."""
    n = len(data)
    _, _, weight = worker_cache("bytes", _byte_tables)
    if salt:
        weight = mix64(weight + np.uint64(salt)) | np.uint64(1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(weight[data] * _powers(n)[:n], out=prefix[1:])
    return mix64((prefix[k:] - prefix[:-k]) * _inverse_powers(n)[: n - k + 1] + np.uint64(salt))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width values in a row: running minima of blocks from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(anchor, hash, first window, last window, document) of every run of windows that share an anchor.

    A window is `length` bytes of one document.  Its anchor depends on its bytes alone, so equal windows have
    their anchors at the same distance.  Long texts go by stretches of windows; a run over a border becomes two.
    """
    if len(data) <= STRETCH + length:
        return _anchors(data, offsets, length, gram)
    found = []
    for doc, (begin, end) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        for at in range(begin, max(begin, end - length + 1), STRETCH):
            part = data[at : min(at + STRETCH + length - 1, end)]
            where, hashes, first, last, of = _anchors(part, np.array([0, len(part)]), length, gram)
            found.append((where + at, hashes, first + at, last + at, of + doc))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else _anchors(data[:0], np.zeros(1, np.int64), length, gram)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none, none
    hashes = gram_hashes(data, gram)
    keyed = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = (sliding_minimum(keyed, length - gram + 1) & PLACE).astype(np.int64)
    room = np.zeros(n + 1, np.int64)
    sizes = np.diff(offsets)
    has = sizes >= length
    np.add.at(room, offsets[:-1][has], 1)
    np.add.at(room, offsets[1:][has] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(room)[: len(least)] > 0)
    if not len(valid):
        return none, none.astype(np.uint64), none, none, none
    at = least[valid]
    doc = np.searchsorted(offsets, valid, side="right") - 1
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return at[first], hashes[at[first]], valid[first], valid[last], doc[first]


class Extensions:
    """Common extensions of contexts to the right and the left of their anchors, and the orders that follow from them.

    Prefix polynomial hashes of all contexts and binary search give a common extension in a logarithmic number of hash
    comparisons.  Orders come from a merge sort whose comparisons are those; the bytes then verify every neighbouring
    pair of an order, and a group with a collision is sorted by its bytes.
    """

    def __init__(self, contexts: list[bytes], left: np.ndarray):
        self.contexts = contexts
        self.data = np.frombuffer(b"".join(contexts) + b"\0", np.uint8)
        sizes = np.array([len(c) for c in contexts], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        n = int(begin[-1])
        self.left, self.right = left, sizes - left
        _, _, weight = worker_cache("bytes", _byte_tables)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(weight[self.data[:n]] * _powers(n)[:n], out=self.prefix[1:])
        self.inverse = _inverse_powers(n + 1)
        self.anchor = begin[:-1] + left

    def common(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """Bytes that contexts i and j have in common from their anchors on (or before them), by hashes."""
        limit = self.left if back else self.right
        low, high = np.zeros(len(i), np.int64), np.minimum(limit[i], limit[j])
        a, b = self.anchor[i], self.anchor[j]
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo] + 1) // 2
            p, q = a[todo], b[todo]
            x, y = (p - middle, q - middle) if back else (p, q)
            u, v = (p, q) if back else (p + middle, q + middle)
            same = (self.prefix[u] - self.prefix[x]) * self.inverse[x] == (self.prefix[v] - self.prefix[y]) * self.inverse[y]
            low[todo], high[todo] = np.where(same, middle, low[todo]), np.where(same, high[todo], middle - 1)
            todo = todo[low[todo] < high[todo]]
        return low

    def order(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """Below 0 where context i comes before j, above where after: by the first byte that differs, the shorter first."""
        limit = self.left if back else self.right
        n = self.common(i, j, back)
        ended = (n == limit[i]) | (n == limit[j])
        step = -1 - n if back else n
        x, y = (self.data[np.where(ended, 0, self.anchor[m] + step)].astype(np.int64) for m in (i, j))
        return np.where(ended, limit[i] - limit[j], x - y)

    def sorted_groups(self, start: np.ndarray, count: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """All members in the order of each group, and the extension of each with the one after it (0 for a group's last).

        A merge sort of all groups at once: each element of a run finds its place in the run that it is merged with
        by binary search.  Members of a group are count[g] contexts from start[g] on.
        """
        n = int(count.sum())
        base, size = np.repeat(start, count), np.repeat(count, count)
        members, local = np.arange(n), np.arange(n) - base
        wrong: set[int] = set()
        width = 1
        while width < count.max(initial=0):
            run = local // width
            low = np.minimum(base + (run ^ 1) * width, base + size)
            high = np.maximum(np.minimum(low + width, base + size), low)
            first, after = low.copy(), run & 1 == 1
            todo = np.flatnonzero(low < high)
            while len(todo):
                middle = (low[todo] + high[todo]) // 2
                sign = self.order(members[middle], members[todo], back)
                further = np.where(after[todo], sign <= 0, sign < 0)
                low[todo], high[todo] = np.where(further, middle + 1, low[todo]), np.where(further, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
            target = base + (run >> 1) * 2 * width + (local - run * width) + (low - first)
            merged = np.empty_like(members)
            merged[target] = members
            twice = np.bincount(target, minlength=n) != 1
            if twice.any():  # comparisons that contradict each other: a collision
                torn = np.isin(base, np.unique(base[twice]))
                merged[torn] = members[torn]
                wrong.update(base[torn].tolist())
            members = merged
            width *= 2
        shared = np.zeros(n, np.int64)
        inner = np.flatnonzero(local < size - 1)
        shared[inner] = self.common(members[inner], members[inner + 1], back)
        wrong.update(int(base[p]) for p in inner.tolist() if not self._holds(int(members[p]), int(members[p + 1]), int(shared[p]), back))
        for at, held in zip(start.tolist(), count.tolist()):
            if at in wrong:
                self._by_bytes(members, shared, at, held, back)
        return members, shared

    def _side(self, x: int, back: bool) -> bytes:
        text, left = self.contexts[x], int(self.left[x])
        return text[:left][::-1] if back else text[left:]

    def _holds(self, x: int, y: int, n: int, back: bool) -> bool:
        a, b, p, q = self.contexts[x], self.contexts[y], int(self.left[x]), int(self.left[y])
        if back:
            return a[p - n : p] == b[q - n : q] and (n == p or (n < q and a[p - n - 1] < b[q - n - 1]))
        return a[p : p + n] == b[q : q + n] and (p + n == len(a) or (q + n < len(b) and a[p + n] < b[q + n]))

    def _by_bytes(self, members: np.ndarray, shared: np.ndarray, at: int, held: int, back: bool) -> None:
        sides = sorted((self._side(int(m), back), int(m)) for m in members[at : at + held])
        members[at : at + held] = [m for _, m in sides]
        for p, ((a, _), (b, _)) in enumerate(zip(sides, sides[1:])):
            shared[at + p] = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def covered(ext: Extensions, start: np.ndarray, count: np.ndarray, length: int):
    """(member, bytes to the left, bytes to the right of its anchor) that a match of `length` or more with another member of its group covers.

    In the order of right contexts two members share the least extension between them, and so in that of left contexts.
    """
    order, common = ext.sorted_groups(start, count, False)
    by_left, left_common = ext.sorted_groups(start, count, True)
    rank = np.empty(len(order), np.int64)
    rank[by_left] = np.arange(len(order))
    out = []
    for m in np.unique(count[(count > 1) & (count <= SMALL)]).tolist():
        rows = start[count == m][:, None] + np.arange(m)
        place = rank[order[rows]] - rows[:, :1]
        # least left extension between places x < y of the left order
        between = np.full((len(rows), m, m), 1 << 60)
        for d in range(1, m):
            for x in range(m - d):
                between[:, x, x + d] = np.minimum(between[:, x, x + d - 1], left_common[rows[:, x + d - 1]])
        group = np.arange(len(rows))
        for i in range(m):
            right = np.full(len(rows), 1 << 60)
            for j in range(i + 1, m):
                right = np.minimum(right, common[rows[:, j - 1]])
                left = between[group, np.minimum(place[:, i], place[:, j]), np.maximum(place[:, i], place[:, j])]
                ok = left + right >= length
                for k in (i, j):
                    out.append((order[rows[ok, k]], left[ok], right[ok]))
    for g in np.flatnonzero(count > SMALL):
        inside = slice(start[g], start[g] + count[g])
        out += _levels(order[inside], common[inside][:-1], rank[order[inside]] - start[g], left_common[inside][:-1], length)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _levels(order, common, rank, left_common, length: int):
    """For every level of the tree of right extensions, a member's longest left extension among those below the same node.

    It is with a neighbour in the order of left contexts; level and left extension together are the match.
    """
    least = [left_common]  # minima over 2**k neighbours
    while 2 * (1 << (len(least) - 1)) <= len(left_common):
        h = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-h], least[-1][h:]))
    least_of = lambda x, y: np.array([min(least[k][p], least[k][q - (1 << k)]) for p, q in zip(x.tolist(), y.tolist()) for k in [(q - p).bit_length() - 1]], np.int64)
    out = []
    for level in np.unique(common)[::-1].tolist():
        cut = np.flatnonzero(common < level)
        starts, ends = np.concatenate([[0], cut + 1]), np.append(cut + 1, len(order))
        hit = np.searchsorted(starts, np.flatnonzero(common == level), side="right") - 1
        for c in np.unique(hit).tolist():
            inside = np.arange(starts[c], ends[c])
            sorted_ = inside[np.argsort(rank[inside])]
            between = least_of(rank[sorted_[:-1]], rank[sorted_[1:]])
            best = np.maximum(np.append(between, 0), np.append(0, between))
            ok = best + level >= length
            out.append((order[sorted_[ok]], best[ok], np.full(int(ok.sum()), level, np.int64)))
    return out


def anchor_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 0):
            data, offsets = text_buffer(batch.column(0))
            _, hashes, _, _, _ = anchors(data, offsets, length, gram)
            value, count = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


def bloom(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for every anchor of keys, in 2**bits: a filter of fixed size.

    What the filter of repeated anchors lets through wrongly finds no partner later; an anchor that the filter of frequent
    ones takes wrongly is counted by windows in all its places, which gives the same bytes.
    """
    rows = keys.select(F.expr(f"pmod(key, {1 << bits}L)").alias("spot")).groupBy(F.expr("shiftright(spot, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(spot, 64) AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _in(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes & np.uint64(len(filter_) * 64 - 1)
    return (filter_[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) > 0


def contexts(docs: DataFrame, length: int, gram: int, repeated, frequent) -> DataFrame:
    """Rows of repeated anchors: kind 0 the context of an anchor, kind 1 one window of a frequent anchor by its 128-bit BLAKE2 digest (key, second)."""

    def run(batches):
        import hashlib

        for batch in slices(batches, 2):
            data, offsets = text_buffer(batch.column(2))
            ids, marks = (np.asarray(batch.column(c)) for c in (0, 1))
            at, hashes, first, last, doc = anchors(data, offsets, length, gram)
            keep = _in(repeated.value, hashes)
            often = keep & _in(frequent.value, hashes) if len(frequent.value) else np.zeros(len(keep), bool)
            whole = data.tobytes()
            for f, l, d in zip(first[often].tolist(), last[often].tolist(), doc[often].tolist()):
                found = b"".join(hashlib.blake2b(whole[x : x + length], digest_size=16).digest() for x in range(f, l + 1))
                digest = np.frombuffer(found, np.int64).reshape(-1, 2)
                n = len(digest)
                yield _context_batch(1, digest[:, 0], digest[:, 1], np.full(n, ids[d]), np.full(n, marks[d]), np.arange(f, l + 1) - offsets[d], np.zeros(n, int), [b""] * n)
            k = np.flatnonzero(keep & ~often)
            blobs = [whole[f : l + length] for f, l in zip(first[k].tolist(), last[k].tolist())]
            for s in range(0, len(k), 2000):
                c = slice(s, s + 2000)
                kc = k[c]
                yield _context_batch(0, hashes[kc].view(np.int64), np.zeros(len(kc), np.int64), ids[doc[kc]], marks[doc[kc]], first[kc] - offsets[doc[kc]], at[kc] - first[kc], blobs[c])

    def _context_batch(kind, key, second, id_, mark, start, left, blob):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int32)), *(pa.array(x, pa.int64()) for x in (key, second, id_, mark, start, left)), pa.array(blob, pa.binary())],
            ["kind", "key", "second", "id", "mark", "start", "left", "context"])

    return docs.mapInArrow(run, "kind int, key long, second long, id long, mark long, start long, left long, context binary")


def group_intervals(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """(id, mark, a, b) covered by matches, from contexts dealt by anchor."""

    def flush(keys, ids, marks, starts, lefts, blobs):
        import pyarrow as pa

        distinct: dict[tuple, int] = {}
        of = np.array([distinct.setdefault(mark, len(distinct)) for mark in zip(keys, lefts, blobs)], np.int64)
        ids, marks, starts, left = (np.array(x, np.int64) for x in (ids, marks, starts, lefts))
        texts = [blob for _, _, blob in distinct]
        size = np.array([len(x) for x in texts], np.int64)
        by_context = np.argsort(of, kind="stable")
        held = np.bincount(of, minlength=len(texts))
        begin = np.concatenate([[0], np.cumsum(held)])
        # a whole context that stands elsewhere too
        twice = np.flatnonzero(held[of] > 1)
        out = [(twice, starts[twice], starts[twice] + size[of[twice]])]
        key = np.array([k for k, _, _ in distinct], np.int64)
        _, group, members = np.unique(key, return_inverse=True, return_counts=True)
        used = np.flatnonzero(members[group] > 1)
        used = used[np.argsort(group[used], kind="stable")]
        if len(used):
            lefts = np.array([x for _, x, _ in distinct], np.int64)
            count = members[members > 1]
            ext = Extensions([texts[c] for c in used.tolist()], lefts[used])
            member, x, y = covered(ext, np.cumsum(count) - count, count, length)
            context = used[member]
            n = held[context]
            row = by_context[np.repeat(begin[context] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            anchor = starts[row] + left[row]
            out.append((row, anchor - np.repeat(x, n), anchor + np.repeat(y, n)))
        row, a, b = (np.concatenate(x) for x in zip(*out))
        # intervals of a text that touch become one
        order = np.lexsort((a, marks[row], ids[row]))
        row, a, b = row[order], a[order], b[order]
        texts_of = np.concatenate([[0], np.cumsum((ids[row][1:] != ids[row][:-1]) | (marks[row][1:] != marks[row][:-1]))]) if len(row) else row
        first, a, b = _merged(texts_of, a, b) if len(row) else (row, a, b)
        return pa.RecordBatch.from_arrays([pa.array(ids[row[first]]), pa.array(marks[row[first]]), pa.array(a), pa.array(b)], ["id", "mark", "a", "b"])

    def run(batches):
        held: list[list] = [[], [], [], [], [], []]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held[0]) >= 2000 and row[0] != held[0][-1]:
                    yield flush(*held)
                    held = [[], [], [], [], [], []]
                for column, value in zip(held, row):
                    column.append(value)
        if held[0]:
            yield flush(*held)

    dealt = rows.filter("kind = 0").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.select("key", "id", "mark", "start", "left", "context").mapInArrow(run, "id long, mark long, a long, b long")


def _merged(of: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Intervals sorted by (of, a), overlapping or touching ones of the same text joined: (place of the first, a, b).  of counts up from 0."""
    span = int(b.max()) + 2
    reach = np.maximum.accumulate(b + of * span)
    new = np.concatenate([[True], (a + of * span)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of)) - 1
    return first, a[first], reach[last] - of[last] * span


def shared_windows(windows: DataFrame, twice: DataFrame) -> DataFrame:
    """Rows of windows whose digest (key, second) stands in twice: key, second, n places.

    A digest of more than GROUP places would be one task's.  Of those there is at most one in GROUP rows, so they are sent to the rows.
    """
    on = ["key", "second"]
    hot = F.broadcast(twice.filter(F.col("n") > GROUP).select(*on))
    rest = twice.filter(F.col("n") <= GROUP).select(*on)
    return windows.join(hot, on, "left_semi").unionByName(windows.join(hot, on, "left_anti").join(rest, on))


def repeated_intervals(docs: DataFrame, length: int) -> DataFrame:
    """(id, mark, a, b): bytes a to b of a text that a `length`-byte string covers which also starts elsewhere; intervals may overlap.

    docs: id, mark (a hash of the text, which tells texts of one id apart) and text, without nulls.
    """
    spark = docs.sparkSession
    gram = min(GRAM, length)
    keys = stored(anchor_counts(docs, length, gram), "anchors")
    often = keys.filter(F.col("n") > GROUP).select("key")
    some = not often.isEmpty()
    sc = spark.sparkContext
    repeated = sc.broadcast(bloom(keys))  # 8 MB, and so the other
    frequent = sc.broadcast(bloom(often) if some else np.zeros(0, np.uint64))
    rows = contexts(docs, length, gram, repeated, frequent)
    if some:
        rows = stored(rows, "contexts", "snappy")  # pieces of the texts, many of which overlap: several times the input as they are
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 2
    found = group_intervals(rows, length, parts)
    if some:
        windows = rows.filter("kind = 1")
        twice = stored(windows.groupBy("key", "second").agg(F.count("*").alias("n")).filter("n > 1"), "windows")
        found = found.union(shared_windows(windows, twice).select("id", "mark", F.col("start").alias("a"), (F.col("start") + length).alias("b")))
    found = stored(found, "intervals")
    discard(keys, *([rows, twice] if some else []))
    return found


def cut_documents(docs: DataFrame, length: int = 400, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes left, in order).

    Removed is every byte that a `length`-byte string covers which also starts anywhere else, in the same text or another.
    Texts are UTF-8; null and empty texts have no bytes; repeated rows are repeats of each other, and so are equal texts of
    different ids; rows that share an id may differ in text; rows without an id take part as all others do;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    mark = F.xxhash64("text")  # also stands for a missing id: id and mark together tell texts apart, not rows
    source = as_text(docs.select(F.col(id_column).cast("long").alias("own"), "text")).select(F.coalesce("own", mark).alias("id"), mark.alias("mark"), "own", "text")
    found = repeated_intervals(source.filter(F.octet_length("text") >= length).select("id", "mark", "text"), length)
    per = stored(found.groupBy("id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("intervals")), "spans")
    discard(found)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            size, removed, runs, kept = [], [], [], []
            for text, found in zip(texts, spans):
                data = text.encode()
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                size.append(len(data)), runs.append(len(merged)), removed.append(sum(b - a for a, b in merged))
                cuts = [0, *(x for ab in merged for x in ab), len(data)]
                kept.append(b"".join(data[cuts[p] : cuts[p + 1]] for p in range(0, len(cuts), 2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    # most rows have no interval and need no join; the bitmap's size is fixed
    maybe, never = in_bitmap(spark, source, per.select("id").distinct(), both=True)
    some = maybe.join(per, ["id", "mark"], "left").select("own", "text", "intervals").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    rest = never.select(F.col("own").alias("id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return some.union(rest).withColumnRenamed("id", id_column)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings; the text left over stands beside the digest.

    Rows and edge cases as cut_documents states.  A cut may fall inside a character: what is left of it reads as U+FFFD in `text`.
    """
    out = cut_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.expr("make_valid_utf8(cast(kept AS string))").alias("text"))
