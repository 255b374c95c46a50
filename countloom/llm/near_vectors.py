"""Near-duplicate vectors: a navigable small-world graph per shard, every shard queried, links verified, components united."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, discard, mix64, stored, table
from countloom.llm.components import components

#: Vectors of a shard, about; links of a node above the ground and on it; beams to build and first to search with.
SHARD, LINKS, GROUND, BUILD, BEAM = 8192, 12, 24, 40, 48
#: Queries with links of a tile whose links are counted by brute force; the share of each one's that a beam must find, on average.
AUDIT, RECALL = 96, 0.999
STRIP, EXPAND = 256, 4


class Graph:
    """Hierarchical navigable small-world graph over unit vectors.

    Layers are nested; a node's top layer follows from a hash of its place.  Nodes go in by falling top layer, so that a
    search from above always enters a layer at a node that is there.  Batches of nodes search the graph so far and
    each other, and keep diverse neighbours: one that is nearer to a kept neighbour than to the node comes last.
    """

    def __init__(self, vectors: np.ndarray):
        self.v = vectors
        n = len(vectors)
        u = (mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(LINKS)).astype(int), 8)
        self.order = np.lexsort((u, -level))
        self.layers: list[tuple[int, np.ndarray]] = []  # (nodes of the layer in order, neighbours by place in order)
        self.w = self.v[self.order]
        for layer in range(int(level.max(initial=0)), -1, -1):
            self._grow(int((level >= layer).sum()), GROUND if layer == 0 else LINKS)

    def _grow(self, size: int, links: int) -> None:
        near = np.full((size, links), -1, np.int32)
        self.layers.append((size, near))
        done = 0
        while done < size:
            take = min(size - done, 256 if done == 0 else min(512, done))
            new = np.arange(done, done + take)
            inside = self.w[new] @ self.w[new].T
            np.fill_diagonal(inside, -2)
            k = min(BUILD, take - 1)
            columns = np.argpartition(-inside, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((take, 0), int)
            ids, sims = new[columns], np.take_along_axis(inside, columns, 1)
            if done:
                found, score = self.search(self.w[new], BUILD, done)
                ids, sims = np.hstack([ids, found]), np.hstack([sims, score])
            near[new] = self._diverse(self.w[new], ids, sims, links)
            self._back(near, new, links)
            done += take

    def _diverse(self, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
        """At most links of the candidates of every base vector, diverse ones first."""
        sims = np.where(ids < 0, -3.0, sims)
        width = min(BUILD, ids.shape[1])
        order = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(ids), links), -1, np.int32)
        for at in range(0, len(ids), 128):
            i, s = ids[at : at + 128], sims[at : at + 128]
            c = self.w[np.maximum(i, 0)]
            between = np.matmul(c, c.transpose(0, 2, 1))
            chosen = np.zeros(i.shape, bool)
            closest = np.full(i.shape, -2.0)
            for p in range(i.shape[1]):
                ok = (i[:, p] >= 0) & (s[:, p] > closest[:, p]) & (chosen.sum(axis=1) < links)
                chosen[:, p] = ok
                closest = np.where(ok[:, None], np.maximum(closest, between[:, p]), closest)
            # chosen ones first, then the nearest of the rest
            rank = np.argsort(np.where(i < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :links]
            picked = np.take_along_axis(i, rank, 1)
            out[at : at + 128, : picked.shape[1]] = picked
        return out

    def _back(self, near: np.ndarray, new: np.ndarray, links: int) -> None:
        source = np.repeat(new, near.shape[1])
        target = near[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        at, start, count = np.unique(target, return_index=True, return_counts=True)
        width = min(int(count.max(initial=0)), 2 * links)
        extra = np.full((len(at), width), -1, np.int64)
        place = np.arange(len(target)) - np.repeat(start, count)
        keep = place < width
        extra[np.repeat(np.arange(len(at)), count)[keep], place[keep]] = source[keep]
        both = np.hstack([near[at], extra])
        # a node listed twice counts once; listed nodes first
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        both = -np.sort(-both, axis=1)
        held = (both >= 0).sum(axis=1)
        few = held <= links
        near[at[few]] = np.hstack([both, np.full((len(both), links), -1)])[few, :links]
        for x in range(0, int((~few).sum()), 512):
            part, base = both[~few][x : x + 512], at[~few][x : x + 512]
            sims = np.einsum("bmd,bd->bm", self.w[np.maximum(part, 0)], self.w[base])
            near[base] = self._diverse(self.w[base], part, sims, links)

    def search(self, queries: np.ndarray, beam: int, limit: int | None = None):
        """(places in order, similarities) of about the beam nearest nodes of every query; -1 where there are fewer."""
        n = self.layers[-1][0] if limit is None else limit
        ids = np.zeros((len(queries), 1), np.int64)
        for depth, (size, near) in enumerate(self.layers):
            last = depth == len(self.layers) - 1
            size = min(size, n)
            if size:
                found = [self._beam(queries[at : at + STRIP], ids[at : at + STRIP], near, size, beam if last else 8) for at in range(0, len(queries), STRIP)]
                ids = np.vstack([f[0] for f in found])
                sims = np.vstack([f[1] for f in found])
                if not last:
                    ids = ids[:, :4]
        return ids, sims

    def _beam(self, q, entry, near, size, beam):
        b = len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, size + 1), bool)  # the last column stands for no node
        entry = np.where((entry < 0) | (entry >= size), size, entry)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -3.0, np.float32)
        first = entry[:, :beam]
        s = np.einsum("bmd,bd->bm", self.w[np.minimum(first, size - 1)], q)
        ids[:, : first.shape[1]] = np.where(first < size, first, -1)
        sims[:, : first.shape[1]] = np.where(first < size, s, -3.0)
        seen[rows, first] = True
        seen[:, size] = True
        ready = ids >= 0
        while True:
            open_ = np.where(ready, sims, -9.0)
            take = min(EXPAND, beam)
            pick = np.argpartition(-open_, take - 1, axis=1)[:, :take]
            good = np.take_along_axis(open_, pick, 1) > -3.0
            live = good.any(axis=1)
            if not live.any():
                break
            act = np.flatnonzero(live)
            pick, good = pick[act], good[act]
            ready[act[:, None], pick] = False
            nodes = np.where(good, ids[act[:, None], pick], -1)
            step = np.where(nodes[:, :, None] >= 0, near[np.maximum(nodes, 0)], -1).reshape(len(act), -1)
            step = np.where((step < 0) | (step >= size), size, step)
            step.sort(axis=1)
            twice = np.zeros(step.shape, bool)
            twice[:, 1:] = step[:, 1:] == step[:, :-1]
            fresh = ~twice & ~seen[act[:, None], step]
            seen[act[:, None], step] = True
            width = int(fresh.sum(axis=1).max(initial=0))
            if width == 0:
                continue
            front = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            step, fresh = np.take_along_axis(step, front, 1), np.take_along_axis(fresh, front, 1)
            s = np.einsum("bmd,bd->bm", self.w[np.minimum(step, size - 1)], q[act])
            s = np.where(fresh, s, -3.0)
            all_ids = np.hstack([ids[act], np.where(fresh, step, -1)])
            all_sims = np.hstack([sims[act], s.astype(np.float32)])
            all_ready = np.hstack([ready[act], fresh])
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[act], sims[act] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            ready[act] = np.take_along_axis(all_ready, best, 1) & (ids[act] >= 0)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def packed(self) -> bytes:
        return pickle.dumps((self.order, self.layers))

    @classmethod
    def unpacked(cls, vectors: np.ndarray, blob: bytes) -> Graph:
        out = cls.__new__(cls)
        out.order, out.layers = pickle.loads(blob)
        out.v, out.w = vectors, vectors[out.order]
        return out


def linked_pairs(queries: np.ndarray, graph: Graph, least: float, same: bool = False):
    """(query, node) pairs whose similarity is about least or more."""
    return audited_pairs(queries, graph, least, same)[:2]


def audited_pairs(queries: np.ndarray, graph: Graph, least: float, same: bool = False):
    """linked_pairs by walks in the graph, with the links that the last audit counted and those of them that the walks found.

    The beam is widened for queries whose beam is full of links, and for all while an audit against brute force finds too
    few.  The audit draws queries until AUDIT of them have links (to others, where same says that the queries are the shard) and
    weighs each of those as one.  Every query walks the graph.  Those whose links fill even a beam of a sixth of the shard are
    multiplied with all of it, as that visits no more, and so are all queries where no beam passes the audit.
    """
    slack = least - 1e-5
    n = len(graph.v)
    drawn = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    rest = np.setdiff1d(np.arange(len(queries)), drawn)
    rest = rest[np.argsort(mix64(rest.astype(np.uint64)), kind="stable")]
    samples, truths, linked = [], [], 0
    for part in (drawn, *(rest[at : at + STRIP] for at in range(0, len(rest), STRIP))):
        true = (queries[part] @ graph.w.T) >= slack
        if same:
            true[part[:, None] == graph.order] = False
        samples.append(part), truths.append(true)
        linked += int(true.any(axis=1).sum())
        if linked >= AUDIT:
            break
    sample = np.concatenate(samples)
    rising = np.argsort(sample)
    sample, truth = sample[rising], np.concatenate(truths)[rising]
    links = truth.sum(axis=1)
    beam = min(BEAM, n)
    while True:
        todo, width = np.arange(len(queries)), beam
        q_out, n_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(todo):
            if width > beam and width * 6 >= n:
                for at in range(0, len(todo), STRIP):
                    i, j = np.nonzero(queries[todo[at : at + STRIP]] @ graph.w.T >= slack)
                    q_out.append(todo[at + i]), n_out.append(j)
                break
            ids, sims = graph.search(queries[todo], width)
            hit = (ids >= 0) & (sims >= slack)
            more = (hit.mean(axis=1) > 0.5) & (width < n)
            i, j = np.nonzero(hit & ~more[:, None])
            q_out.append(todo[i]), n_out.append(ids[i, j])
            todo, width = todo[more], min(width * 4, n)
        q, node = np.concatenate(q_out), np.concatenate(n_out)
        found = np.zeros_like(truth)
        where = np.searchsorted(sample, q)
        inside = (where < len(sample)) & (sample[np.minimum(where, len(sample) - 1)] == q)
        found[where[inside], node[inside]] = True
        hits = (found & truth).sum(axis=1)
        if not links.any() or (hits[links > 0] / links[links > 0]).mean() >= RECALL:
            return q, graph.order[node], int(links.sum()), int(hits.sum())
        if beam >= n:
            break
        beam = min(beam * 2, n)
    parts = [np.nonzero(queries[at : at + STRIP] @ graph.w.T >= slack) for at in range(0, len(queries), STRIP)]
    q = np.concatenate([at * STRIP + i for at, (i, _) in enumerate(parts)])
    return q, graph.order[np.concatenate([j for _, j in parts])], int(links.sum()), int(links.sum())


def shards(rows: DataFrame) -> DataFrame:
    """rows (id, label, vector) packed into shards with their graphs: label, number, dim, n, ids, vectors, graph.

    Rows that repeat id and vector are dropped before they are dealt, so that a shard stays of bounded size.
    """
    rows = rows.dropDuplicates(["label", "id", "vector"])
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("parts"))
    keyed = rows.join(sizes, "label").select("label", F.size("vector").alias("dim"), F.pmod(F.xxhash64("id", "vector"), F.col("parts")).alias("part"), "id", "vector")

    def pack(key, group):
        import pyarrow as pa

        dim = key[1].as_py()
        ids = group.column("id").to_numpy()
        vectors = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
        ids, vectors = ids[new], vectors[new]
        blob = Graph(_unit(vectors)).packed()
        return pa.table({
            "label": pa.array([key[0].as_py()], pa.string()), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
            "ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "graph": [blob]})

    out = keyed.groupBy("label", "dim", "part").applyInArrow(pack, "label string, dim int, n int, ids binary, vectors binary, graph binary")
    return out.withColumn("number", F.monotonically_increasing_id())


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, summed from the first component to the last."""
    dot, x, y = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        dot += a[:, d] * b[:, d]
        x += a[:, d] * a[:, d]
        y += b[:, d] * b[:, d]
    return dot / (np.sqrt(x) * np.sqrt(y))


def verified_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (i of a, j of b; i rising) have a cosine of least or more in double precision.

    Rows with many partners are multiplied as a block; where its rounding could matter, and for all other pairs, components are
    summed one after the other (cosines).
    """
    unit = [x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b)]
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in unit]
    ok = np.zeros(len(i), bool)
    cuts = np.searchsorted(i, np.arange(0, len(a) + STRIP, STRIP))
    for at, (x, y) in enumerate(zip(cuts, cuts[1:])):
        if y - x > STRIP * len(b) // 32:
            value = (unit[0][at * STRIP : (at + 1) * STRIP] @ unit[1].T)[i[x:y] - at * STRIP, j[x:y]]
            ok[x:y] = value >= least
            open_ = x + np.flatnonzero(np.abs(value - least) < 1e-9)
        else:
            open_ = np.arange(x, y)
        for p in range(0, len(open_), 65536):
            part = open_[p : p + 65536]
            ok[part] = cosines(a[i[part]], b[j[part]]) >= least
    return ok


def tile_links(left: dict, right: dict, least: float):
    """Verified links between two shards, or inside one: places (i in left, j in right), each pair once; links audited and found."""
    same = left["number"] == right["number"]
    sides = []
    for s in (left, right) if not same else (left,):
        v = np.frombuffer(s["vectors"], np.float64).reshape(s["n"], s["dim"])
        sides.append((v, _unit(v)))
    lv, lu = sides[0]
    rv, ru = sides[-1]
    q, node, true, hit = audited_pairs(lu, Graph.unpacked(ru, right["graph"]), least, same)
    pairs = [np.stack([q, node], 1)]
    if same:
        pairs = [np.stack([np.minimum(q, node), np.maximum(q, node)], 1)[q != node]]
    else:
        q, node, more_true, more_hit = audited_pairs(ru, Graph.unpacked(lu, left["graph"]), least)
        pairs.append(np.stack([node, q], 1))
        true, hit = true + more_true, hit + more_hit
    code = np.unique(np.concatenate(pairs)[:, 0] * np.int64(len(rv)) + np.concatenate(pairs)[:, 1])
    i, j = code // len(rv), code % len(rv)
    ok = verified_pairs(lv, rv, i, j, least)
    return i[ok], j[ok], true, hit


def forest(a: np.ndarray, b: np.ndarray):
    """Every id of the links (a, b) with the smallest one it reaches through them."""
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    least = np.arange(len(ids))
    while True:
        before = least.copy()
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        least = least[least]
        if (least == before).all():
            return ids, ids[least]


def vector_links(embeddings: DataFrame, least: float, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """Links per pair of shards, united there: id a, the smallest id b that it reaches, its number n of links; for a null, n links audited and b of them found."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    rows = usable_with_label(embeddings.filter(F.col(label_column).isNotNull()), id_column, vector_column, label_column)
    packed = stored(shards(rows), "shards")
    heads = packed.select("label", "dim", "number")
    pairs = heads.select("label", "dim", F.col("number").alias("x")).join(heads.select("label", "dim", F.col("number").alias("y")), ["label", "dim"]).filter("x <= y").select("x", "y")
    columns = ["number", "dim", "n", "ids", "vectors", "graph"]
    side = lambda p, key: packed.select(F.col("number").alias(key), F.struct(*columns).alias(p))
    tiles = pairs.join(side("left", "x"), "x").join(side("right", "y"), "y").select("x", "y", "left", "right").repartition("x", "y").select("left", "right")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                left, right = row["left"], row["right"]
                i, j, true, hit = tile_links(left, right, least)
                a, b = np.frombuffer(left["ids"], np.int64)[i], np.frombuffer(right["ids"], np.int64)[j]
                a, b = a[a != b], b[a != b]
                ids, to = forest(a, b)
                counts = np.bincount(np.searchsorted(ids, np.concatenate([a, b])), minlength=len(ids))
                columns = [pa.array([*ids.tolist(), None], pa.int64()), pa.array(np.append(to, hit), pa.int64()), pa.array(np.append(counts, true), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    found = stored(tiles.mapInArrow(run, "a long, b long, n long"), "links")
    discard(packed)
    return found


def audit(links: DataFrame) -> DataFrame:
    """One row: links that the audits of all pairs of shards counted by brute force, and how many of them the walks found."""
    return links.filter("a IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("audited"), F.coalesce(F.sum("b"), F.lit(0)).alias("found"))


def near_duplicates(embeddings: DataFrame, least: float, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """Per row: id, n_links (other vectors of its label with cosine least or more), component_id, kept.

    Null labels and null, empty, zero or non-finite vectors link with nothing; vectors of different dimension do not
    link.  Rows that repeat id and vector count once; rows that share an id share its links and component;
    rows without an id link with nothing.  Labels of any type compare as text.  A cosine of least itself links.
    An empty table gives no rows; other columns are ignored.
    """
    found = vector_links(embeddings, least, id_column, vector_column, label_column).filter("a IS NOT NULL")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    united = components(found.select("a", "b")).withColumnRenamed("node", "id")
    out = embeddings.select(F.col(id_column).cast("long").alias("id")).join(counts, "id", "left").join(united, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def usable_with_label(rows: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col(id_column).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    return rows.filter(good).select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), v.cast("array<double>").alias("vector"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among vectors of a label at cosine 0.93; rows and edge cases as near_duplicates states."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.93, "vec_id", "embedding", "label")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
