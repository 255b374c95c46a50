"""H5AD: a file made here by the published format, byte by byte, is read back in parts."""

import struct
import zlib

import numpy as np
import pytest

from countloom.sources import h5ad

NONE = 0xFFFFFFFFFFFFFFFF


class Writer:
    """Superblock and headers of the first version: groups by symbol tables, chunks by trees, strings in a global heap."""

    def __init__(self):
        self.data = bytearray(96)

    def put(self, block: bytes) -> int:
        self.data += b"\0" * (-len(self.data) % 8)
        place = len(self.data)
        self.data += block
        return place

    def header(self, messages) -> int:
        up = lambda b: b + b"\0" * (-len(b) % 8)
        body = b"".join(struct.pack("<HHB3x", n, len(up(m)), 0) + up(m) for n, m in messages)
        half = messages[:1] if len(messages) > 3 else None  # longer headers go on elsewhere
        if half:
            first = b"".join(struct.pack("<HHB3x", n, len(up(m)), 0) + up(m) for n, m in half)
            rest = body[len(first):]
            there = self.put(rest)
            body = first + struct.pack("<HHB3xQQ", 0x10, 16, 0, there, len(rest))
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    @staticmethod
    def kind(dtype) -> bytes:
        if dtype == "text":
            return struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)
        d = np.dtype(dtype)
        if d.kind == "S":
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, d.itemsize)
        if d.kind == "f":
            tail = (0, 32, 23, 8, 0, 23, 127) if d.itemsize == 4 else (0, 64, 52, 11, 0, 52, 1023)
            return struct.pack("<BBBBI", 0x11, 0x20, d.itemsize * 8 - 1, 0, d.itemsize) + struct.pack("<HHBBBBI", *tail)
        return struct.pack("<BBBBI", 0x10, 8 if d.kind == "i" else 0, 0, 0, d.itemsize) + struct.pack("<HH", 0, d.itemsize * 8)

    @staticmethod
    def space(shape) -> bytes:
        return struct.pack("<BBBx4x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)

    def texts(self, values) -> bytes:
        objects = b""
        for k, v in enumerate(values, 1):
            v = v.encode()
            objects += struct.pack("<HH4xQ", k, 1, len(v)) + v + b"\0" * (-len(v) % 8)
        size = 16 + len(objects) + 16
        heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, size) + objects + struct.pack("<HH4xQ", 0, 0, 0))
        return b"".join(struct.pack("<IQI", len(v.encode()), heap, k) for k, v in enumerate(values, 1))

    def attribute(self, name, value) -> tuple[int, bytes]:
        if isinstance(value, str):
            kind, shape, data = self.kind("text"), (), self.texts([value])
        else:
            value = np.asarray(value)
            kind, shape, data = self.kind(value.dtype), value.shape, value.tobytes()
        pad = lambda b: b + b"\0" * (-len(b) % 8)
        label = name.encode() + b"\0"
        return 0x0C, struct.pack("<BxHHH", 1, len(label), len(kind), len(self.space(shape))) + pad(label) + pad(kind) + pad(self.space(shape)) + data

    def dataset(self, values, chunk=None, filters=()) -> int:
        text = isinstance(values, list)
        shape = (len(values),) if text else values.shape
        size, kind = (16, self.kind("text")) if text else (values.dtype.itemsize, self.kind(values.dtype))
        messages = [(0x01, self.space(shape)), (0x03, kind)]
        if chunk is None:
            data = self.texts(values) if text else values.tobytes()
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.put(data) if data else NONE, len(data))))
            return self.header(messages)
        raw = np.frombuffer(self.texts(values), np.dtype("V16")) if text else values
        entries = []
        for corner in np.ndindex(*(-(-n // c) for n, c in zip(shape, chunk))):
            corner = tuple(k * c for k, c in zip(corner, chunk))
            block = np.zeros(chunk, raw.dtype)
            part = raw[tuple(slice(a, a + c) for a, c in zip(corner, chunk))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            data = block.tobytes()
            for f in filters:
                data = np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes() if f == 2 else zlib.compress(data)
            entries.append((struct.pack("<II", len(data), 0) + struct.pack(f"<{len(corner) + 1}Q", *corner, 0), self.put(data)))
        last = struct.pack("<II", 0, 0) + struct.pack(f"<{len(shape) + 1}Q", *shape, 0)
        leaves = []
        for a in range(0, len(entries), 3):  # small nodes, so that there is a second level
            part = entries[a : a + 3]
            end = entries[a + 3][0] if a + 3 < len(entries) else last
            leaves.append((part[0][0], self.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(part), NONE, NONE) + b"".join(k + struct.pack("<Q", p) for k, p in part) + end)))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 1, 1, len(leaves), NONE, NONE) + b"".join(k + struct.pack("<Q", p) for k, p in leaves) + last)
        messages.append((0x08, struct.pack("<BBBQ", 3, 2, len(shape) + 1, tree) + struct.pack(f"<{len(chunk) + 1}I", *chunk, size)))
        if filters:
            body = struct.pack("<BB6x", 1, len(filters))
            for f in filters:
                body += struct.pack("<HHHH", f, 0, 0, 1) + struct.pack("<II", size if f == 2 else 4, 0)
            messages.append((0x0B, body))
        return self.header(messages)

    def group(self, members: dict, attributes: dict = {}) -> int:  # noqa: B006
        names, offsets = b"\0" * 8, {}
        for name in sorted(members):
            offsets[name] = len(names)
            names += name.encode() + b"\0"
            names += b"\0" * (-len(names) % 8)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NONE, self.put(names)))
        node = self.put(b"SNOD" + struct.pack("<BxH", 1, len(members)) + b"".join(struct.pack("<QQII16x", offsets[n], members[n], 0, 0) for n in sorted(members)))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NONE, NONE) + struct.pack("<QQQ", 0, node, 0))
        return self.header([(0x11, struct.pack("<QQ", tree, heap)), *(self.attribute(n, v) for n, v in attributes.items())])

    def close(self, root: int, path) -> None:
        self.data[:96] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBBBBxHHI", 0, 0, 0, 0, 0, 8, 8, 4, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(self.data), NONE) + struct.pack("<QQII16x", 0, root, 0, 0)
        path.write_bytes(bytes(self.data))


def sparse(x):
    rows = [np.flatnonzero(r) for r in x]
    return (np.concatenate([r[c] for r, c in zip(x, rows)]), np.concatenate(rows).astype(np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32))


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    rng = np.random.default_rng(2)
    x = (rng.poisson(0.7, (53, 17)) * (rng.random((53, 17)) < 0.6)).astype(np.float32)
    x[7] = 0
    path = tmp_path_factory.mktemp("h5") / "a.h5ad"
    w = Writer()
    cells, genes = [f"cell-{i}é" for i in range(53)], [f"g{j}" for j in range(17)]

    def csr(m, kind, chunk):
        data, indices, indptr = sparse(m)
        parts = {"data": w.dataset(data, (chunk,), (2, 1)), "indices": w.dataset(indices, (chunk,), (1,)), "indptr": w.dataset(indptr)}
        return w.group(parts, {"encoding-type": kind, "encoding-version": "0.1.0", "shape": np.array(x.shape, np.int64)})

    layers = w.group({"counts": csr(np.ascontiguousarray(x.T), "csc_matrix", 11), "dense": w.dataset(x.astype(np.float64), (10, 6), (1,))})
    obs = w.group({"names": w.dataset(cells, (9,), (1,)), "n": w.dataset(np.arange(53, dtype=np.int64))}, {"_index": "names"})
    var = w.group({"_index": w.dataset(np.array(genes, "S4"))})
    w.close(w.group({"X": csr(x, "csr_matrix", 20), "layers": layers, "obs": obs, "var": var}), path)
    return str(path), x, cells, genes


def entries(x, cells, genes):
    return sorted((cells[i], genes[j], float(x[i, j])) for i, j in np.argwhere(x))


def rows(df):
    return sorted((r["cell"], r["gene"], r["count"]) for r in df.collect())


@pytest.mark.parametrize("matrix,parts", [("X", 6), ("layers/counts", 2), ("layers/dense", 6)])
def test_matrices_are_read_in_parts(spark, made, monkeypatch, matrix, parts):
    path, x, cells, genes = made
    df = h5ad.read_h5ad(spark, path, matrix, rows=9)
    assert df.rdd.getNumPartitions() == parts and rows(df) == entries(x, cells, genes)
    assert rows(h5ad.read_h5ad(spark, "file://" + path, matrix)) == entries(x, cells, genes)


def test_fewer_columns_read_less(spark, made, monkeypatch):
    path, x, cells, genes = made
    spark.dataSource.register(h5ad.H5adSource)
    df = spark.read.format("h5ad").schema("count double, cell string").option("rows", 20).load(path)
    assert df.columns == ["count", "cell"] and sorted((r["cell"], r["count"]) for r in df.collect()) == sorted((c, v) for c, _, v in entries(x, cells, genes))
    seen = []
    real = h5ad.Item.slice
    monkeypatch.setattr(h5ad.Item, "slice", lambda self, a, b: seen.append((a, b, self.shape)) or real(self, a, b))
    from pyspark.sql.types import StructType

    reader = h5ad.H5adReader({"path": path, "rows": "20"}, StructType.fromDDL("count double"))
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == np.count_nonzero(x)
    assert all(shape[0] not in (17,) for _, _, shape in seen) and all(b - a <= 21 or shape[0] == np.count_nonzero(x) for a, b, shape in seen)


def test_only_the_chunks_of_a_slice_are_read(made):
    path, x, _, _ = made

    class Counting:
        def __init__(self, stream):
            self.stream, self.bytes = stream, 0

        def seek(self, place):
            self.stream.seek(place)

        def read(self, n):
            self.bytes += n
            return self.stream.read(n)

    with h5ad.opened(path) as stream:
        counting = Counting(stream)
        item = h5ad.Container(counting).find("X/data")
        item.parts, item.shape
        counting.bytes = 0
        few = item.slice(100, 105)
        small = counting.bytes
        everything = item.slice(0, item.shape[0])
    assert np.array_equal(few, sparse(x)[0][100:105]) and np.array_equal(everything, sparse(x)[0]) and small * 3 < counting.bytes - small


def test_what_is_not_known_is_refused(spark, made, tmp_path):
    path, *_ = made
    (tmp_path / "no").write_bytes(b"not a container" * 20)
    for options, why in (({"path": str(tmp_path / "no")}, "signature"), ({"path": path, "matrix": "layers/none"}, "none"), ({"path": path, "matrix": "obs"}, "shape|NoneType|encoding")):
        with pytest.raises(Exception, match=why):
            spark.dataSource.register(h5ad.H5adSource)
            spark.read.format("h5ad").options(**options).load().collect()
    whole = open(path, "rb").read()
    (tmp_path / "torn").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="early|HDF5|tree"):
        h5ad.read_h5ad(spark, str(tmp_path / "torn")).collect()
    with pytest.raises(Exception, match="no column"):
        spark.read.format("h5ad").schema("cell string, other int").load(path).collect()
