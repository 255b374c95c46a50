"""H5AD files as counts: a data source that plans ranges of rows and reads the chunks of a sparse matrix that they need."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Stored entries of an Arrow batch, and rows (or columns) of the major axis in a partition where no option says so.
ENTRIES, ROWS = 1 << 17, 4096
_NONE = 0xFFFFFFFFFFFFFFFF
# Fixed values of the container's published format: numbers of header messages and filters.
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS = 0x01, 0x02, 0x03, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3


class Unsupported(ValueError):
    """A part of the container that this reader does not know."""


class Container:
    """An HDF5 file behind a seekable stream: groups, attributes, and slices of one-dimensional data."""

    def __init__(self, stream):
        self.stream = stream
        head = self.at(0, 96)
        if head[:8] != b"\x89HDF\r\n\x1a\n":
            raise Unsupported("no HDF5 signature at the start")
        version = head[8]
        if version > 3:
            raise Unsupported(f"superblock version {version}")
        sizes = head[13:15] if version < 2 else head[9:11]
        if sizes != b"\x08\x08":
            raise Unsupported("addresses and lengths are not of eight bytes")
        self.root = struct.unpack_from("<Q", head, 64 + 4 * (version == 1) if version < 2 else 36)[0]

    def at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        out = self.stream.read(size)
        return out if place == 0 else self._whole(out, size)

    @staticmethod
    def _whole(data: bytes, size: int) -> bytes:
        if len(data) < size:
            raise Unsupported("the file ends too early")
        return data

    def messages(self, place: int):
        """(number, bytes) of the messages of an object's header, continuations included."""
        head = self.at(place, 16)
        if head[:4] == b"OHDR":
            flags = head[5]
            skip = 6 + 16 * bool(flags & 32) + 4 * bool(flags & 16)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.at(place + skip, width), "little")
            blocks, step = [(place + skip + width, size)], 4 + 2 * bool(flags & 4)
            while blocks:
                begin, size = blocks.pop(0)
                data, p = self.at(begin, size), 0
                while p + step <= size:
                    number, length = data[p], struct.unpack_from("<H", data, p + 1)[0]
                    body = data[p + step : p + step + length]
                    if number == CONTINUATION:
                        to, n = struct.unpack_from("<QQ", body)
                        blocks.append((to + 4, n - 8))  # between its signature and its checksum
                    else:
                        yield number, body
                    p += step + length
            return
        if head[0] != 1:
            raise Unsupported(f"object header version {head[0]}")
        blocks = [(place + 16, struct.unpack_from("<I", head, 8)[0])]
        while blocks:
            begin, size = blocks.pop(0)
            data, p = self.at(begin, size), 0
            while p + 8 <= size:
                number, length = struct.unpack_from("<HH", data, p)
                body = data[p + 8 : p + 8 + length]
                if number == CONTINUATION:
                    blocks.append(struct.unpack_from("<QQ", body))
                else:
                    yield number, body
                p += 8 + length

    def members(self, place: int) -> dict[str, int]:
        """Names and header places of a group's members."""
        out: dict[str, int] = {}
        for number, body in self.messages(place):
            if number == SYMBOLS:
                tree, heap = struct.unpack_from("<QQ", body)
                size, _, data = struct.unpack_from("<QQQ", self.at(heap, 32), 8)
                names = self.at(data, size)
                for node in self._leaves(tree, 0, 8):
                    count = struct.unpack_from("<H", self.at(node, 8), 6)[0]
                    entries = self.at(node + 8, 40 * count)
                    for k in range(count):
                        name, header = struct.unpack_from("<QQ", entries, 40 * k)
                        out[names[name : names.index(b"\0", name)].decode()] = header
            elif number == LINK:
                flags, p = body[1], 2
                kind = body[p] if flags & 8 else 0
                p += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[p : p + width], "little")
                if kind == 0:
                    out[body[p + width : p + width + n].decode()] = struct.unpack_from("<Q", body, p + width + n)[0]
            elif number == LINK_INFO and struct.unpack_from("<Q", body, 2 + 8 * (body[1] & 1))[0] != _NONE:
                raise Unsupported("links of a large group in a heap of their own")
        return out

    def _leaves(self, place: int, kind: int, key: int, wanted=lambda key: True):
        """Children at the bottom of a tree of the first version; for chunks with their keys."""
        if place == _NONE:
            return
        head = self.at(place, 24)
        if head[:4] != b"TREE" or head[4] != kind:
            raise Unsupported("not the tree that was expected")
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        body = self.at(place + 24, n * (key + 8) + key)
        keys = [body[k * (key + 8) : k * (key + 8) + key] for k in range(n + 1)]
        for k in range(n):
            if not wanted((keys[k], keys[k + 1])):
                continue
            child = struct.unpack_from("<Q", body, k * (key + 8) + key)[0]
            if level:
                yield from self._leaves(child, kind, key, wanted)
            else:
                yield (keys[k], child) if kind else child

    def find(self, path: str) -> Item:
        place = self.root
        for name in filter(None, path.split("/")):
            members = self.members(place)
            if name not in members:
                raise KeyError(path)
            place = members[name]
        return Item(self, place)


def _dimensions(body: bytes) -> tuple[int, ...]:
    rank = body[1]
    return struct.unpack_from(f"<{rank}Q", body, 8 if body[0] == 1 else 4) if rank else ()


@dataclass
class Kind:
    """How elements are stored: a numpy type, or strings of variable length."""

    size: int
    dtype: str | None
    text: bool = False

    @classmethod
    def read(cls, body: bytes) -> Kind:
        number, flags, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
        order = ">" if flags & 1 else "<"
        if number == 0:
            return cls(size, f"{order}{'i' if flags & 8 else 'u'}{size}")
        if number == 1:
            return cls(size, f"{order}f{size}")
        if number == 3:
            return cls(size, f"S{size}")
        if number == 8:
            return cls.read(body[8:])  # an enumeration counts as its numbers
        if number == 9 and flags & 15 == 1:
            return cls(size, None, True)
        raise Unsupported(f"datatype class {number}")


class Item:
    """A group or a dataset."""

    def __init__(self, file: Container, place: int):
        self.file, self.place = file, place

    @cached_property
    def parts(self) -> dict[int, bytes]:
        return {n: body for n, body in self.file.messages(self.place) if n != ATTRIBUTE}

    @cached_property
    def attributes(self) -> dict[str, object]:
        out = {}
        for number, body in self.file.messages(self.place):
            if number == ATTRIBUTE:
                version = body[0]
                n, kind, space = struct.unpack_from("<HHH", body, 2)
                up = (lambda x: -(-x // 8) * 8) if version == 1 else (lambda x: x)
                p = 8 + (version == 3)
                name = body[p : p + n].rstrip(b"\0").decode()
                p += up(n)
                stored = Kind.read(body[p : p + kind])
                p += up(kind)
                shape = _dimensions(body[p : p + space])
                values = self._decoded(body[p + up(space) :], int(np.prod(shape)), stored)
                out[name] = values if shape else values[0]
        return out

    @property
    def is_group(self) -> bool:
        return LAYOUT not in self.parts

    @cached_property
    def shape(self) -> tuple[int, ...]:
        return _dimensions(self.parts[DATASPACE])

    @cached_property
    def kind(self) -> Kind:
        return Kind.read(self.parts[DATATYPE])

    def _decoded(self, data: bytes, n: int, kind: Kind):
        if not kind.text:
            out = np.frombuffer(data, kind.dtype, n)
            return [x.split(b"\0")[0].decode() for x in out.tolist()] if kind.dtype.startswith("S") else out
        heaps: dict[int, dict[int, bytes]] = {}
        out = []
        for k in range(n):
            size, heap, index = struct.unpack_from("<IQI", data, 16 * k)
            if heap not in heaps and heap not in (0, _NONE):
                heaps[heap] = self._heap(heap)
            out.append(heaps[heap][index][:size].decode() if heap in heaps and size else "")
        return out

    def _heap(self, place: int) -> dict[int, bytes]:
        size = struct.unpack_from("<Q", self.file.at(place, 16), 8)[0]
        data, p, out = self.file.at(place, size), 16, {}
        while p + 16 <= size:
            index, length = struct.unpack_from("<H6xQ", data, p)
            if index == 0:
                break
            out[index] = data[p + 16 : p + 16 + length]
            p += 16 + -(-length // 8) * 8
        return out

    def _filters(self) -> list[tuple[int, tuple[int, ...]]]:
        body = self.parts.get(FILTERS)
        if body is None:
            return []
        out, p, version = [], 8 if body[0] == 1 else 2, body[0]
        for _ in range(body[1]):
            number = struct.unpack_from("<H", body, p)[0]
            named = version == 1 or number >= 256
            name = struct.unpack_from("<H", body, p + 2)[0] if named else 0
            p += 4 if named else 2
            values = struct.unpack_from("<H", body, p + 2)[0]
            p += 4 + (-(-name // 8) * 8 if version == 1 else name)
            out.append((number, struct.unpack_from(f"<{values}I", body, p)))
            p += 4 * values + 4 * (version == 1 and values % 2)
        return out

    def slice(self, begin: int, end: int):
        """Rows begin to end of a dataset: only the chunks that hold them are read."""
        layout, width = self.parts[LAYOUT], int(np.prod(self.shape[1:]))
        end = min(end, self.shape[0])
        n, row = max(0, end - begin), self.kind.size * width
        if n == 0:
            return [] if self.kind.text or self.kind.dtype.startswith("S") else np.zeros((0, *self.shape[1:]), self.kind.dtype)
        if layout[0] != 3:
            raise Unsupported(f"data layout version {layout[0]}")
        if layout[1] == 0:
            raw = layout[4 + begin * row : 4 + end * row]
        elif layout[1] == 1:
            place = struct.unpack_from("<Q", layout, 2)[0]
            raw = b"\0" * (n * row) if place == _NONE else self.file.at(place + begin * row, n * row)
        else:
            raw = self._chunks(layout, begin, end)
        values = self._decoded(raw, n * width, self.kind)
        return values.reshape(n, *self.shape[1:]) if isinstance(values, np.ndarray) and len(self.shape) > 1 else values

    def _chunks(self, layout: bytes, begin: int, end: int) -> bytes:
        rank = layout[2] - 1
        tree = struct.unpack_from("<Q", layout, 3)[0]
        edge = struct.unpack_from(f"<{rank}I", layout, 11)
        out = np.zeros((end - begin, *self.shape[1:], self.kind.size), np.uint8)
        first = lambda key: struct.unpack_from("<Q", key, 8)[0]
        for key, place in self.file._leaves(tree, 1, 8 + 8 * (rank + 1), lambda k: first(k[0]) < end and first(k[1]) + edge[0] > begin):
            size, skipped = struct.unpack_from("<II", key)
            corner = struct.unpack_from(f"<{rank}Q", key, 8)
            if corner[0] >= end or corner[0] + edge[0] <= begin:
                continue
            data = self.file.at(place, size)
            for n, (number, values) in reversed(list(enumerate(self._filters()))):
                if skipped >> n & 1:
                    continue
                if number == DEFLATE:
                    data = zlib.decompress(data)
                elif number == SHUFFLE:
                    data = np.frombuffer(data, np.uint8).reshape(values[0], -1).T.tobytes()
                elif number == CHECKSUM:
                    data = data[:-4]
                else:
                    raise Unsupported(f"filter {number}")
            block = np.frombuffer(data, np.uint8).reshape(*edge, self.kind.size)
            at = [slice(max(0, begin - corner[0]), min(edge[0], end - corner[0]))]
            to = [slice(max(0, corner[0] - begin), max(0, corner[0] - begin) + at[0].stop - at[0].start)]
            for axis in range(1, rank):
                keep = min(edge[axis], self.shape[axis] - corner[axis])
                at.append(slice(0, keep))
                to.append(slice(corner[axis], corner[axis] + keep))
            out[tuple(to)] = block[tuple(at)]
        return out.tobytes()


# ---------------------------------------------------------------- the data source

def opened(path: str):
    """A seekable stream of a plain path or of an address that pyarrow's file systems know."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def _names(file: Container, frame: str) -> Item:
    """The index column of obs or var."""
    group = file.find(frame)
    if not group.is_group:
        raise Unsupported(f"{frame} is a table of an older layout")
    name = group.attributes.get("_index", "_index")
    return file.find(f"{frame}/{name}")


@dataclass
class Matrix:
    item: Item
    sparse: bool
    by_cell: bool
    shape: tuple[int, int]

    @classmethod
    def of(cls, file: Container, path: str) -> Matrix:
        item = file.find(path)
        if not item.is_group:
            return cls(item, False, True, (item.shape[0], item.shape[1]))
        found = item.attributes
        kind = str(found.get("encoding-type", found.get("h5sparse_format", "csr"))).split("_")[0]
        if kind not in ("csr", "csc"):
            raise Unsupported(f"encoding {kind}")
        shape = found.get("shape", found.get("h5sparse_shape"))
        return cls(item, True, kind == "csr", (int(shape[0]), int(shape[1])))

    @property
    def major(self) -> int:
        return self.shape[0 if self.by_cell else 1]


@dataclass
class Rows(InputPartition):
    """Rows begin to end of the major axis: cells, or genes where the matrix is stored by gene."""

    begin: int
    end: int

    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class H5adSource(DataSource):
    """Format "h5ad": cell, gene, count of the stored entries.

    Options: path; matrix (X, layers/counts, raw/X); rows, how many cells (or genes) a partition takes.  A schema of fewer
    columns reads only what they need.  Zeros that are stored come as such; values that are not numbers come as NaN.
    """

    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def schema(self) -> str:
        return "cell string, gene string, count double"

    def reader(self, schema) -> DataSourceReader:
        return H5adReader(dict(self.options), schema)


class H5adReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        options = {k.lower(): v for k, v in options.items()}
        if "path" not in options:
            raise ValueError("h5ad needs a path")
        self.path, self.matrix, self.rows = options["path"], options.get("matrix", "X"), int(options.get("rows", ROWS))
        self.fields = [f.name for f in schema.fields]
        unknown = set(self.fields) - {"cell", "gene", "count"}
        if unknown:
            raise ValueError(f"h5ad has no column {', '.join(sorted(unknown))}")

    def partitions(self):
        with opened(self.path) as stream:
            n = Matrix.of(Container(stream), self.matrix).major
        return [Rows(a, min(a + self.rows, n)) for a in range(0, n, self.rows)] or [Rows(0, 0)]

    def read(self, part: Rows):
        import pyarrow as pa

        with opened(self.path) as stream:
            file = Container(stream)
            m = Matrix.of(file, self.matrix)
            frames = {"cell": "obs", "gene": "raw/var" if self.matrix.startswith("raw/") else "var"}
            major, minor = ("cell", "gene") if m.by_cell else ("gene", "cell")
            own = _names(file, frames[major]).slice(part.begin, part.end) if major in self.fields else None
            column = _names(file, frames[minor])
            others = pa.array(column.slice(0, column.shape[0]), pa.string()) if minor in self.fields else None

            def batch(row, col, value):
                made = {major: lambda: pa.array(own, pa.string()).take(pa.array(row)), minor: lambda: others.take(pa.array(col)), "count": lambda: pa.array(value.astype(np.float64))}
                return pa.RecordBatch.from_arrays([made[f]() for f in self.fields], names=self.fields)

            if not m.sparse:
                step = max(1, ENTRIES // max(1, m.shape[1]))
                for a in range(part.begin, part.end, step):
                    block = m.item.slice(a, min(a + step, part.end))
                    row, col = np.nonzero(block)
                    yield batch(row + a - part.begin, col, block[row, col])
                return
            if part.end == part.begin:
                return
            inner = {name: file.find(f"{self.matrix}/{name}") for name in ("indptr", "indices", "data")}
            bounds = inner["indptr"].slice(part.begin, part.end + 1).astype(np.int64)
            for a in range(int(bounds[0]), int(bounds[-1]), ENTRIES):
                b = min(a + ENTRIES, int(bounds[-1]))
                row = np.searchsorted(bounds, np.arange(a, b), side="right") - 1 if own is not None else None
                col = inner["indices"].slice(a, b).astype(np.int64) if others is not None else None
                value = inner["data"].slice(a, b) if "count" in self.fields else np.zeros(b - a)
                yield batch(row, col, value)


def read_h5ad(spark: SparkSession, path: str, matrix: str = "X", rows: int = ROWS) -> DataFrame:
    """cell, gene, count of an H5AD file."""
    spark.dataSource.register(H5adSource)
    return spark.read.format("h5ad").option("matrix", matrix).option("rows", rows).load(path)
