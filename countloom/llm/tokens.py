"""Byte-level BPE encoding and decoding by overlapping chunks, and token files in ORC."""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.llm.common import as_text, scratch, slices, stored, table, worker_cache

#: A cut before a space is a pre-token boundary unless white space stands before it.
_UNSAFE = re.compile(r"[\s\x1c-\x1f\x85] ")
#: Characters of a chunk and of what it shares with the next; characters and boundaries at its end that may change with what follows.
CHUNK, OVERLAP, LAST, OPEN = 1 << 15, 1 << 10, 64, 3
#: Units that the token writer keeps (tens of bytes each), and pre-tokens that the encoder does.
UNITS, CACHE = 1_000_000, 200_000


def split_units(text: str) -> list[str] | None:
    """text cut before every space; None where such a cut may fall inside a pre-token."""
    if text[:1] == " " or text[-1:] == " " or _UNSAFE.search(text):
        return None
    return text.split(" ")


def chunks(text: str, size: int, overlap: int):
    """(number, place where it begins, chunk, whether it is the last): overlapping pieces, in one pass."""
    at = range(0, max(1, len(text) - overlap), size - overlap)
    for number, begin in enumerate(at):
        yield number, begin, text[begin : begin + size], number == len(at) - 1


def boundaries(chunk: str, begin: int, last: bool, pattern) -> list[int]:
    """Ends of the pre-tokens of a chunk, as places in the whole text, as far as what follows the chunk cannot move them."""
    ends = [m.end() for m in pattern.finditer(chunk)]
    if not last:
        ends = [e for e in ends[:-OPEN] if e <= len(chunk) - LAST]
    return [begin + e for e in ends]


def meeting(before: list[int], after: list[int]) -> int | None:
    """First boundary that two neighbouring chunks share.

    Pre-tokenising is a scan without memory, so from there on the later chunk has the whole text's boundaries if the
    earlier one has them there.
    """
    shared = set(before)
    return next((b for b in after if b in shared), None)


class _Pieces(dict):
    """Packed ids of a pre-token; forgets all when full, so that memory stays bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, key: str) -> bytes:
        packed = self.encode(key)
        if len(key) <= 64:  # longer ones hardly come again
            if len(self) >= CACHE:
                self.clear()
            self[key] = packed
        return packed


class ByteBpe:
    """Ranks of a .tiktoken file: encode(text) gives packed little-endian ids, decode(ids) raw bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        single = self.encoding._encode_single_piece

        def packed(piece: str) -> bytes:
            ids = single(piece.encode())
            return struct.pack(f"<{len(ids)}I", *ids)

        self.plain = _Pieces(packed)

    def pieces(self, text: str, begin: int = 0, end: int | None = None) -> bytes:
        """Packed ids of text from one boundary of pre-tokens to another."""
        found = self.pattern.findall(text, begin, len(text) if end is None else end)
        return b"".join(map(self.plain.__getitem__, found))

    def encode(self, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """Packed ids of a whole text: what encode_documents does with its chunks, in one place."""
        parts = list(chunks(text, size, overlap))
        found = [boundaries(chunk, begin, last, self.pattern) for _, begin, chunk, last in parts]
        meets = [meeting(x, y) for x, y in zip(found, found[1:])]
        if None in meets:  # one pre-token fills an overlap
            return self.pieces(text)
        cuts = [0, *meets, len(text)]
        return b"".join(self.pieces(chunk, a - begin, b - begin) for (_, begin, chunk, _), a, b in zip(parts, cuts, cuts[1:]))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _coder(path: str, pattern: str) -> ByteBpe:
    return worker_cache(f"bpe-{path}", lambda: ByteBpe(path, pattern))


def long_texts(source: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """id, ids, decoded of texts of several chunks, which are dealt over all tasks.

    The chunks are written once, so that row numbers are settled.  Every chunk is pre-tokenised by itself; it and
    the one before it meet at the first boundary that both found in their overlap, and a chunk's pieces are those between its two
    meetings.  A text with neighbours that never meet (a pre-token as long as an overlap) is put together and encoded whole.
    """
    import pyarrow as pa

    spark = source.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(batches):
        for batch in slices(batches, 2):
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for at in chunks(text, size, overlap):
                    yield pa.RecordBatch.from_arrays([pa.array([v]) if v is not None else pa.array([None], pa.int64()) for v in (row, doc, *at)], ["row", "id", "number", "begin", "chunk", "last"])

    numbered = source.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    schema = "row long, id long, number long, begin long, chunk string, last boolean"
    pieces = stored(numbered.mapInArrow(cut, schema).repartition(parts, "row", "number"), "chunks")

    def ends(batches):
        coder = _coder(path, pattern)
        for batch in batches:
            rows, numbers, heads, tails = [], [], [], []
            for row, _, number, begin, chunk, last in zip(*(c.to_pylist() for c in batch.columns)):
                found = boundaries(chunk, begin, last, coder.pattern)
                rows.append(row), numbers.append(number)
                heads.append([e for e in found if e <= begin + overlap]), tails.append([e for e in found if e > begin + len(chunk) - overlap])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((rows, numbers, heads, tails), kinds)], ["row", "number", "head", "tail"])

    order = W.partitionBy("row").orderBy("number")
    met = pieces.mapInArrow(ends, "row long, number long, head array<long>, tail array<long>")
    met = met.withColumn("from", F.when(F.col("number") > 0, F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))).otherwise(0))
    met = met.withColumn("to", F.lead("from").over(order)).withColumn("whole", F.max(F.col("from").isNull()).over(W.partitionBy("row")))
    dealt = pieces.join(met.select("row", "number", "from", "to", "whole"), ["row", "number"])

    def encode(batches):
        coder = _coder(path, pattern)
        for batch in batches:
            out = [[], [], [], []]
            for begin, chunk, last, a, b, whole in zip(*(c.to_pylist() for c in batch.columns[3:])):
                if whole:
                    ids, raw = None, chunk if last else chunk[: size - overlap]
                else:
                    ids, raw = coder.pieces(chunk, a - begin, len(chunk) if last else b - begin), None
                for column, value in zip(out, (ids, None if ids is None else coder.decode(ids), raw, whole)):
                    column.append(value)
            kinds = [pa.binary(), pa.binary(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(out, kinds))], ["row", "number", "id", "ids", "decoded", "raw", "whole"])

    coded = dealt.select("row", "number", "id", "begin", "chunk", "last", "from", "to", "whole").mapInArrow(
        encode, "row long, number long, id long, ids binary, decoded binary, raw string, whole boolean")

    def joined(batches):
        coder = _coder(path, pattern)

        def flush(doc, held, whole):
            ids, decoded = (b"".join(h[i] for h in held) for i in (0, 1)) if not whole else (None, None)
            if whole:
                ids = coder.pieces("".join(h[2] for h in held))
                decoded = coder.decode(ids)
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids], pa.binary()), pa.array([decoded], pa.binary())], ["id", "ids", "decoded"])

        current, held = None, []
        for batch in batches:
            for row, _, doc, ids, decoded, raw, whole in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row != current[0]:
                    yield flush(current[1], held, current[2])
                    held = []
                current = (row, doc, whole)
                held.append((ids, decoded, raw))
        if held:
            yield flush(current[1], held, current[2])

    return coded.repartition(parts, "row").sortWithinPartitions("row", "number").mapInArrow(joined, "id long, ids binary, decoded binary")


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: id, ids (packed little-endian unsigned 32-bit) and decoded (raw bytes).

    Texts are cut into overlapping chunks; a text of one chunk is encoded where it is read, the chunks of longer ones
    everywhere (long_texts).  Null texts are empty and have no ids; repeated rows and ids give repeated results; rows
    without an id are encoded too; an empty table gives no rows; other columns are ignored.
    """
    def run(batches):
        import pyarrow as pa

        coder = _coder(path, pattern)
        for batch in slices(batches, 1):
            ids = [coder.pieces(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([coder.decode(i) for i in ids], pa.binary())],
                ["id", "ids", "decoded"],
            )

    source = as_text(docs.select(F.col(id_column).cast("long").alias("id"), "text"))
    out = source.filter(F.char_length("text") <= size).mapInArrow(run, "id long, ids binary, decoded binary")
    long = source.filter(F.char_length("text") > size)
    return out.union(long_texts(long, path, pattern, size, overlap)).withColumnRenamed("id", id_column)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    return digests(encode_documents(table(spark, sf_dir, "documents"), *multi_ranks()))


def multi_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# ---------------------------------------------------------------- token files

def _id_lists(blobs: list[bytes]):
    """Packed ids as an Arrow list column."""
    import pyarrow as pa

    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


class JsonTokenizer:
    """ids of texts by a tokenizers file.  What a unit between spaces gives is kept in Arrow columns; only new units reach the library."""

    JOINED = 512

    def __init__(self, path: str):
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = self.tokenizer.get_vocab()
        # a byte-level token has one character a byte
        self.lengths = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, i in tokens.items():
            self.lengths[i] = len(token)
        self.known, self.ids = pa.array([], pa.string()), _id_lists([])

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _units(self, words: list[str]) -> list[bytes]:
        """ids of every word with a space before it, many in one call: the tokens' bytes tell where each ends."""
        out = []
        groups = [words[at : at + self.JOINED] for at in range(0, len(words), self.JOINED)]
        for group, ids in zip(groups, self._library([" " + " ".join(g) for g in groups])):
            ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
            wanted = np.cumsum([len(w.encode()) + 1 for w in group])
            cuts = np.searchsorted(ends, wanted) + 1
            if len(ends) == 0 or ends[-1] != wanted[-1] or (ends[cuts - 1] != wanted).any():
                out += self._library([" " + w for w in group])
                continue
            at = [0, *(cuts * 4).tolist()]
            out += [ids[a:b] for a, b in zip(at, at[1:])]
        return out

    def _places(self, words):
        """(id lists, place in them of each of the distinct words); all that is kept beyond UNITS gives way to the words at hand."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(found))
        place = np.asarray(found.fill_null(-1)).astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        if len(new):
            self.known = pa.concat_arrays([self.known, new])
            self.ids = pa.concat_arrays([self.ids, _id_lists(self._units(new.to_pylist()))])
        lists = self.ids
        if len(self.known) > UNITS:
            self.known, self.ids = words, lists.take(pa.array(place))
        return lists, place

    def encode(self, column, end_id: int | None = None):
        """(bounds, ids) of an Arrow column of texts without nulls, each text's ids followed by end_id.

        Texts are cut before spaces and only distinct pieces are looked up; ids are then gathered piece by piece.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = column.to_pylist()
        # the library looks for its added tokens before anything else, so texts that hold one go to it whole
        cut = np.array([not (any(a in t for a in self.added) or t[:1] == " " or t[-1:] == " " or _UNSAFE.search(t)) for t in texts], bool)
        lists = pc.split_pattern(column.filter(pa.array(cut)), " ")
        at = np.asarray(lists.offsets).astype(np.int64)
        at -= at[0] if len(at) else 0
        rest = np.ones(int(at[-1]) if len(at) else 0, bool)
        rest[at[:-1]] = False
        pieces = lists.flatten()
        coded = pieces.filter(pa.array(rest)).dictionary_encode()
        first = iter(pieces.take(pa.array(at[:-1])).to_pylist())
        # heads of cut texts and whole other texts go to the library as they are
        single = self._library([next(first) if c else t for c, t in zip(cut.tolist(), texts)])
        kept, place = self._places(coded.dictionary)
        store = pa.concat_arrays([kept, _id_lists([*single, b"" if end_id is None else np.array([end_id], "<u4").tobytes()])])
        # segments of every text: its head or whole, its other pieces, the end
        count = np.full(len(texts), 2)
        count[cut] += np.diff(at) - 1
        begin = np.cumsum(count) - count
        segment = np.empty(int(count.sum()), np.int64)
        inner = np.ones(len(segment), bool)
        inner[begin] = inner[begin + count - 1] = False
        segment[begin] = len(kept) + np.arange(len(texts))
        segment[begin + count - 1] = len(store) - 1
        segment[inner] = place[np.asarray(coded.indices)]
        lists = store.take(pa.array(segment))
        bounds = np.asarray(lists.offsets).astype(np.int64)
        return bounds[np.append(begin, len(segment))], lists.flatten().to_numpy()


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None, id_column: str = "doc_id", stride: int = 1000, stripe: int = 16 << 20) -> None:
    """Writes (doc_id, ids) in ascending doc_id order as ORC.

    The format packs ids with its integer run-length encoding, keeps row indexes for every `stride` rows of a stripe and
    Bloom filters on doc_id; files and stripes can be read in parallel, and a lookup of one doc_id (look_up) reads
    metadata first.  Null texts are empty and hold the end id alone; rows with equal ids keep any order among themselves, rows
    without an id come first; an empty table gives files without rows.
    """
    spark = docs.sparkSession

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = worker_cache(f"json-{tokenizer}", lambda: JsonTokenizer(tokenizer))
        for batch in slices(batches, 1, 4 << 20):
            bounds, values = coder.encode(batch.column(1), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))], ["doc_id", "ids"])

    source = as_text(docs.select(F.col(id_column).cast("long").alias("doc_id"), "text"))
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "doc_id long, ids array<int>")
    (coded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true")
     .option("orc.stripe.size", str(stripe)).option("orc.row.index.stride", str(stride)).orc(path))


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def look_up(spark: SparkSession, path: str, *doc_ids: int) -> DataFrame:
    """The rows of some documents: stripes and row groups whose statistics or Bloom filter exclude all of them are not read."""
    return read_token_orc(spark, path).filter(F.col("doc_id").isin(*doc_ids))


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """Per document of token files: doc_id, start, n_tokens, ids_crc32.

    Files hold disjoint ranges of doc_id in ascending order, so a document's start is the sum over the
    files before its own, one row each, and the running sum within its file, taken in file order.
    """
    rows = read_token_orc(spark, path)

    def lengths(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            column = batch.column(1)
            bounds = np.asarray(column.offsets)
            values = np.asarray(column.values).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(2)],
                ["doc_id", "n_tokens", "ids_crc32", "file"],
            )

    named = rows.withColumn("file", F.input_file_name())
    return named.mapInArrow(lengths, "doc_id long, n_tokens long, ids_crc32 long, file string")


def token_index(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id") -> DataFrame:
    """Writes docs as token files, reads them back and returns doc_id, start, n_tokens and ids_crc32 of every row.

    Rows that repeat an id follow each other by checksum and length; rows without an id come first; null and empty texts
    hold the end id alone; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_token_orc(docs, path, tokenizer, end_id, id_column=id_column)
    spans = stored(token_spans(spark, path), "spans")
    # one row a file: the files' order is that of their first documents
    files = spans.groupBy("file").agg(F.coalesce(F.min("doc_id"), F.lit(-(1 << 63))).alias("first_id"), F.sum("n_tokens").alias("held"))
    files = files.withColumn("before", F.sum("held").over(W.orderBy("first_id", "file").rowsBetween(W.unboundedPreceding, -1)))
    inside = W.partitionBy("file").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    return (
        spans.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(files.select("file", F.coalesce("before", F.lit(0)).alias("before")), "file")
        .select("doc_id", (F.col("before") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document in the token files; rows and edge cases as token_index states."""
    import public_tokenizers

    return token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
