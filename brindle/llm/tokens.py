"""Token ids in bit-packed shard files.

A shard file holds the ids of a run of documents in order of their ids.  Each id takes the
fewest bits that the vocabulary needs; ids are packed in blocks of BLOCK ids whose byte
offsets the index lists, so that numpy unpacks any range without reading the rest:

    magic | blocks | index | length of the index (8 bytes) | magic

The index is a small Arrow table of documents (id, end) with bits, ids and block offsets
in its metadata.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut, fresh_dir
from .words import blocks, hash_spans, text_bytes, unique_inverse

MAGIC = b"BRBP"
BLOCK = 1 << 16
#: Longest piece (bytes) and most pieces that a worker remembers the ids of.
CACHED_BYTES, CACHED = 64, 1_000_000
#: Bytes of input to a shard, about; there are at least as many shards as shuffle partitions.
SHARD_BYTES = 256 << 20


# ---- bit packing


def width_of(vocabulary: int) -> int:
    """Bits of an id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, the lowest bit first; eight ids take `bits` bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    rows.ravel()[: len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = rows[:, k] << np.uint64(shift)
        for j in range(-(-(bits + shift) // 8)):
            out[:, byte + j] |= ((value >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    raw = np.frombuffer(data, np.uint8)
    full = np.zeros(-(-n // 8) * bits, np.uint8)
    full[: min(len(raw), len(full))] = raw[: len(full)]
    rows = full.reshape(-1, bits)
    out = np.zeros((len(rows), 8), np.uint64)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        for j in range(-(-(bits + shift) // 8)):
            out[:, k] |= rows[:, byte + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] >>= np.uint64(shift)
    return (out.ravel()[:n] & np.uint64((1 << bits) - 1)).astype(np.uint32)


# ---- encoding


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space characters, Unicode's too."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    white = table[data]
    for lead, tails in ((0xC2, (b"\x85", b"\xa0")), (0xE1, (b"\x9a\x80",)), (0xE2, (*(bytes((0x80, b)) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f")), (0xE3, (b"\x80\x80",))):
        at = np.flatnonzero(data == lead)
        for tail in tails:
            own = at[at + len(tail) < len(data)]
            for k, byte in enumerate(tail):
                own = own[data[own + 1 + k] == byte]
            for k in range(len(tail) + 1):
                white[own + k] = True
    return white


_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces that a byte-level tokenizer encodes alike alone or in the text.

    A piece begins at a row's start, at a lone ASCII white space character between others,
    and at ASCII punctuation after an ASCII letter or digit: places where the tokenizer's
    own split always cuts.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = _white(data)
    first = np.zeros(len(data) + 1, bool)
    first[offs[:-1]] = True
    first[len(data)] = True
    row_start = first.copy()
    inner = white[1:-1] & (data[1:-1] < 0x80) & ~white[:-2] & ~white[2:] & ~row_start[1:-2] & ~row_start[2:-1]
    first[1 : len(data) - 1] |= inner
    first[1 : len(data)] |= _PUNCT[data[1:]] & _WORDLIKE[data[:-1]] & ~row_start[1 : len(data)]
    at = np.flatnonzero(first)
    return at[:-1], at[1:]


class Encoder:
    """A tokenizer, as its file has it, with a memory of pieces it has met.

    Strings of its added tokens in a text are pieces of their own, so they get their one id
    and what stands beside them is encoded as the library does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        #: Tokens that take white space or only stand alone can't be cut out; texts are then encoded whole.
        self.whole = any(t.lstrip or t.rstrip or t.single_word for t in added)
        longest_first = sorted((t.content.encode() for t in added), key=lambda t: (-len(t), t))
        self.added = re.compile(b"|".join(map(re.escape, longest_first))) if added else None
        self.forget()

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of added tokens, and of the pieces of what stands between them."""
        raw = data.tobytes()
        if self.whole:
            full = np.flatnonzero(np.diff(offs))
            return offs[full], offs[full + 1]
        if self.added is None or not self.added.search(raw):
            return pieces(data, offs)
        found = np.array([m.span() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()) for m in self.added.finditer(raw, a, b)], np.int64).reshape(-1, 2)
        starts, _ = pieces(data, np.unique(np.concatenate((offs, found.ravel()))))
        at = np.searchsorted(found[:, 0], starts, side="left") - 1  # the last token that begins before
        starts = starts[(at < 0) | (starts >= np.append(found[:, 1], 0)[at])]
        return starts, np.append(starts[1:], len(data))

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.many = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        got = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())], add_special_tokens=False)
        ids = [e.ids for e in got]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        fresh = np.fromiter((x for i in ids for x in i), np.uint32, int(many.sum()))
        at = len(self.flat) + np.cumsum(many) - many
        self.flat = np.concatenate((self.flat, fresh))
        known = np.concatenate((self.known, h))
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.many = known[order], np.concatenate((self.at, at))[order], np.concatenate((self.many, many))[order]

    def encode(self, column, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, `end` after each, and how many each has."""
        data, offs = text_bytes(column)
        starts, ends = self.pieces(data, offs)
        h = hash_spans(data, starts, ends)
        distinct, first, inverse = unique_inverse(h)
        if len(self.known) > CACHED:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            kept = (self.known, self.at, self.many, len(self.flat))
            self._learn(data, distinct[new], starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.known, distinct)
        else:
            kept = None
        many, where, flat = self.many[at][inverse], self.at[at][inverse], self.flat
        if kept is not None and np.any(ends[first[new]] - starts[first[new]] > CACHED_BYTES):
            short = ~np.isin(self.known, distinct[new][ends[first[new]] - starts[first[new]] > CACHED_BYTES])
            self.known, self.at, self.many = self.known[short], self.at[short], self.many[short]
        rows = np.searchsorted(starts, offs)
        upto = np.concatenate(([0], np.cumsum(many)))
        n = upto[rows[1:]] - upto[rows[:-1]] + 1
        row_of = np.repeat(np.arange(len(n)), np.diff(rows))
        total = int(n.sum())
        out = np.full(total, end, np.uint32)
        place = np.repeat(upto[:-1] + row_of, many) + (np.arange(upto[-1]) - np.repeat(upto[:-1], many))
        out[place] = flat[np.repeat(where, many) + (np.arange(upto[-1]) - np.repeat(upto[:-1], many))]
        return out, n


def encoder(path: str) -> Encoder:
    """This worker's encoder; it outlives tasks."""
    own = sys.__dict__.setdefault("_brindle_encoders", {})
    if path not in own:
        own[path] = Encoder(path)
    return own[path]


# ---- shard files


def filesystem(uri: str):
    """pyarrow's file system of a folder, and the folder in it."""
    from pyarrow import fs

    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard under a name of its own, and gives it its final name when it is whole."""

    def __init__(self, folder: str, name: str, bits: int):
        if BLOCK % 8:
            raise ValueError("blocks must end at whole bytes")
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temporary = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.bits, self.written, self.n = bits, len(MAGIC), 0
        self.rest = np.zeros(0, np.uint32)
        self.offsets: list[int] = []
        self.ids: list = []
        self.ends: list[np.ndarray] = []

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.written)
        packed = pack(ids, self.bits)
        self.out.write(packed)
        self.written += len(packed)

    def add(self, doc_ids, ids: np.ndarray, n: np.ndarray) -> None:
        self.ids.append(doc_ids)
        self.ends.append(self.n + np.cumsum(n))
        self.n += len(ids)
        self.rest = np.concatenate((self.rest, ids))
        whole = len(self.rest) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self._block(self.rest[k : k + BLOCK])
        self.rest = self.rest[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        about = {b"bits": str(self.bits).encode(), b"ids": str(self.n).encode(), b"block": str(BLOCK).encode(), b"offsets": json.dumps(self.offsets).encode()}
        table = pa.table({"doc_id": pa.chunked_array(self.ids), "end": pa.array(np.concatenate(self.ends), pa.int64())}).replace_schema_metadata(about)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        index = sink.getvalue().to_pybytes()
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.final)


class ShardReader:
    """Random access to a shard."""

    def __init__(self, folder: str, name: str):
        fs, base = filesystem(folder)
        self.file = fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[8:] != MAGIC or self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"{name} isn't a whole shard file")
        length = int.from_bytes(tail[:8], "little")
        self.table = pa.ipc.open_stream(self.file.read_at(length, size - 12 - length)).read_all()
        about = self.table.schema.metadata
        self.bits, self.n, self.block = int(about[b"bits"]), int(about[b"ids"]), int(about[b"block"])
        self.offsets = [*json.loads(about[b"offsets"]), size - 12 - length]
        self.ends = self.table.column("end").to_numpy()

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive) of the shard."""
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        raw = self.file.read_at(self.offsets[last + 1] - self.offsets[first], self.offsets[first])
        got = unpack(raw, self.bits, min(self.n, (last + 1) * self.block) - first * self.block)
        return got[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """All ids of the shard's k-th document."""
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids in ascending order of id as shard files in `folder`; one row a shard: shard, name, n_docs, n_ids, start.

    Null text encodes as empty, so to the end id alone; null ids come first; rows of the same
    id are ordered by their texts' hashes, may lie in several shards, and equal rows are
    written each.  Strings of the tokenizer's added tokens in texts get those tokens' ids, as
    in the library.  Other columns are left aside.  No documents, no shards.  A task that runs
    again replaces its file with the same bytes.
    """
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // SHARD_BYTES, 1 << 20))
    place = F.xxhash64("text")
    ordered = wanted.repartitionByRange(shards, "doc_id", place).sortWithinPartitions("doc_id", place, "text")
    bits = width_of(max(vocabulary, end + 1))

    def run(batches):
        out, name, documents = None, "", 0
        shard = TaskContext.get().partitionId()
        for batch in blocks(batches, "text", 1 << 20):
            if out is None:
                name = f"shard-{shard:06d}.bits"
                out = ShardWriter(folder, name, bits)
            ids, n = encoder(tokenizer).encode(batch.column(1), end)
            out.add(batch.column(0), ids, n)
            documents += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": pa.array([documents], pa.int64()), "n_ids": pa.array([out.n], pa.int64())})

    written = cut(ordered.mapInArrow(run, "shard int, name string, n_docs bigint, n_ids bigint"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(shards: DataFrame, folder: str, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """One row a document of shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers), and ids if with_ids."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(folder, name)
                begin = np.concatenate(([0], shard.ends[:-1])).astype(np.int64)
                edges = np.unique(np.concatenate(([0], np.searchsorted(shard.ends, np.arange(1, shard.n // (16 * BLOCK) + 1) * 16 * BLOCK) + 1, [len(begin)])))
                edges = edges[edges <= len(begin)]
                for a, b in zip(edges[:-1], edges[1:]):
                    got = shard.ids(int(begin[a]), int(shard.ends[b - 1])).astype("<u4")
                    own = [got[s:e] for s, e in zip(begin[a:b] - begin[a], shard.ends[a:b] - begin[a])]
                    columns = {"doc_id": shard.table.column("doc_id").slice(a, b - a).combine_chunks(), "start": pa.array(begin[a:b] + start), "n_tokens": pa.array(shard.ends[a:b] - begin[a:b]), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    files = shards.select("name", "start").repartition("name")
    return files.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else ""))


def tokenize(docs: DataFrame, tokenizer: str, vocabulary: int, end: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids and reads them back, as write_tokens and read_tokens do; folder: a new one in the shared folder if None."""
    spark: SparkSession = docs.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    shards = write_tokens(docs, folder, tokenizer, vocabulary, end, id_col, text_col)
    return read_tokens(shards, folder, docs.schema[id_col].dataType.simpleString())
