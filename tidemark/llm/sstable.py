"""Token ids as sorted-string-table shards, with binary-search lookup.

A shard is: MAGIC; blocks; the sparse index; the Bloom filter; the footer. Keys have nine bytes: 1 and the
document's 64-bit identifier with the sign bit turned, big-endian, so that byte order is number order; a document
without identifier has nine zero bytes, the first key of all.
- A block is a CRC-32 of what follows and zstd-compressed entries. An entry is the number of key bytes shared with
  the key before it in the block, the number of other key bytes, the number of value bytes (all
  three little-endian base-128 numbers), those key bytes and the value: ids of `width` bytes each,
  little-endian.
- The index has, for each block, its last key (9 bytes), offset and length (8 bytes each).
- The Bloom filter has 10 bits a key and 7 probes.
- The footer is fixed in size: offsets and lengths of index and filter, counts, width, MAGIC.

Shards are written by executors to a shared folder, one file for each range and attempt; only files of
successful attempts are in the manifest, so lost executors leave nothing that is read.

A shard ends after SHARD_BYTES whatever its key, and tasks deal rows out by id, text hash and place in the input; so documents of one id
may stand in several shards, all of which a lookup asks, and no id, nor none, puts its rows into one task.

Defined results: a null or empty text has the end id alone; documents of a null doc_id come first; repeated
doc_ids stand next to each other, ordered by a hash of their text; a text is encoded whole, so a task holds the longest one with its ids;
an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder
from .store import Workspace
from .words import U, mix, text_parts

MAGIC = b"TMSST002"
_FOOTER = struct.Struct("<QQQQQQQ8s")
_KEY, _INDEX = 9, struct.Struct(">9sQQ")
BLOCK_BYTES, SHARD_BYTES, END_ID = 64 << 10, 64 << 20, 2


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    a, b = mix(keys + U(1)), mix(keys + U(2)) | U(1)
    return ((a[:, None] + b[:, None] * np.arange(7, dtype=U)) % U(bits)).astype(np.int64)


def _key(doc_id: int | None) -> bytes:
    return bytes(_KEY) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def _id(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _bloom_keys(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[1:] for k in keys), ">u8").astype(U)


class ShardWriter:
    """Takes ascending keys; holds one block and 32 bytes a key."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.zip = out, width, zstandard.ZstdCompressor(1)
        out.write(MAGIC)
        self.at, self.tokens = len(MAGIC), 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.block, self.size, self.last = [], 0, b""

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = _key(doc_id)
        shared = 0
        while shared < min(len(self.last), _KEY) and self.last[shared] == key[shared]:
            shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        entry = _number(shared) + _number(len(key) - shared) + _number(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.last, self.tokens = key, self.tokens + len(ids)
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            body = self.zip.compress(b"".join(self.block))
            self.out.write(struct.pack("<I", zlib.crc32(body)) + body)
            self.index.append((self.keys[-1], self.at, len(body) + 4))
            self.at += len(body) + 4
            self.block, self.size, self.last = [], 0, b""

    def close(self) -> None:
        self._end_block()
        index = b"".join(_INDEX.pack(*x) for x in self.index)
        bits = max(64, -(-10 * len(self.keys) // 8) * 8)
        bloom = np.zeros(bits, bool)
        for a in range(0, len(self.keys), 100_000):
            bloom[_probes(_bloom_keys(self.keys[a : a + 100_000]), bits).ravel()] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), len(self.keys), self.tokens, self.width, MAGIC))


class ShardReader:
    """Reads footer, index and filter; then blocks as they are needed."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        ia, il, ba, bl, self.n, self.tokens, self.width, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a shard, or cut short")
        index = self._at(ia, il)
        self.index = [_INDEX.unpack_from(index, k) for k in range(0, il, _INDEX.size)]
        self.bloom, self.bits = np.frombuffer(self._at(ba, bl), np.uint8), bl * 8

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def block(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        _, offset, size = self.index[k]
        raw = self._at(offset, size)
        if zlib.crc32(raw[4:]) != struct.unpack_from("<I", raw)[0]:
            raise ValueError(f"block {k} is corrupt")
        data, at, key = self.unzip.decompress(raw[4:]), 0, b""
        while at < len(data):
            shared, at = _read_number(data, at)
            rest, at = _read_number(data, at)
            size, at = _read_number(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield _id(key), np.frombuffer(data, "<u2" if self.width == 2 else "<u4", size // self.width, at).astype("<u4")
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all entries of a document; the filter spares most reads for absent ones."""
        key = _key(doc_id)
        p = _probes(_bloom_keys([key]), self.bits)[0]
        if not (self.bloom[p >> 3] >> (p & 7) & 1).all():
            return []
        out: list[np.ndarray] = []
        for k in range(bisect.bisect_left(self.index, (key, -1, -1)), len(self.index)):
            got = list(self.block(k))
            out += [ids for i, ids in got if i == doc_id]
            if self.index[k][0] > key:
                break
        return out


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store, inner


def open_shard(path: str) -> ShardReader:
    store, inner = _open(path)
    f = store.open_input_file(inner)
    return ShardReader(f, f.size())


_MANIFEST = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("tokens", pa.int64())])


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    width = 2 if max(enc.top, end_id) < 1 << 16 else 4
    store, inner = _open(folder)
    made: list[dict] = []
    writer = None

    def end() -> None:
        writer.close()
        writer.out.close()
        made[-1] |= {"n": len(writer.keys), "tokens": writer.tokens, "first": _id(writer.keys[0]), "last": _id(writer.keys[-1])}

    for batch in batches:
        for a, b in text_parts(batch.column(1)):
            ids = batch.column(0).slice(a, b - a).to_pylist()
            texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
            for doc_id, tokens in zip(ids, enc.encode(texts), strict=True):
                if writer is not None and writer.at > shard_bytes:
                    end()
                    writer = None
                if writer is None:
                    name = f"{uuid.uuid4().hex}.sst"  # a name of its own for each attempt
                    writer = ShardWriter(store.open_output_stream(f"{inner}/{name}"), width)
                    made.append({"part": TaskContext.get().partitionId(), "nth": len(made), "path": f"{folder}/{name}"})
                writer.add(doc_id, np.append(tokens, np.uint32(end_id)))
    if writer is not None:
        end()
    if made:
        yield pa.RecordBatch.from_pylist(made, schema=_MANIFEST)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode, append end_id, range-partition and sort by id, and write shards.

    A plan of the manifest: part and nth (their order), path, first, last (ids), n, tokens. It has to be written before it is read twice.
    """
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(folder)
    store.create_dir(inner, recursive=True)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    key = [F.col("id").asc_nulls_first(), "h", "place"]
    sort = rows.repartitionByRange(*key).sortWithinPartitions(*key).select("id", "text")
    return sort.mapInArrow(lambda it: _write(it, folder, vocabulary, end_id, shard_bytes), "part int, nth int, path string, first long, last long, n long, tokens long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            start, rows = row["start"], []
            for doc_id, ids in open_shard(row["path"]):
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, from the files.

    A shard's start is the sum of tokens of the tasks before its own, and of the shards before it in its task. One window has a row a task
    of the writer, the other one a row a shard of one task.
    """
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).select(F.col("part").alias("p"), before(Window.orderBy("part")).alias("start"))
    starts = manifest.join(parts, F.col("part") == F.col("p")).select("path", (F.col("start") + before(Window.partitionBy("part").orderBy("nth"))).alias("start"))
    tasks = max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism, 10_000))
    return starts.repartition(tasks, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def byte_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def token_shards(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write shards of docs below the shared folder and return what they hold: doc_id, start, n_tokens, ids_crc32."""
    ws = Workspace(docs.sparkSession, "sstable")
    manifest = ws.keep(write_shards(docs, ws.path("shards"), vocabulary or byte_bpe_path()), "manifest")
    return read_shards(docs.sparkSession, manifest)


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, start, n_tokens, ids_crc32."""
    return token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
