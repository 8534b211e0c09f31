"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

One shard is one file of documents in ascending id order::

    magic "EFTOK1\\0\\0" | six u64: documents, ids, smallest doc_id, bytes per id, bytes of each coded list
    coded doc_ids (less the smallest) | coded ends of documents | ids, little-endian, 2 or 4 bytes each

A coded list keeps the low bits of its n sorted values packed and the high bits as a unary bit vector, about
``2 + log2(last / n)`` bits a value. ``select`` finds the i-th value from a sample of every 256th set bit.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokens import END, encoder
from corpusmill.session import scratch_path

MAGIC = b"EFTOK1\0\0"
SAMPLE = 256
#: Text bytes per shard, about.
SHARD_BYTES = 48 << 20

MANIFEST = "shard int, file string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A sorted list of whole numbers from 0, coded."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        bits = max(0, (last // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel())
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags), ones[::SAMPLE].astype("<u4"))

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, dtype=np.uint64)
        start, stop = first * self.low_bits, (first + count) * self.low_bits
        flags = np.unpackbits(self.low[start // 8 : -(-stop // 8)])[start % 8 : start % 8 + stop - start]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (flags.reshape(count, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        skip = at % 8
        while True:
            flags = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64])[skip:])
            if left < len(flags):
                one = byte * 8 + skip + int(flags[left])
                return ((one - i) << self.low_bits) | int(self._lows(i, 1)[0])
            left -= len(flags)
            byte, skip = byte + 64, 0

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(0, self.n)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, low, high, samples = struct.unpack_from("<QQQQQ", data)
        at = np.frombuffer(data, dtype=np.uint8)[40:]
        return cls(n, bits, at[:low], at[low : low + high], at[low + high : low + high + 4 * samples].view("<u4"))


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme that Spark gives it: one without a scheme is in the session's default file system, not on a task's own machine."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_system(uri: str):
    """The pyarrow file system of a qualified folder (``file:/x`` as ``file:///x``) or a local path, and the folder's path in it."""
    from pyarrow import fs

    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def write_shard(uri: str, name: str, doc_ids: list[int], ids: list[bytes], width: int) -> None:
    """Write one shard under a name of its own and move it into place, so a repeated task leaves the same file."""
    import uuid

    store, folder = file_system(uri)
    store.create_dir(folder, recursive=True)
    base = min(doc_ids, default=0)
    keys = EliasFano.encode(np.array([d - base for d in doc_ids], dtype=np.uint64)).to_bytes()
    ends = EliasFano.encode(np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)).to_bytes()
    total = sum(len(x) for x in ids) // 4
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(MAGIC + struct.pack("<QQqQQQ", len(doc_ids), total, base, width, len(keys), len(ends)) + keys + ends)
        for x in ids:
            out.write(x if width == 4 else np.frombuffer(x, dtype="<u4").astype("<u2").tobytes())
    store.move(own, f"{folder}/{name}")


class Shard:
    """A shard opened for reading: ``len``, ``document(i)``, and all documents in order."""

    def __init__(self, uri: str, name: str):
        store, folder = file_system(uri)
        self.file = store.open_input_file(f"{folder}/{name}")
        head = self.file.read(56)
        if head[:8] != MAGIC:
            raise ValueError(f"{name} is no token-id file")
        self.n, self.n_ids, self.base, self.width, keys, ends = struct.unpack("<QQqQQQ", head[8:])
        self.keys = EliasFano.from_bytes(self.file.read(keys))
        self.ends = EliasFano.from_bytes(self.file.read(ends))
        self.at = 56 + keys + ends

    def __len__(self) -> int:
        return self.n

    def ids(self, start: int, stop: int) -> np.ndarray:
        data = self.file.read_at((stop - start) * self.width, self.at + start * self.width)
        return np.frombuffer(data, dtype=f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> tuple[int, int, np.ndarray]:
        """doc_id, start and ids of the i-th document, by select."""
        start = self.ends.select(i - 1) if i else 0
        return self.keys.select(i) + self.base, start, self.ids(start, self.ends.select(i))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        start = 0
        for key, end in zip(self.keys.all().tolist(), self.ends.all().tolist()):
            yield key + self.base, start, self.ids(start, end)
            start = end


def write_token_files(docs: DataFrame, path: str, folder: str, *, vocabulary: int, spaced: bool = True) -> DataFrame:
    """Encode every text, append id 0, and write shards in ascending doc_id order below ``folder``; returns the manifest.

    Only doc_id and text are read. Null and empty texts are a document of the end id alone. Rows without doc_id name no
    document and are left out. Repeated rows are written each; those of one doc_id lie side by side, ordered by a hash of the
    text. An empty table writes nothing. The manifest is computed (and the files written) when it is used.
    """
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 1
    width = 2 if vocabulary <= 1 << 16 else 4
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(shards, "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, doc_ids, ids = TaskContext.get().partitionId(), [], []
        code = encoder(path, spaced=spaced)
        for batch in batches:
            doc_ids += batch.column("doc_id").to_pylist()
            ids += [x + END for x in code.encode(t.as_py() for t in batch.column("text"))]
        if not doc_ids:
            return
        name = f"shard-{shard:06d}.eftok"
        write_shard(folder, name, doc_ids, ids, width)
        row = [[shard], [name], [len(doc_ids)], [sum(map(len, ids)) // 4]]
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["shard", "file", "n_docs", "n_ids"])

    return dealt.mapInArrow(write, MANIFEST)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids before it in all shards), n_tokens and ids_crc32 of every document, read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, name in zip(batch.column("base").to_pylist(), batch.column("file").to_pylist()):
                found = [(d, base + s, len(x), zlib.crc32(x.tobytes())) for d, s, x in Shard(folder, name).documents()]
                columns = [pa.array(v, pa.int64()) for v in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")  # one row per shard
    return manifest.withColumn("base", before).repartition("shard").mapInArrow(read, READ)


def token_files(docs: DataFrame, path: str, *, vocabulary: int) -> DataFrame:
    """Write token-id files below the shared folder and return their documents as read back."""
    spark = docs.sparkSession
    folder = qualified(spark, scratch_path(spark, "token-files"))
    manifest = write_token_files(docs, path, folder, vocabulary=vocabulary).checkpoint()  # one row per shard; the files are there now
    return read_token_files(manifest, folder)
