"""Token-id shards with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents (ascending ``doc_id``) back to back,
16 bits each where the vocabulary allows, then three structures: document ids and
document end offsets as Elias-Fano sequences. An Elias-Fano sequence of n values
below u keeps the low log2(u/n) bits of each packed, and the high parts as n set
bits among n + (u >> low): about 2 + log2(u/n) bits a value, with every 256th set
bit's place sampled, so that ``select(i)`` reads a few bytes instead of a table.

Layout: ``GTID0001``, ids, both sequences, then a footer of 8 little-endian int64.
"""

from __future__ import annotations

import posixpath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, new_path, table
from .tokens import batch_ids, tokenizer_path

MAGIC = b"GTID0001"
SAMPLE = 256
#: Bytes of ids read back at a time.
READ_BYTES = 4 << 20


class EliasFano:
    """A non-decreasing sequence of integers >= 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.empty(n * low_bits, np.uint8)
        for k in range(low_bits):
            low[k::low_bits] = values >> np.uint64(k) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<i8"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.low, self.high, self.samples))

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_low, n_high, n_samples = np.frombuffer(data, "<i8", 5).tolist()
        low = np.frombuffer(data, np.uint8, n_low, 40)
        high = np.frombuffer(data, np.uint8, n_high, 40 + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<i8", n_samples, 40 + n_low + n_high))

    def _low(self, first: int, n: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(n, np.int64)
        a, b = first * self.low_bits, (first + n) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(n, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value number i: from the nearest sample on, its set bit among the high bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        skip = int(np.unpackbits(self.high[byte : byte + 1], count=at % 8, bitorder="little").sum()) if at % 8 else 0
        left += skip
        while True:
            places = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little"))
            if left < len(places):
                break
            left -= len(places)
            byte += 64
        one = byte * 8 + int(places[left])
        return ((one - i) << self.low_bits) | int(self._low(i, 1)[0])

    def block(self, first: int) -> np.ndarray:
        """Values ``first`` ... ``first`` + SAMPLE - 1 as far as there are any; ``first`` is a sampled one."""
        n, k = min(SAMPLE, self.n - first), first // SAMPLE
        at, end = int(self.samples[k]), int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at // 8 : -(-end // 8)], bitorder="little")[at % 8 :]
        return (np.flatnonzero(bits)[:n] + at - np.arange(first, first + n)) << self.low_bits | self._low(first, n)

    def values(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(0, self.n, SAMPLE)]) if self.n else np.zeros(0, np.int64)


def _file_system(uri: str):
    from pyarrow import fs

    for other, own in (("s3a://", "s3://"), ("s3n://", "s3://")):  # Hadoop's names of the same store
        uri = own + uri[len(other) :] if uri.startswith(other) else uri
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_bits: int = 16) -> DataFrame:
    """Write ``docs (doc_id, text)`` as shards in ascending doc_id order; returns the manifest.

    One shard for each range partition of doc_id, so a shard needs no other; a shard
    written by a lost task has a name of its own and is not in the manifest. Null
    text counts as empty; rows without doc_id come first and stay; equal doc_ids stay
    next to each other, ordered by text hash. Manifest: shard, path, n_docs, n_nulls, n_ids, base
    (ids in all shards before).
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId()
        path = f"{folder}/shard-{shard:06d}-{context.taskAttemptId()}.gtid"
        out, n_ids, nulls, keys, ends = None, 0, 0, [], []
        for batch in batches:
            if out is None:
                system, place = _file_system(path)
                system.create_dir(posixpath.dirname(place), recursive=True)
                out = system.open_output_stream(place)
                out.write(MAGIC)
            nulls += batch.column("doc_id").null_count
            keys.append(batch.column("doc_id").drop_null().to_numpy(zero_copy_only=False))
            for part in batch_ids(batch.column("text"), vocabulary, end_id):
                out.write(part.flat.astype("<u2" if id_bits == 16 else "<u4").tobytes())
                ends.append(n_ids + part.bounds[1:])
                n_ids += len(part.flat)
        if out is None:
            return
        keys, ends = np.concatenate(keys), np.concatenate(ends)
        least = int(keys[0]) if len(keys) else 0
        parts = [EliasFano.encode((keys - least).astype(np.uint64)).to_bytes(), EliasFano.encode(ends).to_bytes()]
        for x in parts:
            out.write(x)
        out.write(np.array([id_bits, end_id, n_ids, nulls, len(ends), least, len(parts[0]), len(parts[1])], "<i8").tobytes())
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(ends)], "n_nulls": [nulls], "n_ids": [n_ids]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = materialize(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_nulls long, n_ids long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class TokenFile:
    """One shard, opened for reading: ``ids(i)`` gives document i's ids."""

    def __init__(self, uri: str):
        system, place = _file_system(uri)
        self.file = system.open_input_file(place)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(64, size - 64), "<i8").tolist()
        self.id_bits, self.end_id, self.n_ids, self.n_nulls, self.n_docs, self.least, n_keys, n_ends = foot
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.width = self.id_bits // 8
        self.keys = EliasFano.from_bytes(self.file.read_at(n_keys, size - 64 - n_ends - n_keys))
        self.ends = EliasFano.from_bytes(self.file.read_at(n_ends, size - 64 - n_ends))

    def between(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((last - first) * self.width, 8 + first * self.width), f"<u{self.width}").astype("<u4")

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        return self.between(*self.span(i))

    def doc_id(self, i: int) -> int | None:
        return self.keys.select(i - self.n_nulls) + self.least if i >= self.n_nulls else None

    def blocks(self):
        """(doc_ids, starts, ends) of the documents in blocks of SAMPLE at most; a block's bounds alone are held."""
        before, keys = 0, np.zeros(0, np.int64)
        for first in range(0, self.n_docs, SAMPLE):
            ends = self.ends.block(first)
            at = max(first - self.n_nulls, 0)
            last = first + len(ends) - self.n_nulls  # keys at ... last - 1 belong to the block
            keys = np.concatenate([self.keys.block(i) for i in range(at // SAMPLE * SAMPLE, max(last, 0), SAMPLE)])[at % SAMPLE :][: max(last, 0) - at] if last > at else keys[:0]
            ids = [None] * (len(ends) - len(keys)) + (keys + self.least).tolist()
            yield ids, np.concatenate([[before], ends[:-1]]), ends
            before = int(ends[-1])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (ids: little-endian unsigned 32-bit) of all documents of the shards."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(path)
                for keys, starts, ends in file.blocks():
                    at = 0
                    while at < len(ends):
                        to = max(at + 1, int(np.searchsorted(ends, starts[at] + READ_BYTES // file.width, "right")))
                        raw = file.between(int(starts[at]), int(ends[to - 1])).tobytes()
                        bounds = (np.concatenate([starts[at:to], ends[to - 1 : to]]) - starts[at]) * 4
                        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[at:to], pa.int64()), pa.array(starts[at:to] + base), pa.array(ends[at:to] - starts[at:to]), ids.cast(pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        at = to

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "base").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), new_path(spark, "token-files"), tokenizer_path(), end_id=2)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op3_token_files": op3_token_files}
ORACLE_SQL: dict[str, str] = {}
