"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

Each task packs its own rows, so nothing is shuffled: full windows are cut from
long documents, what is left is cut into pieces, and groups of pieces are dealt to
near-equal windows. Differencing keeps a heap of partial partitions (k sums each),
takes the two with the largest spread and merges the largest sums of one with the
least of the other. Where a window then exceeds the capacity, the window count
rises by one and the group is dealt again.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .tokens import batch_ids, tokenizer_path

CAPACITY = 1024
#: Windows of a group that is dealt at once, and the tokens each may lack of the capacity.
GROUP_WINDOWS, SLACK = 128, 4
#: Longest piece of what a document has left after its full windows.
PIECE = 256
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Items dealt to k sets with near-equal sums (the sets' order means nothing)."""
    n = len(sizes)
    nodes = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(nodes)
    sums: dict[int, np.ndarray] = {}
    head: dict[int, np.ndarray] = {}
    tail: dict[int, np.ndarray] = {}
    link = np.full(n + 1, -1)  # the last entry takes what empty sets write

    def taken(i: int):
        if i >= n:
            return sums.pop(i), head.pop(i), tail.pop(i)
        own = np.zeros(k, np.int64)
        own[0] = sizes[i]
        first = np.full(k, -1)
        first[0] = i
        return own, first, first.copy()

    new = n
    while len(nodes) > 1:
        _, i = heapq.heappop(nodes)
        _, j = heapq.heappop(nodes)
        (sa, ha, ta), (sb, hb, tb) = taken(i), taken(j)
        sb, hb, tb = sb[::-1], hb[::-1], tb[::-1]
        total = sa + sb
        link[ta] = np.where(ta >= 0, hb, -1)
        h, t = np.where(ha >= 0, ha, hb), np.where(tb >= 0, tb, ta)
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[new], head[new], tail[new] = total - total[-1], h[order], t[order]
        heapq.heappush(nodes, (-int(total[0] - total[-1]), new))
        new += 1
    _, first, _ = taken(nodes[0][1]) if nodes else (None, np.full(k, -1), None)
    out = []
    for at in first.tolist():
        own = []
        while at >= 0:
            own.append(at)
            at = int(link[at])
        out.append(own)
    return out


def deal(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their count rises until all fit."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sets = differencing(sizes, k)
        if max(int(sizes[x].sum()) for x in sets) <= capacity:
            return [x for x in sets if x]
        k += 1


class _Packer:
    """Pieces of one task: whole windows leave at once, others wait for their group."""

    def __init__(self, sequence: int, capacity: int):
        self.sequence, self.capacity = sequence, capacity
        self.target = GROUP_WINDOWS * (capacity - SLACK)
        self.waiting: list[tuple] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, cap = len(ids), self.capacity
        for a in range(0, n - n % cap, cap):
            self.rows.append((doc_id, a, cap, n, self.sequence, 0, ids[a : a + cap].tobytes()))
            self.sequence += 1
        rest = n % cap
        cuts = np.linspace(n - rest, n, -(-rest // PIECE) + 1).astype(np.int64) if rest else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.waiting.append((doc_id, int(a), int(b - a), n, ids[a:b].tobytes()))
            self.tokens += int(b - a)
        if self.tokens >= self.target:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        for window in deal(np.array([x[2] for x in self.waiting]), self.capacity):
            offset = 0
            for i in window:
                doc_id, start, length, n, ids = self.waiting[i]
                self.rows.append((doc_id, start, length, n, self.sequence, offset, ids))
                offset += length
            self.sequence += 1
        self.waiting, self.tokens = [], 0

    def taken(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs (doc_id, text)`` in sequences of at most ``capacity`` ids.

    One row a piece, ``ids`` being its little-endian unsigned 32-bit ids. Null or
    empty text is its end id alone; equal or null doc_ids are packed row by row.
    Sequence ids hold the task's number above 40 bits of counter, so they are unique.
    """

    def run(batches):
        from pyspark import TaskContext

        packer = _Packer(TaskContext.get().partitionId() << 40, capacity)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for part in batch_ids(batch.column("text"), vocabulary, end_id):
                flat, bounds = part.flat.astype("<u4"), part.bounds.tolist()
                for i in range(len(bounds) - 1):
                    packer.add(keys[part.first + i], flat[bounds[i] : bounds[i + 1]])
                if packer.rows:
                    yield packer.taken()
        packer.flush()
        yield packer.taken()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
