"""Packed token matrices: best-fit-decreasing packing with segment-tree capacity search.

A document's ids, closed by the end id, are split losslessly into segments of ``length`` ids at
most. A task packs blocks of about ``block_tokens`` ids of its own input, with no shuffle: the
longest segments first, each into the row with the least room that still holds it, found in a
segment tree over the room left; else into a new row. Every row is written as a fixed-width
little-endian id vector (padded with the end id), its cumulative segment lengths and position
ids that restart with each segment.

A null or empty text is a segment of the end id alone; repeated documents are packed each. A
re-run of a task gives the same rows. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

SCHEMA = ("pack_id long, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, n_tokens int, "
          "input_ids binary, position_ids binary")


class Rooms:
    """Rows by the room they have left: a binary segment tree over room 0..length whose nodes
    count the rows below them."""

    def __init__(self, length: int):
        self.half = 1 << length.bit_length()
        self.count = [0] * (2 * self.half)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        n = room + self.half
        while n:
            self.count[n] += 1
            n >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least ``size``, now taken out."""
        n = size + self.half
        while not self.count[n]:
            while n & 1:  # a right child: go up
                n >>= 1
            if not n:
                return None
            n += 1  # the sibling to the right
        while n < self.half:
            n = 2 * n if self.count[2 * n] else 2 * n + 1
        room, up = n - self.half, n
        while up:
            self.count[up] -= 1
            up >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of segment numbers; no row holds more than ``length``."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        rows[found[1]].append(i)
        if found[0] > sizes[i]:
            rooms.put(found[0] - sizes[i], found[1])
    return rows


def pack(docs: DataFrame, length: int = 2048, block_tokens: int = 1 << 22, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text): pack_id, doc_ids and doc_starts (each segment's
    document and the place of its first id there), cu_seqlens (from 0), n_tokens, input_ids and
    position_ids (``length`` numbers each, 2 bytes or, for larger vocabularies, 4)."""

    def run(batches):
        kind, end = tokens.id_type(vocabulary), tokens.end_id(vocabulary)
        at = np.dtype("<u2" if length <= 1 << 16 else "<u4")
        first, made = TaskContext.get().partitionId() << 33, 0
        segments: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def rows():
            nonlocal made
            packed = best_fit_decreasing([len(s[2]) for s in segments], length)
            for lo in range(0, len(packed), 512):
                part = packed[lo: lo + 512]
                ids = np.full((len(part), length), end, kind)
                pos = np.zeros((len(part), length), at)
                cu = []
                for n, row in enumerate(part):
                    cuts = [0]
                    for i in row:
                        a, b = cuts[-1], cuts[-1] + len(segments[i][2])
                        ids[n, a:b] = segments[i][2]
                        pos[n, a:b] = np.arange(b - a)
                        cuts.append(b)
                    cu.append(cuts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(first + made, first + made + len(part)), pa.int64()),
                    pa.array([[segments[i][0] for i in row] for row in part], pa.list_(pa.int64())),
                    pa.array([[segments[i][1] for i in row] for row in part], pa.list_(pa.int64())),
                    pa.array(cu, pa.list_(pa.int32())), pa.array([c[-1] for c in cu], pa.int32()),
                    pa.array([r.tobytes() for r in ids], pa.binary()), pa.array([r.tobytes() for r in pos], pa.binary()),
                ], names=["pack_id", "doc_ids", "doc_starts", "cu_seqlens", "n_tokens", "input_ids", "position_ids"])
                made += len(part)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*tokens.encode(text.as_py(), vocabulary), end], kind)
                for lo in range(0, len(ids), length):
                    segments.append((doc, lo, ids[lo: lo + length]))
                held += len(ids)
                if held >= block_tokens:
                    yield from rows()
                    segments, held = [], 0
        if segments:
            yield from rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
