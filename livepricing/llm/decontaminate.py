"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with white space runs as one blank. An item of m characters may
occur with up to ``error_rate`` * m edits (k); cut into k + 1 pieces, at least one piece of it
then stands unchanged in the document. One Aho-Corasick pass over the whole document finds every
piece. A hit climbs a tree over the item's pieces: where p pieces hold more than p - 1 edits the
match cannot lie there, so most chance hits end at their neighbour piece. What reaches the root is
matched in full by Myers' bit-parallel distance (free start and end in the document), as are all
steps of the climb. Items shorter than ``exact_below`` must occur exactly.

Items are taken in blocks of at most ``block_chars`` characters, so what a task holds (and what
is broadcast) has that bound; each further block is another pass. Null or blank items match
nothing, an item without an id is reported with a null one, null or empty documents hold nothing; equal items and repeated documents each give
their own rows; an empty benchmark gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "doc_id long, item_id long, edits int, budget int, item_chars int, match_end long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def budget(m: int, error_rate: float, exact_below: int) -> int:
    return 0 if m < exact_below else int(error_rate * m)


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least distance of the pattern to any substring of text, end of the first such)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, i
    return best, end


class Item:
    """An item with its budget and the tree over its pieces: nodes of (parent, start, end, edits
    allowed, masks); the leaves are the pieces in order."""

    def __init__(self, item_id: int | None, text: str, k: int):
        self.id, self.text, self.k = item_id, text, k
        self.cuts = [a for a, _ in pieces(text, k)] + [len(text)]
        self.nodes: list[list] = []
        self.leaf: dict[int, int] = {}
        self._grow(0, k + 1, None)

    def _grow(self, lo: int, hi: int, parent: int | None) -> None:
        n = len(self.nodes)
        self.nodes.append([parent, self.cuts[lo], self.cuts[hi], hi - lo - 1, None])
        if hi - lo == 1:
            self.leaf[self.cuts[lo]] = n
        else:
            mid = (lo + hi) // 2
            self._grow(lo, mid, n)
            self._grow(mid, hi, n)

    def masks(self, n: int) -> dict[str, int]:
        node = self.nodes[n]
        if node[4] is None:
            out: dict[str, int] = defaultdict(int)
            for j, c in enumerate(self.text[node[1]: node[2]]):
                out[c] |= 1 << j
            node[4] = dict(out)
        return node[4]

    def climb(self, text: str, at: int, start: int) -> bool:
        """Whether the item can stand around its piece at offset ``at``, found so that the item
        would begin at ``start`` without edits."""
        n = self.nodes[self.leaf[at]][0]
        while n:  # the root is left to the full match
            parent, lo, hi, k, _ = self.nodes[n]
            part = text[max(start + lo - k, 0): start + hi + k]
            if self.text[lo:hi] not in part and myers(self.masks(n), hi - lo, part)[0] > k:
                return False
            n = parent
        return True


class Matcher:
    """The items of one block, ready to be looked for."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, exact_below: int):
        self.items = [Item(i, t, budget(len(t), error_rate, exact_below)) for i, t in items]
        where = defaultdict(list)
        for n, item in enumerate(self.items):
            for at, p in pieces(item.text, item.k):
                where[p].append((n, at))
        self.auto = ahocorasick.Automaton()
        for p, v in where.items():
            self.auto.add_word(p, (len(p), v))
        if where:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int, int]]:
        """(item id, edits, budget, item length, match end) of every item that occurs."""
        starts = defaultdict(set)
        for end, (length, places) in self.auto.iter(text):
            for n, at in places:
                starts[n].add((end + 1 - length - at, at))
        out = []
        for n, hits in starts.items():
            item = self.items[n]
            m, k, best = len(item.text), item.k, None
            windows: list[list[int]] = []
            for s, at in sorted(hits):
                if windows and s + m + k <= windows[-1][1] or k and not item.climb(text, at, s):
                    continue
                if windows and s - k <= windows[-1][1]:
                    windows[-1][1] = s + m + k
                else:
                    windows.append([s - k, s + m + k])
            for lo, hi in windows:
                lo = max(lo, 0)
                part = text[lo:hi]
                p = part.find(item.text)
                edits, stop = (0, p + m) if p >= 0 else myers(item.masks(0), m, part) if k else (m, 0)
                if edits <= k and (best is None or edits < best[0]):
                    best = (edits, lo + stop)
            if best:
                out.append((item.id, best[0], k, m, best[1]))
        return out


def item_blocks(benchmark: DataFrame, block_chars: int):
    """Blocks of (item_id, normal text); one row at a time passes through the driver."""
    block, size = [], 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        t = normal(r.text)
        if not t:
            continue
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.item_id, t))
        size += len(t)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1, exact_below: int = 30,
          block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, edits, budget, item_chars, match_end (in the normal text): one row for
    each document and item that occurs in it."""
    spark, found = docs.sparkSession, None
    for items in item_blocks(benchmark, block_chars):
        known = spark.sparkContext.broadcast(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def look(batches, known=known):
            matcher = Matcher(known.value, error_rate, exact_below)
            for pdf in batches:
                rows = [(d, *hit) for d, t in zip(pdf["doc_id"].tolist(), pdf["text"]) if t for hit in matcher.find(normal(t))]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "budget", "item_chars", "match_end"], dtype=object)
                yield out.astype({"doc_id": "Int64", "item_id": "Int64", "match_end": "int64", "edits": "int32", "budget": "int32", "item_chars": "int32"})

        part = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(look, RESULT)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], RESULT)


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1, exact_below: int = 30,
                  block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` in which no item occurs; one pass per block of items, no shuffle."""
    for items in item_blocks(benchmark, block_chars):
        known = docs.sparkSession.sparkContext.broadcast(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        at = docs.columns.index("text")

        def keep(batches, known=known, at=at):
            matcher = Matcher(known.value, error_rate, exact_below)
            for batch in batches:
                clean = [not (t.is_valid and matcher.find(normal(t.as_py()))) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
