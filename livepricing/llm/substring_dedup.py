"""Exact removal of repeated substrings with suffix arrays (induced sorting).

A byte goes if a ``length``-byte string that covers it also starts earlier: in a document of
smaller id, or earlier in the same one. All strings are judged on the input.

1. Anchors. In every window of ``length`` bytes the ``GRAM``-byte string of least hash (leftmost
   on ties) is an anchor; equal windows have the same anchor at the same place. An anchor's
   context is all windows around it. Only (anchor hash, context hash, document, place) of the
   anchors is shuffled, about one per 39 bytes.
2. Sorted by anchor and context, the first of equal contexts stays and the others go in whole
   (every window in them starts earlier in the first). So copies meet the next step once.
3. Shards. Where an anchor has unlike contexts, the remaining ones are dealt by the anchor with
   the longer half of what a shared window must hold (its left or its right side: one of the two
   is shared); of equal slices the first stays again. The contexts of a shard get suffix arrays by induced sorting; neighbours in order
   with a permuted common prefix of ``length`` or more are equal windows, and all but the
   earliest of them go. A half with more than ``block_bytes`` of contexts is no shard: its windows
   are dealt as rows by their own hash, all but the earliest of a batch of contexts go at once,
   and the earliest ones of the batches meet in partial aggregates.
4. The spans found meet their documents again; the rest of each text is hashed.

Texts are whole UTF-8 bytes; null and empty texts have none. A null id comes after all others.
Rows with one id are one document for the order: equal strings at the same place in them do not
remove each other. Texts shorter than ``length`` are untouched. An empty table gives an empty
result. What is removed is decided on bytes, so it may cut a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import Scratch
from .suffix_array import permuted_lcp, suffix_array

GRAM = 24
U = np.uint64
_LAST = (1 << 63) - 1


def anchors(data: np.ndarray, offsets: np.ndarray, s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a slice of texts; windows never cross texts."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U)
    _, ip = tk.powers(n + 1)
    h = tk.mix((s[GRAM:] - s[:-GRAM]) * ip[: n - GRAM + 1])
    bits = U(max(1, int(n).bit_length()))
    low = (h >> bits) << bits | np.arange(len(h), dtype=U)
    done = 1
    while 2 * done <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: len(low) - (width - done)], low[width - done:])
    whole = np.zeros(n + 1, np.int32)  # windows that lie in one text
    lens = np.diff(offsets)
    big = lens >= length
    np.add.at(whole, offsets[:-1][big], 1)
    np.add.at(whole, offsets[1:][big] - length + 1, -1)
    inside = np.cumsum(whole[: len(low)]) > 0
    chosen = np.zeros(n, bool)
    chosen[(low[inside] & ((U(1) << bits) - U(1))).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, h[at]


def context_hashes(s: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return tk.mix(tk.span_hash(s, at - left, at + right) + left.astype(U) * U(0x9E3779B97F4A7C15))


def _find(length: int):
    """anchor, ctx, doc, place (256 * place of the anchor + bytes to the right end)."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, off in tk.text_slices(batch.column(1)):
                s = tk.prefix_hash(data)
                at, h = anchors(data, off, s, length)
                if not len(at):
                    continue
                doc = np.searchsorted(off, at, "right") - 1
                place = at - off[doc]
                left, right = np.minimum(place, length - GRAM), np.minimum(off[doc + 1] - at, length)
                ctx = context_hashes(s, at, left, right)
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(h)), pa.array(tk.signed(ctx)), pa.array(ids[i:j][doc]), pa.array(place * 256 + right)],
                                                 names=["anchor", "ctx", "doc", "place"])
    return run


def _sift(batches):
    """From rows sorted by (anchor, ctx, doc, place): equal contexts but for the first (kind
    'copy'), and the first ones of anchors with unlike contexts (kind 'edge'). Rows of the same
    document and place as the first are the first one again (repeated rows). Streams: the last
    row and the last first one are carried."""
    names = ["kind", "anchor", "ctx", "doc", "place"]
    carry = None  # anchor, ctx of the last row; doc, place of its first; the open first row if it is not yet written
    for batch in batches:
        a, c, d, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(a):
            continue
        first = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
        fresh = np.append(True, a[1:] != a[:-1])  # first row of an anchor
        if carry is not None:
            fresh[0] = a[0] != carry["a"]
            first[0] = fresh[0] or c[0] != carry["c"]
        f = np.flatnonzero(first)
        head = np.maximum.accumulate(np.where(first, np.arange(len(a)), -1))  # -1: the carried one
        again = (d == np.where(head < 0, carry["d"] if carry else 0, d[head])) & (p == np.where(head < 0, carry["p"] if carry else 0, p[head]))
        write = np.zeros(len(f), bool)
        if len(f):
            new = fresh[f]
            write |= ~new  # not the only context of its anchor
            write[:-1] |= ~new[1:]
        if carry is not None and carry["open"] is not None and len(f) and not fresh[f[0]]:
            yield pa.RecordBatch.from_arrays([pa.array(["edge"]), *(pa.array([x], pa.int64()) for x in carry["open"])], names=names)
            carry["open"] = None
        copy, edge = np.flatnonzero(~first & ~again), f[write]
        for kind, rows in (("copy", copy), ("edge", edge)):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind)), *(pa.array(x[rows]) for x in (a, c, d, p))], names=names)
        if len(f):
            last = f[-1]
            still = None if write[-1] else tuple(int(x[last]) for x in (a, c, d, p))
        else:
            still = carry["open"]
        of = (d[f[-1]], p[f[-1]]) if len(f) else (carry["d"], carry["p"])
        carry = {"a": a[-1], "c": c[-1], "d": of[0], "p": of[1], "open": still}


def _extents(place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, bytes to its left, bytes to the right end) of contexts."""
    at, right = place // 256, place % 256
    return at, np.minimum(at, length - GRAM), right


def _valid(s, n, place, ctx, length):
    """Which contexts are of this text (rows of one id may differ), with their extents."""
    at, left, right = _extents(place, length)
    ok = at + right <= n
    at, left, right, ctx = at[ok], left[ok], right[ok], ctx[ok]
    same = tk.signed(context_hashes(s, at, left, right)) == ctx
    return np.flatnonzero(ok)[same], at[same], left[same], right[same]


def _edges(length: int):
    """Contexts with their bytes, each dealt twice: by the left and by the right half."""
    half = (length - GRAM) // 2

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, edges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                s = tk.prefix_hash(data)
                f = edges.values.flatten()
                place, ctx = (x.to_numpy(zero_copy_only=False) for x in f)
                k, at, left, right = _valid(s, len(data), place, ctx, length)
                raw = data.tobytes()
                for side, ok, lo, hi, key_lo, key_hi in (
                        (0, (right >= length - half) & (np.minimum(left, half) + right >= length), at - np.minimum(left, half), at + right, at, at + length - half),
                        (1, (left >= half) & (left + np.minimum(right, length - half) >= length), at - left, at + np.minimum(right, length - half), at - half, at + GRAM)):
                    w = np.flatnonzero(ok)
                    if not len(w):
                        continue
                    key = tk.signed(tk.mix(tk.span_hash(s, key_lo[w], key_hi[w]) + U(side)))
                    rows += [(int(x), doc, int(place[k[i]]), int(ctx[k[i]]), int(lo[i]), raw[lo[i]: hi[i]]) for x, i in zip(key.tolist(), w.tolist())]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:5]), pa.array(cols[5], pa.binary())],
                                                 names=["key", "doc", "place", "ctx", "start", "bytes"])
    return run


def _windows(length: int):
    """From contexts in any order: windows that also start earlier in another context of the batch
    (runs of them, hash null), and the earliest ones of the batch with their hashes."""
    def run(batches):
        for batch in batches:
            doc, place, ctx, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            raw = batch.column(5).to_pylist()
            sizes = np.array([len(b) for b in raw], np.int64)
            many = np.maximum(sizes - length + 1, 0)
            if not many.sum():
                continue
            s = tk.prefix_hash(np.frombuffer(b"".join(raw), np.uint8))
            row = np.repeat(np.arange(len(raw)), many)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            lo = (np.cumsum(sizes) - sizes)[row] + inner
            h = tk.signed(tk.span_hash(s, lo, lo + length))
            at = start[row] + inner
            order = np.lexsort((at, doc[row], h))
            head = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]]))
            least = np.empty(len(row), np.int64)
            least[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
            late = (doc[row] != doc[row[least]]) | (at != at[least])
            k = np.flatnonzero(late)
            a = k[np.append(True, (k[1:] != k[:-1] + 1) | (row[k[1:]] != row[k[:-1]]))] if len(k) else k
            b = k[np.append((k[1:] != k[:-1] + 1) | (row[k[1:]] != row[k[:-1]]), True)] if len(k) else k
            f = np.flatnonzero(~late)
            mine = np.append(row[a], row[f])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(len(a), np.int64), h[f]), mask=np.append(np.ones(len(a), bool), np.zeros(len(f), bool))),
                                              *(pa.array(x[mine]) for x in (doc, place, ctx)), pa.array(np.append(at[a], at[f])),
                                              pa.array(np.append(at[b], at[f]) + length)], names=["hash", "doc", "place", "ctx", "start", "end"])
    return run


def repeated_windows(slices: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(slice number, first, last start) of runs of windows that also start earlier in another
    slice or in the same one. ``slices``: (doc, start of the slice in it, bytes)."""
    sizes = np.array([len(b) for _, _, b in slices])
    t = np.zeros(int(sizes.sum()) + len(slices), np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    for (_, _, b), lo in zip(slices, base.tolist()):
        t[lo: lo + len(b)] = np.frombuffer(b, np.uint8).astype(np.int64) + 1
    sa = suffix_array(t, 257)
    plcp = permuted_lcp(t, sa, length)
    which = np.searchsorted(base, np.arange(len(t)), "right") - 1
    inner = np.arange(len(t)) - base[which]
    group = np.cumsum(plcp[sa] < length)  # neighbours in order with a long common prefix
    shared = np.bincount(group, minlength=int(group[-1]) + 1)[group] > 1
    pos, group = sa[shared], group[shared]
    fits = inner[pos] + length <= sizes[which[pos]]
    pos, group = pos[fits], group[fits]
    if not len(pos):
        return []
    doc = np.array([d for d, _, _ in slices])[which[pos]]
    start = np.array([s for _, s, _ in slices])[which[pos]] + inner[pos]
    order = np.lexsort((start, doc, group))
    pos, group, doc, start = pos[order], group[order], doc[order], start[order]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(head, np.diff(np.append(head, len(group))))
    late = (doc != doc[least]) | (start != start[least])
    pos = np.sort(pos[late])
    if not len(pos):
        return []
    cut = np.flatnonzero(np.append(True, (pos[1:] != pos[:-1] + 1) | (which[pos[1:]] != which[pos[:-1]])))
    ends = np.append(cut[1:], len(pos)) - 1
    return [(int(which[pos[a]]), int(inner[pos[a]]), int(inner[pos[b]])) for a, b in zip(cut, ends)]


def _suffixes(length: int, block_bytes: int):
    """From rows sorted by key, none of which has more than ``block_bytes``: suffix arrays over
    blocks of whole keys with two rows or more."""
    def run(batches):
        block, size = [], 0
        group: dict[bytes, tuple] = {}
        key, out = None, []

        def flush():
            nonlocal block, size, out
            found = repeated_windows([(r[1], r[4], r[5]) for r in block], length) if block else []
            out += [(block[i][1], block[i][2], block[i][3], block[i][4] + a, block[i][4] + b + length) for i, a, b in found]
            rows, out, block, size = out, [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc", "place", "ctx", "start", "end"])

        def close():
            nonlocal size
            if len(group) > 1:
                more = sum(len(b) + 1 for b in group)
                if size + more > block_bytes or len(out) >= 100_000:
                    yield from flush()
                block.extend(group.values())
                size += more
            group.clear()

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != key:
                    yield from close()
                    key = r[0]
                first = group.setdefault(r[5], r)
                if first is not r and first[1:5:3] != r[1:5:3]:  # an equal slice that starts later
                    out.append((r[1], r[2], r[3], r[4], r[4] + len(r[5])))
        yield from close()
        yield from flush()
    return run


def _cut(length: int):
    """The documents without their repeated spans."""
    def run(batches):
        for batch in batches:
            out = []
            for text, marks in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                if not marks.is_valid:
                    out.append((len(raw), 0, [], hashlib.sha256(raw).hexdigest()))
                    continue
                place, ctx, lo, hi = (x.to_numpy(zero_copy_only=False) for x in marks.values.flatten())
                s = tk.prefix_hash(np.frombuffer(raw, np.uint8))
                k, _, _, _ = _valid(s, len(raw), place, ctx, length)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, lo[k], 1)
                np.add.at(edge, hi[k], -1)
                gone = np.append(False, np.cumsum(edge)[:-1] > 0)
                a = np.flatnonzero(~gone[:-1] & gone[1:])
                b = np.flatnonzero(np.append(gone[1:-1] & ~gone[2:], gone[-1:])) + 1 if len(raw) else a
                kept, upto = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist()):
                    kept.update(raw[upto:x])
                    upto = y
                kept.update(raw[upto:])
                out.append((len(raw), int(gone.sum()), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())], kept.hexdigest()))
            n, gone, spans, digest = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digest, pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])
    return run


def repeated_spans(docs: DataFrame, length: int = 100, block_bytes: int = 1 << 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, spans (array of start, end
    in bytes, maximal and in order), kept_sha256."""
    if not GRAM < length < 256:
        raise ValueError(f"length must lie between {GRAM + 1} and 255")
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", F.coalesce("doc_id", F.lit(_LAST)))
    found = d.select("doc", "text").mapInArrow(_find(length), "anchor long, ctx long, doc long, place long")
    rows = found.repartition("anchor").sortWithinPartitions("anchor", "ctx", "doc", "place").mapInArrow(
        _sift, "kind string, anchor long, ctx long, doc long, place long")
    sifted = scratch.stage(rows, "dedup_contexts", by=("kind",))
    edges = sifted.where("kind = 'edge'").groupBy("doc").agg(F.collect_list(F.struct("place", "ctx")).alias("edges"))
    dealt = scratch.stage(d.select("doc", "text").join(edges, "doc").select("doc", "text", "edges").mapInArrow(
        _edges(length), "key long, doc long, place long, ctx long, start long, bytes binary").withColumn("size", F.length("bytes") + 1), "dedup_dealt")
    # keys too large for a shard are known before anything is dealt by key
    hot = scratch.stage(dealt.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > block_bytes).select("key"), "dedup_hot_keys")
    dealt = dealt.drop("size")
    late = scratch.stage(dealt.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(
        _suffixes(length, block_bytes), "doc long, place long, ctx long, start long, end long"), "dedup_windows")
    span = ["doc", "place", "ctx", "start", "end"]
    windows = scratch.stage(dealt.join(hot, "key", "left_semi").mapInArrow(
        _windows(length), "hash long, doc long, place long, ctx long, start long, end long"), "dedup_hot_windows")
    least = windows.where("hash is not null").groupBy("hash").agg(F.min(F.struct("doc", "start")).alias("least"))
    later = windows.join(least, "hash").where(F.struct("doc", "start") > F.col("least"))
    late = late.unionByName(windows.where("hash is null").select(span)).unionByName(later.select(span))
    at = F.expr("place div 256")
    copies = sifted.where("kind = 'copy'").select(
        "doc", "place", "ctx", F.greatest(at - (length - GRAM), F.lit(0)).cast("long").alias("start"), (at + F.col("place") % 256).cast("long").alias("end"))
    marks = copies.where(F.col("end") - F.col("start") >= length).unionByName(late)
    marks = marks.groupBy("doc").agg(F.collect_list(F.struct("place", "ctx", "start", "end")).alias("marks"))
    return d.join(marks, "doc", "left").select("doc_id", "text", "marks").mapInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string")
