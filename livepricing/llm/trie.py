"""Prefix trie of conversations from sorted sequences: longest common prefixes (LCPs) and a sparse
table for their range minima, no stack and no recursion.

A conversation is the sequence of its turns (role, text), each as a 16-byte digest. Sequences are
sorted over the whole table (range sort, ties by conv_id) and numbered. The node "first d turns" of
the sequence at place i is the interval of places around i whose neighbouring LCPs are at least d.
Every candidate (i, d) finds its two ends by itself: a binary search over powers of two in a sparse
table of range minima.

The places are cut into blocks (``block`` places, more once there are over ``most_blocks`` blocks),
each with a sparse table of its own. A search that runs out of its block is answered once for the
block, side and depth: a sparse table over the blocks' minima finds the block that ends it, that
block's staircase (the places where the running minimum falls) the place. So a first turn that a
third of all conversations share costs two answers per block and no group of its rows.

Nodes are intervals then: members are counted by their ends, subtrees are sums between two places
(prefix sums over blocks of the nodes in depth-first order). The digest of a node's own ends is one
stream of sorted ids in constant memory, as SHA-256 has to be; rows of ids are all that is dealt
for it. A conversation is one row of 20 bytes a turn; texts move once, in the sort of the turns.

Turns are ordered by turn (null first), then role and text; null role or text is empty. Rows
without conv_id belong to no conversation. Repeated rows are turns of their own. An empty table has
no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merkle import CRC32_SQL
from .ordering import positions
from .scratch import Scratch

WIDTH = 16  # bytes of a turn in a sequence


def sequences(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, items: the digests and code points of its turns in order."""
    t = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = t.withColumn("digest", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    d = d.withColumn("points", F.length("text"))
    # the sort of the texts is dealt by range; what is gathered per conversation is 20 bytes a turn
    order = ["conv_id", "turn", "role", "text"]
    s = d.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    s = scratch.stage(s.select("conv_id", "digest", "points", F.monotonically_increasing_id().alias("_id")), "trie_turns")
    items = F.sort_array(F.collect_list(F.struct("_id", "digest", "points")))
    return s.groupBy("conv_id").agg(F.transform(items, lambda x: F.struct(x["digest"].alias("digest"), x["points"].alias("points"))).alias("items"))


def rebuilt(turns: DataFrame, scratch: Scratch, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, seq (binary), points: every conversation with its first h turns taken from the first
    conversation of its hundred."""
    own = scratch.stage(sequences(turns, scratch), "trie_own")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    head = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("items", 1, most - 1).alias("head"))
    none = F.expr("array()").cast(own.schema["items"].dataType)
    j = own.withColumn("h", h).withColumn("base", base).join(head, "base", "left")
    j = j.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
                                     F.expr("slice(items, h + 1, size(items))")).alias("items"))
    return j.select("conv_id", F.aggregate("items", F.lit(b""), lambda a, x: F.concat(a, x["digest"])).alias("seq"),
                    F.col("items.points").alias("points"))


class RangeMinimum:
    """Sparse table over an array: minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.n, self.table = len(values), [values]
        while 2 << (len(self.table) - 1) <= self.n:
            low, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(low[:-step], low[step:]))

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Largest e >= at so that all values in at + 1 .. e are >= depth."""
        e = at.copy()
        for k in range(len(self.table) - 1, -1, -1):
            t, step = self.table[k], 1 << k
            ok = e + step < self.n
            ok[ok] = t[e[ok] + 1] >= depth[ok]
            e[ok] += step
        return e

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Smallest s <= at so that all values in s + 1 .. at are >= depth."""
        s = at.copy()
        for k in range(len(self.table) - 1, -1, -1):
            t, step = self.table[k], 1 << k
            ok = s - step >= 0
            ok[ok] = t[s[ok] - step + 1] >= depth[ok]
            s[ok] -= step
        return s


def common_prefixes(seqs: list[bytes]) -> np.ndarray:
    """Turns that each sequence shares with the one before it (the first: 0)."""
    lens = np.array([len(s) // WIDTH for s in seqs], np.int64)
    flat = np.frombuffer(b"".join(seqs), np.uint64).reshape(-1, 2)
    first = np.concatenate([[0], np.cumsum(lens)])[:-1]
    out = np.zeros(len(seqs), np.int64)
    live = np.arange(1, len(seqs))
    d = 0
    while len(live):
        live = live[(lens[live] > d) & (lens[live - 1] > d)]
        live = live[(flat[first[live] + d] == flat[first[live - 1] + d]).all(axis=1)]
        d += 1
        out[live] = d
    return out


_NODES = ("blk long, kind string, d long, l long, r long, pl long, low long, points long, conv long, "
          "top array<struct<at: long, low: long>>, end array<struct<at: long, low: long>>")
_STEP = pa.list_(pa.struct([("at", pa.int64()), ("low", pa.int64())]))
_TYPES = [pa.int64(), pa.string(), *[pa.int64()] * 7, _STEP, _STEP]


def _rows(n: int, **columns) -> pa.Table:
    """``n`` rows of _NODES; columns that are not given are null."""
    names = [c.split()[0] for c in _NODES.split(", ", 9)[:9]] + ["top", "end"]
    return pa.table([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, _TYPES)], names=names)


def _block(size: int, total: int):
    """Of one block of sorted sequences (with the last one before it): its minima and staircases
    (kind b), its nodes (n) and the node at which each conversation ends (e). Ends that lie
    outside the block are null."""
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        blk, pos = block["blk"][0].as_py(), block["pos"].to_numpy()
        lcp = common_prefixes(block["seq"].to_pylist())
        if pos[0] < blk * size:  # the last one of the block before
            block, pos, lcp = block.slice(1), pos[1:], lcp[1:]
        else:
            lcp[0] = -1          # nothing is before the first place of all
        start, n = int(pos[0]), len(pos)
        conv, turns = block["conv_id"].to_numpy(), block["points"].combine_chunks()
        lens = pc.list_value_length(turns).to_numpy().astype(np.int64)
        rmq = RangeMinimum(lcp)
        # candidates: every prefix of every sequence
        i = np.repeat(np.arange(n), lens + 1)
        first = np.concatenate([[0], np.cumsum(lens + 1)])
        d = np.arange(len(i)) - first[i]
        points = np.zeros(len(i), np.int64)
        points[d > 0] = turns.flatten().to_numpy()
        s, e = rmq.left(i, d), rmq.right(i, d)
        out_left = (s == 0) & (lcp[0] >= d)
        out_right = (e == n - 1) & (start + n < total)
        # one node per left end and depth
        order = np.lexsort((i, d, s))
        new = np.append(True, (np.diff(s[order]) != 0) | (np.diff(d[order]) != 0))
        head = order[new]
        up = np.maximum(head - 1, 0)         # the candidate one turn shorter
        nodes = _rows(len(head), blk=np.full(len(head), blk), kind=["n"] * len(head), d=d[head],
                      l=pa.array(s[head] + start, mask=out_left[head]), r=pa.array(e[head] + start, mask=out_right[head]),
                      pl=pa.array(s[up] + start, mask=out_left[up] | (d[head] == 0)),
                      low=np.minimum.reduceat(conv[i[order]], np.flatnonzero(new)), points=points[head])
        last = first[1:] - 1
        ends = _rows(n, blk=np.full(n, blk), kind=["e"] * n, d=lens, l=pa.array(s[last] + start, mask=out_left[last]), conv=conv)
        run_min, back_min = np.minimum.accumulate(lcp), np.minimum.accumulate(lcp[::-1])[::-1]
        down = np.flatnonzero(np.append(True, np.diff(run_min) != 0))
        rise = np.flatnonzero(np.append(np.diff(back_min) != 0, True))[::-1]
        stairs = _rows(1, blk=[blk], kind=["b"], low=[int(lcp.min())],
                       top=[[{"at": int(x) + start, "low": int(lcp[x])} for x in down]],
                       end=[[{"at": int(x) + start, "low": int(lcp[x])} for x in rise]])
        return pa.concat_tables([nodes, ends, stairs])
    return run


def _target(minima: np.ndarray):
    """The block in which an open search (blk, right, d) ends; -1 if it ends at the last place."""
    rmq = RangeMinimum(np.append(minima, -2))  # a search to the right ends behind the last block

    def run(batches):
        for pdf in batches:
            blk, d, right = pdf["blk"].to_numpy(np.int64), pdf["d"].to_numpy(np.int64), pdf["right"].to_numpy(bool)
            to = np.empty(len(pdf), np.int64)
            to[right] = rmq.right(blk[right], d[right]) + 1
            to[~right] = rmq.left(blk[~right] - 1, d[~right])
            # left() leaves a range it can extend; what ends it is its first value
            to[right & (to >= len(minima))] = -1
            yield pdf.assign(to=to)
    return run


def _digests(batches):
    """SHA-256 of the comma-joined ids of every node, from rows sorted by node and id: a running
    hash is all that is kept."""
    node, acc = None, None
    for batch in batches:
        l, d, conv = (batch.column(k).to_numpy() for k in range(3))
        cut = np.flatnonzero(np.append(True, (np.diff(l) != 0) | (np.diff(d) != 0))) if len(l) else []
        done = []
        for a, b in zip(cut, [*cut[1:], len(l)]):
            text = ",".join(map(str, conv[a:b].tolist())).encode()
            if node == (l[a], d[a]):
                acc.update(b"," + text)
                continue
            if node is not None:
                done.append((*node, acc.hexdigest()))
            node, acc = (l[a], d[a]), hashlib.sha256(text)
        if done:
            yield _digest_rows(done)
    if node is not None:
        yield _digest_rows([(*node, acc.hexdigest())])


def _digest_rows(done):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()),
                                       pa.array([x[2] for x in done])], names=["l", "d", "ends_sha256"])


def subtree_sums(nodes: DataFrame, size: int, weights: list[str], scratch: Scratch) -> DataFrame:
    """``nodes`` (l, d, r) with the sums of ``weights`` over their subtrees: all nodes that follow
    in depth-first order (l, d) up to place r. Sums run within blocks of places; a window over the
    blocks' totals (their number is bounded) adds what lies before."""
    rows = nodes.select("l", "d", F.col("l").alias("at"), F.col("d").alias("depth"), *weights)
    far = F.lit((1 << 62)).cast("long")
    asks = nodes.select("l", "d", F.col("r").alias("at"), far.alias("depth"), *[F.lit(0).cast("long").alias(w) for w in weights])
    both = scratch.stage(rows.unionByName(asks).withColumn("blk", F.expr(f"at div {size}")), "trie_sums")
    totals = both.groupBy("blk").agg(*[F.sum(w).alias(w) for w in weights])
    before = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    off = totals.select("blk", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_off") for w in weights])
    run = Window.partitionBy("blk").orderBy("at", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.select("l", "d", "blk", (F.col("depth") == far).alias("ask"), *weights, *[F.sum(w).over(run).alias(f"{w}_run") for w in weights])
    summed = summed.join(off, "blk")
    part = []
    for w in weights:
        upto = F.col(f"{w}_run") + F.col(f"{w}_off")
        part.append((F.max(F.when(F.col("ask"), upto)) - F.max(F.when(~F.col("ask"), upto - F.col(w)))).alias(f"{w}_sub"))
    return summed.groupBy("l", "d").agg(*part)


def trie(turns: DataFrame, block: int = 4096, most_blocks: int = 1 << 16) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. The driver gathers one minimum per block (``most_blocks`` at most)."""
    scratch = Scratch(turns.sparkSession)
    seqs = scratch.stage(rebuilt(turns, scratch), "trie_rebuilt")
    total = seqs.count()
    size = max(block, -(-total // most_blocks))
    placed = positions(seqs, [], ["seq", "conv_id"], scratch, "trie_sorted")
    # each block also gets the last sequence of the one before it
    blk = F.expr(f"pos div {size}")
    edge = (F.expr(f"pos % {size} = {size - 1}")) & (F.col("pos") < total - 1)
    cut = placed.select("*", F.explode(F.when(edge, F.array(blk, blk + 1)).otherwise(F.array(blk))).alias("blk"))
    found = scratch.stage(cut.groupBy("blk").applyInArrow(_block(size, total), _NODES), "trie_found")
    stairs = found.where("kind = 'b'")
    minima = np.array([r.low for r in stairs.select("blk", "low").orderBy("blk").collect()], np.int64)
    # searches that left their block: once per block, side and depth
    n, ends = found.where("kind = 'n'"), found.where("kind = 'e'")
    # (a parent's left end is the left end of a node of the same block, so nodes ask for it too)
    asked = (n.where("l IS NULL").select("blk", "d", F.lit(False).alias("right"))
             .union(n.where("r IS NULL").select("blk", "d", F.lit(True))).distinct())
    asked = asked.mapInPandas(_target(minima), "blk long, d long, right boolean, to long")
    step = stairs.select(F.col("blk").alias("to"), "top", "end")
    a = asked.join(step, "to", "left")
    place = lambda c: F.expr(f"filter({c}, x -> x.low < d)[0].at")
    answers = scratch.stage(a.select("blk", "d", "right", F.when(F.col("to") < 0, total - 1).when(F.col("right"), place("top") - 1)
                                     .otherwise(place("end")).alias("place")), "trie_answers")
    lefts = answers.where("NOT right").select("blk", "d", F.col("place").alias("l2"))
    rights = answers.where("right").select("blk", "d", F.col("place").alias("r2"))
    ups = lefts.select("blk", (F.col("d") + 1).alias("d"), F.col("l2").alias("p2"))
    n = (n.join(lefts, ["blk", "d"], "left").join(rights, ["blk", "d"], "left").join(ups, ["blk", "d"], "left")
         .select(F.coalesce("l", "l2").alias("l"), "d", F.coalesce("r", "r2").alias("r"),
                 F.when(F.col("d") > 0, F.coalesce("pl", "p2")).alias("pl"), "low", "points"))
    nodes = scratch.stage(n.groupBy("l", "d").agg(F.min("low").alias("conv_id"), F.max("r").alias("r"), F.min("pl").alias("pl"), F.max("points").alias("points"))
                          .withColumn("n_convs", F.col("r") - F.col("l") + 1), "trie_nodes")
    kids = nodes.where("d > 0").groupBy(F.col("pl").alias("l"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    own = nodes.join(kids, ["l", "d"], "left").select("l", "d", "r", F.coalesce("n_children", F.lit(0)).alias("n_children"), "points", "n_convs")
    own = scratch.stage(own.withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                        .withColumn("saved", (F.col("n_convs") - 1) * F.col("points")), "trie_weighed")
    sums = subtree_sums(own, size, ["leaf", "saved"], scratch)
    ids = ends.join(lefts, ["blk", "d"], "left").select(F.coalesce("l", "l2").alias("l"), "d", "conv")
    digests = ids.repartition("l", "d").sortWithinPartitions("l", "d", "conv").mapInArrow(_digests, "l long, d long, ends_sha256 string")
    up = nodes.select(F.col("l").alias("pl"), (F.col("d") + 1).alias("d"), F.col("conv_id").alias("parent_conv_id"))
    out = (nodes.join(own.select("l", "d", "n_children"), ["l", "d"]).join(sums, ["l", "d"]).join(digests, ["l", "d"], "left")
           .join(up, ["pl", "d"], "left"))
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaf_sub").alias("n_leaves"),
                      F.col("saved_sub").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


TRIE_SQL = f"""
WITH own AS MATERIALIZED (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS items,
         ({CRC32_SQL.format(n='conv_id')} % 6)::INTEGER AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
re AS MATERIALIZED (
  SELECT o.conv_id, list_concat(coalesce(b.items[1:o.h], []), o.items[o.h + 1:]) AS items
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
pre AS MATERIALIZED (SELECT conv_id, u.d, items[1:u.d] AS k, len(items) = u.d AS ends FROM re, unnest(range(0, len(items) + 1)) u(d)),
node AS MATERIALIZED (
  SELECT k, d, min(conv_id) AS c, count(*) AS n, list(conv_id ORDER BY conv_id) FILTER (WHERE ends) AS e,
         CASE WHEN d > 0 THEN (count(*) - 1) * length(k[d].x) ELSE 0 END AS w
  FROM pre GROUP BY k, d),
kids AS MATERIALIZED (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
weighed AS MATERIALIZED (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids USING (k, d)),
sub AS (SELECT s.k[1:u.d] AS k, u.d AS d, sum((s.kids = 0)::INTEGER) AS leaves, sum(s.w) AS saved FROM weighed s, unnest(range(0, s.d + 1)) u(d) GROUP BY 1, 2)
SELECT a.c AS conv_id, a.d AS depth, p.c AS parent_conv_id, a.n AS n_convs, a.kids AS n_children, sub.leaves::BIGINT AS n_leaves,
       sub.saved::BIGINT AS saved_tokens, sha256(coalesce(array_to_string(a.e, ','), '')) AS ends_sha256
FROM weighed a JOIN sub USING (k, d) LEFT JOIN node p ON p.d = a.d - 1 AND p.k = a.k[1:a.d - 1]
"""
