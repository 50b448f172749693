"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct ``n``-word shingles (64-bit hashes). Two sets of sizes a
and b link when 100 * common >= percent * union; then they differ in at most
d = (100 - percent) (a + b) / (100 + percent) shingles. Sizes are cut into bands. In a band the
domain of shingles is partitioned, and

* small sets (d up to 3): d + 2 partitions, every pair of partitions is a signature; sets that
  differ in d shingles agree on two partitions at least;
* larger sets: band_d + 1 + e partitions; a set writes the signatures of its first d + 1 + e,
  d by its own size, so sets that link agree on e + 1 of them at least, and each set may leave
  out its e poorest (those with few or no shingles, which unlike sets would share by chance).

A set writes signatures for its own band and, where a larger partner lies in the next band, for
that one too. Sets that share a signature are candidates; a link needs the exact count.

Work on a signature's sets: equal sets are one set. Every group first tests its members against
one member (its centre; in further rounds every group draws another one, so a group of copies
gets many) unless they are already connected; what is then not connected within a group is tested in full. So a group of copies costs a few
tests per member and not all pairs, and no link is lost. A test looks at sizes and at a sketch
of parities, then at a sketch that grows with the set (a few bits a shingle), before it reads the
sets; no linked pair fails one.

Hashes are of 64 bits: unlike shingles are taken for equal with a chance of 2^-64 per pair.
Null, empty and blank texts have an empty set and link with nothing; fewer than n words make one
shingle; repeated rows are rows of their own; ties go to the smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .scratch import Scratch, row_key

_STEP = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x94D049BB133111EB))
U = np.uint64


def shingle_sets(col: pa.Array, n: int):
    """Sorted distinct shingle hashes of each text of a column (lower case A-Z)."""
    for _, _, data, off in tk.text_slices(col):
        data = tk.LOWER[data]
        starts, ends, first = tk.words(data, off)
        h = tk.span_hash(tk.prefix_hash(data), starts, ends)
        run = np.zeros(max(len(h) - n + 1, 0), U)
        for i in range(n):
            run = run * _STEP[0] + h[i: i + len(run)] * _STEP[1 + i % 4]
        run = tk.mix(run)
        for a, b in zip(first.tolist(), first[1:].tolist()):
            if b - a >= n:
                yield np.unique(run[a: b - n + 1])
            elif b > a:
                acc = U(b - a)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        acc = acc * _STEP[2] + x
                yield tk.mix(np.array([acc], U))
            else:
                yield np.zeros(0, U)


class PartEnum:
    """Signatures for one threshold (in percent)."""

    def __init__(self, percent: int, ratio: float = 1.6):
        self.percent = percent
        self.edges = [0]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 5 if len(self.edges) == 1 else 0, int(self.edges[-1] * ratio)))

    def differ(self, total: int) -> int:
        """Most shingles in which linked sets of ``total`` shingles together differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    def bands(self, size: int):
        """(band, d) for which a set of this size writes signatures."""
        i = int(np.searchsorted(self.edges, size, "left"))  # edges[i-1] < size <= edges[i]
        far = self.largest_partner(size)
        yield i, self.differ(size + min(far, self.edges[i]))
        if far > self.edges[i]:
            yield i + 1, self.differ(size + far)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Signatures of a sorted set; a set that can only link with equal ones has none."""
        mixed, size, out = tk.mix(s ^ _STEP[3]), len(s), []
        for band, d in self.bands(size):
            top = self.differ(2 * self.edges[band])
            if not top:
                continue
            seed = U(band << 40)
            small = top <= 3
            extra = 0 if small else -(-top * 15 // 100) + 1
            parts = top + 2 if small else top + 1 + extra
            cuts = np.searchsorted(s, (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(U))
            cuts = np.concatenate([[0], cuts, [size]])
            sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed)])
            per, count = sums[cuts[1:]] - sums[cuts[:-1]], np.diff(cuts)
            if small:
                a, b = np.triu_indices(parts, 1)
                out.append(tk.mix((per[a] * _STEP[0] + per[b]) ^ tk.mix(U(1) + a.astype(U) * U(parts) + b.astype(U) + seed)))
                continue
            keep = min(d + 1 + extra, parts)
            per, count = per[:keep], count[:keep]
            poor = 0
            while (count < poor + 1).sum() <= extra and poor < 3:
                poor += 1
            j = np.flatnonzero(count >= poor)
            out.append(tk.mix(per[j] ^ tk.mix(j.astype(U) + seed + U(1 << 32))))
        return np.concatenate(out) if out else np.zeros(0, U)


def _profile(n: int, percent: int, most: int):
    def run(batches):
        enum, seen = PartEnum(percent), set()
        for batch in batches:
            size, ident, sigs = [], [], []
            for s in shingle_sets(batch.column(1), n):
                key = int(tk.signed(tk.mix(s ^ _STEP[4]).sum(dtype=U, keepdims=True))[0])
                size.append(len(s))
                ident.append(key)
                # of equal sets in a task, the first writes the signatures
                if not len(s) or key in seen:
                    sigs.append(np.zeros(0, np.int64))
                    continue
                if len(seen) < most:
                    seen.add(key)
                sigs.append(tk.signed(enum.signatures(s)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(ident, pa.int64()),
                                              pa.array(sigs, pa.list_(pa.int64())), batch.column(2)], names=["doc_id", "n_shingles", "id", "sigs", "row_key"])
    return run


def _groups(batches):
    """From rows sorted by (sig, id): the distinct ids of every signature that two sets share.
    Streams: only the last id is carried from batch to batch."""
    carry = None  # the last row: sig, id, n, whether it was written
    for batch in batches:
        sig, ident, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        done = np.zeros(len(sig), bool)
        if carry is not None:
            sig, ident, n = np.append(carry[0], sig), np.append(carry[1], ident), np.append(carry[2], n)
            done = np.append(carry[3], done)
        new = np.append(True, (sig[1:] != sig[:-1]) | (ident[1:] != ident[:-1]))
        sig, ident, n, done = sig[new], ident[new], n[new], done[new]
        same = np.append(sig[1:] == sig[:-1], False)
        out = (same | np.append(False, same[:-1]) | done) if len(sig) else same
        write = out & ~done
        carry = (sig[-1], ident[-1], n[-1], bool(out[-1])) if len(sig) else carry
        if write.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[write]), pa.array(ident[write]), pa.array(n[write])], names=["sig", "id", "n"])


def _pack(s: np.ndarray) -> bytes:
    """The upper six bytes of each hash."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(">u8").reshape(-1)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles in 512 buckets, as eight longs: sets that differ in d shingles
    differ in d bits at most."""
    odd = np.bincount((tk.mix(s ^ _STEP[0]) >> U(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SKETCH = [f"s{i}" for i in range(8)]


def wide_sketch(s: np.ndarray) -> bytes:
    """Parities of a set's shingles in the power of two of buckets next to twice its size, 512 at
    least. Two neighbouring buckets make one of half as many, so unlike lengths compare."""
    k = max(9, (2 * len(s) - 1).bit_length())
    odd = np.bincount((tk.mix(s ^ _STEP[1]) >> U(64 - k)).astype(np.int64), minlength=1 << k) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """Differing bits of two wide sketches, the longer one folded: at most the number of shingles
    in which the sets differ."""
    a, b = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in sorted((x, y), key=len))
    return int((a ^ np.bitwise_xor.reduce(b.reshape(len(a), -1), axis=1)).sum())


def _features(n: int):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), n))
            bits = np.stack([sketch(s) for s in sets]) if sets else np.zeros((0, 8), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_pack(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(bits[:, i]) for i in range(8)),
                                              pa.array([wide_sketch(s) for s in sets], pa.binary())], names=["id", "set", "n", *SKETCH, "wide"])
    return run


def _near_sketches(percent: int):
    def run(batches):
        for batch in batches:
            _, _, x, y, total = (batch.column(i).to_pylist() for i in range(5))
            keep = pa.array([(100 + percent) * parity_distance(*v[:2]) <= (100 - percent) * v[2] for v in zip(x, y, total)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])
    return run


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _unpack(x.as_py()), _unpack(y.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])
    return run


def _could_link(percent: int, a: str = "a", b: str = "b"):
    """What sizes (n) and sketches of linked sets must hold; columns under ``a`` and ``b``."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * bits <= (100 - percent) * (na + nb))


def similar_sets(docs: DataFrame, n: int = 4, percent: int = 85, rounds: int = 2, most_seen: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(profile, links) of ``docs`` (doc_id, text). profile: doc_id, n_shingles, id, row_key per row
    (equal sets have equal ids); links: a, b, pairs of set ids that connect the very sets that
    links connect. ``rounds`` - 1 further centres are tried before groups are tested in full;
    ``most_seen`` bounds what a task remembers of its own sets; it only
    saves repeated signatures."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key"))
    signed = scratch.stage(d.mapInArrow(_profile(n, percent, most_seen), "doc_id long, n_shingles long, id long, sigs array<long>, row_key long"), "jaccard_signatures")
    rows = signed.select(F.explode("sigs").alias("sig"), "id", F.col("n_shingles").alias("n"))
    groups = scratch.stage(rows.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(_groups, "sig long, id long, n long"), "jaccard_groups")
    profile = scratch.stage(signed.drop("sigs"), "jaccard_profile")
    scratch.drop(signed)
    # one document of each candidate set brings the set's shingles
    of = profile.join(groups.select("id").distinct(), "id").groupBy("id").agg(F.min_by("doc_id", "row_key").alias("doc_id"), F.min("row_key").alias("row_key"))
    of = scratch.stage(of, "jaccard_wanted")
    # (the wanted ones grow with the corpus, so at every size both sides are shuffled; repeated
    # rows leave within the partitioning of the join, so texts are shuffled once)
    wanted = d.join(of.select("id", "row_key").hint("merge"), "row_key").select("row_key", "id", "text").dropDuplicates(["row_key", "id"]).select("id", "text")
    sets = scratch.stage(wanted.mapInArrow(_features(n), "id long, set binary, n long, " + ", ".join(f"{s} long" for s in SKETCH) + ", wide binary"), "jaccard_sets")
    sketches = sets.drop("set", "wide")

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of the pairs, which are written first: few pairs are then broadcast to
        the sets by their size, many are joined by shuffles. Unlike pairs leave by their wide
        sketches, so the sets themselves move for likely links only."""
        near = scratch.stage(pairs.distinct(), "jaccard_pairs")
        x, y = (sets.select(F.col("id").alias(c), F.col("wide").alias(f"w_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
        wide = near.join(x, "a").join(y, "b").select("a", "b", "w_a", "w_b", (F.col("n_a") + F.col("n_b")).alias("total"))
        p = scratch.stage(wide.mapInArrow(_near_sketches(percent), "a long, b long"), "jaccard_near")
        scratch.drop(near)
        x, y = (sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        out = scratch.stage(p.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long"), "jaccard_links")
        scratch.drop(p)
        return out

    ordered = [F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")]
    centre = groups.groupBy("sig").agg(F.min("id").alias("a"))
    star = groups.join(centre, "sig").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    pairs = star.join(sketches.alias("a"), F.col("a.id") == star["a"]).join(sketches.alias("b"), F.col("b.id") == star["b"])
    links = verified(pairs.where(_could_link(percent)).select(*ordered))
    for r in range(1, rounds + 1):
        label = components(links, scratch)
        links = label.where("v <> c").select(F.col("v").alias("a"), F.col("c").alias("b"))
        g = groups.select("sig", "id").join(label.withColumnsRenamed({"v": "id"}), "id", "left").withColumn("c", F.coalesce("c", "id"))
        open_ = g.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("sig")
        g = scratch.stage(g.join(open_, "sig").join(sketches, "id"), "jaccard_open")
        if r < rounds:
            y = g.groupBy("sig").agg(F.min(F.struct(F.xxhash64(F.lit(r), "sig", "id"), *g.drop("sig").columns)).alias("m")).select("sig", "m.*")
            on = "a.sig = b.sig and a.c <> b.c"
        else:
            y, on = g, "a.sig = b.sig and a.c < b.c"
        pairs = g.alias("a").join(y.alias("b"), F.expr(on) & _could_link(percent))
        links = links.unionByName(verified(pairs.select(*ordered)))
        scratch.drop(g)
    scratch.drop(groups, of, sets)
    return profile, links


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """near_duplicates with c, the component itself: unlike components may report one id (that of
    a repeated doc_id, or null)."""
    scratch = Scratch(docs.sparkSession)
    profile, links = similar_sets(docs, n, percent)
    label = components(links, scratch).select(F.col("v").alias("id"), "c")
    p = profile.join(label, "id", "left").withColumn("c", F.coalesce("c", "id"))
    least = p.where("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = p.join(least, "c", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "row_key", "c")


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links,
    its own without any), row_key."""
    return _grouped(docs, n, percent).drop("c")


def first_of_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group of linked or equal sets: that of the smallest id (then
    row key). Rows without words are in no group and all stay."""
    near = _grouped(docs, n, percent)
    grouped = near.where("n_shingles > 0")
    least = grouped.groupBy("c").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "row_key"))["row_key"].alias("row_key"))
    keep = least.select("row_key", F.lit(True).alias("grouped")).union(
        near.where("n_shingles = 0").select("row_key", F.lit(False)).distinct())
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("row_key")).join(keep, "row_key")
    rank = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    return rows.withColumn("rank", rank).where("not grouped or rank = 1").select("row.*")
