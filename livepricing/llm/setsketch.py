"""Near duplicates from SetSketch registers: candidates by bands, joint estimate by likelihood, exact check.

A document is the set of its distinct ``n``-word shingles. Its sketch has m registers; register i
keeps floor(1 - log_b of the least of the set's exponential values there), cut to 0 .. q + 1. A
shingle's values come in ascending order (sums of exponential spacings, registers in an order of
its own), so a shingle stops as soon as its next value exceeds all minima of its set. Registers of a
union are the maxima of the registers (``merge``). With b = 1.001 two sets agree in a register with
a chance close to their Jaccard similarity J.

* Bands: 42 bands of 6 registers, drawn once. Sets of J = 0.85 share no band with a chance of
  (1 - J^6)^42 = 3e-9, more similar ones with less.
* Sets that share a band are tested by size, by two sketches of bits (parities of the shingles in
  512 buckets, where linked sets differ in no more bits than shingles; and of the registers, which
  0.85 allows to differ in 19 of 256 on average, over 56 with a chance of 4e-12) and by the
  likelihood of the counts of larger, smaller and equal registers, maximised over J: a pair leaves
  if J = 0.85 is e^20 times less likely than the best J. Registers thus decide what is looked at; a link needs the exact count
  on the full sets (64-bit hashes of shingles; unlike shingles are equal with a chance of 2^-64).
* A group of copies is no set of all pairs: equal sets are one set, every band's members are tested
  against the one that meets the most others over all its bands (an original meets its copies more
  often than they meet each other), components are formed, members of bands that still hold several
  components are tested against a drawn one, and only what then remains apart is tested member by
  member, behind the tests of sizes and bits.

Sets of one 64-bit fingerprint and one size are taken for equal. Null, empty and blank texts have an
empty set and link with nothing; fewer than n words make one shingle; repeated rows are rows of their
own; a component's id is its least doc_id (null where it has none). An empty table gives no rows,
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .jaccard import SKETCH, shingle_sets, sketch
from .scratch import Scratch, row_key

U = np.uint64
M, B, RATE, Q = 256, 1.001, 20.0, (1 << 16) - 2
BANDS = np.random.default_rng(12).permutation(M)[:252].reshape(42, 6)
PARITY_LIMIT = 56
LIKELIHOOD_LIMIT = 20.0
FLAT = 1 << 18  # shingles that are sketched together (a larger set alone)
_STEP = U(0x9E3779B97F4A7C15)


def registers(flat: np.ndarray, owner: np.ndarray, n_sets: int) -> np.ndarray:
    """Registers (n_sets x M, uint16) of sets given as hashes and the number of each one's set."""
    least = np.full(n_sets * M, np.inf)
    x = np.zeros(len(flat))
    seed = tk.mix(flat)
    start, stride = (seed & U(M - 1)).astype(np.int64), ((seed >> U(8)) & U(M - 1)).astype(np.int64) | 1
    base = owner.astype(np.int64) * M
    live = np.arange(len(flat))
    for j in range(M):
        draw = ((tk.mix(seed[live] + U(int(_STEP) * (j + 1) % (1 << 64))) >> U(11)).astype(np.float64) + 1.0) * 2.0 ** -53
        x[live] -= np.log(draw) / (M - j)
        np.minimum.at(least, base[live] + ((start[live] + j * stride[live]) & (M - 1)), x[live])
        if j < 8 or j % 4 == 0:
            limit = least.reshape(n_sets, M).max(axis=1)
        live = live[x[live] < limit[owner[live]]]
        if not len(live):
            break
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least / RATE) / np.log(B))
    return np.clip(np.nan_to_num(k, neginf=0.0), 0, Q + 1).astype(np.uint16).reshape(n_sets, M)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def signatures(regs: np.ndarray) -> np.ndarray:
    """One hash per set and band (n x 42, int64)."""
    h = np.broadcast_to(np.arange(len(BANDS), dtype=U) * _STEP, (len(regs), len(BANDS))).copy()
    for i in range(BANDS.shape[1]):
        h = tk.mix(h * U(0xC2B2AE3D27D4EB4F) + regs[:, BANDS[:, i]].astype(U) + U(1))
    return tk.signed(h)


def parities(regs: np.ndarray) -> np.ndarray:
    """The lowest bit of each register, as four longs."""
    return np.packbits((regs & 1).astype(np.uint8), axis=1).view(np.int64)


PARITY = [f"p{i}" for i in range(M // 64)]
BITS = [*PARITY, *SKETCH]


def _p(x: np.ndarray) -> np.ndarray:
    """Chance that a register is larger, for the share x of elements that speak for it."""
    return np.maximum(-np.log1p(-np.maximum(x, 0.0) * (B - 1) / B) / np.log(B), 1e-300)


def log_likelihood(j, larger, smaller, equal, u):
    """Of similarity j, given how many registers of the first set (share u of both sizes) are
    larger, smaller and equal."""
    up, down = _p(u - (1 - u) * j), _p(1 - u - u * j)
    return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-300))


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(most likely J, its log-likelihood, counts) of pairs of register rows; the likelihood is
    concave, so a ternary search finds its top."""
    counts = ((a > b).sum(axis=1), (a < b).sum(axis=1), (a == b).sum(axis=1), na / (na + nb))
    lo, hi = np.zeros(len(a)), np.minimum(na / nb, nb / na)
    for _ in range(50):
        one, two = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        right = log_likelihood(one, *counts) < log_likelihood(two, *counts)
        lo, hi = np.where(right, one, lo), np.where(right, hi, two)
    j = (lo + hi) / 2
    return j, log_likelihood(j, *counts), counts


def _profile(n: int, most_seen: int):
    """Per row its set's size and fingerprint; registers, parities and bands of the first of equal
    sets in a task."""
    def run(batches):
        seen = set()
        for batch in batches:
            size, ident, todo, held, regs, bits = [], [], [], 0, {}, {}

            def flush():
                if todo:
                    out = registers(np.concatenate([s for _, s in todo]), np.repeat(np.arange(len(todo)), [len(s) for _, s in todo]), len(todo))
                    regs.update((i, r) for (i, _), r in zip(todo, out))
                    bits.update((i, sketch(s)) for i, s in todo)
                    todo.clear()
            for s in shingle_sets(batch.column(1), n):
                key = int(tk.signed(tk.mix(s + _STEP).sum(dtype=U, keepdims=True))[0])
                size.append(len(s))
                ident.append(key)
                if not len(s) or (key, len(s)) in seen:
                    continue
                if len(seen) < most_seen:
                    seen.add((key, len(s)))
                todo.append((len(size) - 1, s))
                held += len(s)
                if held >= FLAT:
                    flush()
                    held = 0
            flush()
            rows = sorted(regs)
            r = np.stack([regs[i] for i in rows]) if rows else np.zeros((0, M), np.uint16)
            k = np.stack([bits[i] for i in rows]) if rows else np.zeros((0, len(SKETCH)), np.int64)
            at = np.full(len(size), -1, np.int64)
            at[rows] = np.arange(len(rows))
            gone = pa.array(at, mask=at < 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(ident, pa.int64()), batch.column(2),
                 pa.array([x.tobytes() for x in r], pa.binary()).take(gone), pa.array(list(signatures(r)), pa.list_(pa.int64())).take(gone),
                 *[pa.array(p, pa.int64()).take(gone) for p in np.hstack([parities(r), k]).T.copy()]],
                names=["doc_id", "n_shingles", "id", "row_key", "regs", "sigs", *BITS])
    return run


def _likely(percent: int):
    """The pairs whose registers do not speak against a link."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (2, 3))
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
            j, best, counts = joint_estimate(a, b, na, nb)
            keep = (j >= percent / 100) | (best - log_likelihood(percent / 100, *counts) <= LIKELIHOOD_LIMIT)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])
    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), n)], pa.binary())],
                                             names=["id", "set"])
    return run


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), U) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])
    return run


def _could_link(percent: int):
    """What sizes and bits of linked sets hold; columns under a and b."""
    na, nb = F.col("a.n"), F.col("b.n")

    def differ(columns):
        return sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in columns), F.lit(0))
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ(PARITY) <= PARITY_LIMIT)
            & ((100 + percent) * differ(SKETCH) <= (100 - percent) * (na + nb)))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 85, rounds: int = 2, most_seen: int = 1 << 20) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. ``percent`` must be 85 or more (the bands are
    drawn for it); ``rounds`` - 1 drawn members are tried per band before its members are tested
    one by one; ``most_seen`` bounds what a task remembers of its own sets."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key"))
    profile = scratch.stage(d.mapInArrow(_profile(n, most_seen), "doc_id long, n_shingles long, id long, row_key long, regs binary, sigs array<long>, "
                                         + ", ".join(f"{p} long" for p in BITS)), "setsketch_profile")
    rows = profile.where("sigs IS NOT NULL").select(F.explode("sigs").alias("sig"), "id")
    # partial aggregates find the bands that unlike sets share; a hot band moves one row per task
    shared = scratch.stage(rows.groupBy("sig").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("sig"), "setsketch_shared")
    groups = scratch.stage(rows.join(shared, "sig").distinct(), "setsketch_groups")
    wanted = groups.select("id").distinct()
    sketches = scratch.stage(profile.where("regs IS NOT NULL").join(wanted, "id", "left_semi")
                             .groupBy("id").agg(F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.min_by("row_key", "row_key").alias("row_key"),
                                                *[F.first(p).alias(p) for p in BITS]), "setsketch_sketches")
    small = sketches.drop("regs", "row_key")
    # (the wanted texts grow with the corpus, so both sides are shuffled at every size)
    texts = d.join(sketches.select("id", "row_key").hint("merge"), "row_key").select("id", "text", "row_key").dropDuplicates(["row_key", "id"])
    sets = scratch.stage(texts.select("id", "text").mapInArrow(_sets(n), "id long, set binary"), "setsketch_sets")

    def verified(pairs: DataFrame) -> DataFrame:
        near = scratch.stage(pairs.distinct(), "setsketch_pairs")
        x, y = (sketches.select(F.col("id").alias(c), F.col("regs").alias(f"r{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
        likely = scratch.stage(near.join(x, "a").join(y, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_likely(percent), "a long, b long"), "setsketch_likely")
        x, y = (sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        out = scratch.stage(likely.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long"), "setsketch_links")
        scratch.drop(near, likely)
        return out

    ordered = [F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")]
    met = groups.join(groups.groupBy("sig").agg(F.count("*").alias("size")), "sig").groupBy("id").agg(F.sum("size").alias("met"))
    centre = groups.join(met, "id").groupBy("sig").agg(F.max(F.struct("met", "id"))["id"].alias("first"))
    star = groups.join(centre, "sig").where("id <> first").select("id", "first").distinct()
    pairs = star.join(small.alias("a"), F.col("a.id") == star["first"]).join(small.alias("b"), F.col("b.id") == star["id"])
    links = verified(pairs.where(_could_link(percent)).select(*ordered))
    for r in range(1, rounds + 1):
        label = components(links, scratch)
        links = label.where("v <> c").select(F.col("v").alias("a"), F.col("c").alias("b"))
        g = groups.select("sig", "id").join(label.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("c", "id"))
        several = g.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("sig")
        g = scratch.stage(g.join(several, "sig").join(small, "id"), "setsketch_open")
        if r < rounds:
            drawn = g.groupBy("sig").agg(F.min(F.struct(F.xxhash64(F.lit(r), "sig", "id"), *g.drop("sig").columns)).alias("m")).select("sig", "m.*")
            other, on = drawn, "a.sig = b.sig and a.c <> b.c"
        else:
            other, on = g, "a.sig = b.sig and a.c < b.c"
        links = links.unionByName(verified(g.alias("a").join(other.alias("b"), F.expr(on) & _could_link(percent)).select(*ordered)))
        scratch.drop(g)
    label = components(links, scratch).select(F.col("v").alias("id"), "c")
    p = profile.select("doc_id", "n_shingles", "id").join(label, "id", "left").withColumn("c", F.coalesce("c", "id"))
    least = p.where("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("least"))
    out = p.join(least, "c", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


SETSKETCH_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM t),
x AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, links.b FROM r JOIN links ON links.a = r.other)
SELECT doc_id, any_value(len(sh))::BIGINT AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept FROM r JOIN s USING (doc_id) GROUP BY doc_id
"""
