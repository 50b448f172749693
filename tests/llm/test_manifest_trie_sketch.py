"""Merkle manifest, conversation trie and SetSketch near duplicates against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("livepricing.llm")
from pyspark.sql import functions as F  # noqa: E402

from livepricing.llm import merkle, setsketch, textkit, trie  # noqa: E402


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, add=0):
        return digest(field(r[0]), field(r[1]), field(r[2]), field(r[3] if r[3] is None else r[3] + add), field(r[4]))

    def build(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][j:j + 2]) for j in range(0, len(out[-1]), 2)])
        return out

    def path(levels, i):
        for level in levels[:-1]:
            yield (level[i ^ 1] if i ^ 1 < len(level) else None), i & 1
            i //= 2

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        rs = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = rs, build([leaf(r) for r in rs])
    top = build([trees[lang][1][-1][0] for lang in order])
    for n, lang in enumerate(order):
        rs, levels = trees[lang]
        for i, r in enumerate(rs):
            p = [*path(levels, i), *path(top, n)]
            x = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for sibling, odd in p:
                x = digest(x) if sibling is None else digest(sibling, x) if odd else digest(x, sibling)
            yield r[0], leaf(r), levels[-1][0], top[-1][0], digest(*[s for s, _ in p if s]), x, x == top[-1][0]


DOC = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("stride", [1, 3, 10])
def test_manifest(spark, stride):
    rng = random.Random(5)
    rows = [(i, rng.choice(["web", "é:1", None]), rng.choice(["en", "en", "en", "de", "zh", None, "Z"]), rng.choice([None, i, 2 ** 62]), rng.choice(["", "x" * i, "naïve 😀", None]))
            for i in range(60)]
    rows += [rows[7], rows[7], (None, None, None, None, None), (None, "s", "en", 4, "t"), (8, "other", "en", 1, "same id")]
    d = spark.createDataFrame(rows, DOC).repartition(3).withColumn("pos", F.lit("clash")).withColumn("_id", F.lit(1))
    got = sorted(map(repr, map(tuple, merkle.manifest(d, stride).collect())))
    assert got == sorted(map(repr, brute_manifest(rows)))
    assert any("False" in x for x in got) and any("True" in x for x in got)


def test_manifest_small_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0
    one = [(3, None, None, None, "long " * 200_000)]
    assert [tuple(r) for r in merkle.manifest(spark.createDataFrame(one, DOC)).collect()] == list(brute_manifest(one))


def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    seq = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        seq[c] = own.get(base, [])[:h] + v[h:]
    members, kids = {}, {}
    for c, v in seq.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = sum(saved[x] for x in below) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seq[c]) == len(k)))
        yield min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], digest(ends)


TURN = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [2, 64, 4096])
def test_trie(spark, block):
    rng = random.Random(3)
    rows = [(c, None if rng.random() < .1 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é😀", "", None]))
            for c in range(-120, 330) for t in range(rng.choice([0, 1, 2, 4, 9]))]
    rows += [(900, t, "user", "hot") for t in range(9)] + [(901 + k, t, "user", "hot") for k in range(60) for t in range(9)]
    rows += [(None, 0, "user", "nobody's"), rows[0], rows[0], (5000, 0, "user", "long " * 100_000)]
    d = spark.createDataFrame(rows, TURN).repartition(3).withColumn("pos", F.lit(1)).withColumn("points", F.lit("x"))
    assert sorted(map(repr, map(tuple, trie.trie(d, block=block).collect()))) == sorted(map(repr, brute_trie(rows)))


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURN)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURN)).count() == 0


def test_range_minimum():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, 70)
    rmq = trie.RangeMinimum(v)
    at, depth = np.repeat(np.arange(70), 6), np.tile(np.arange(6), 70)
    right, left = rmq.right(at, depth), rmq.left(at, depth)
    for a, d, r, s in zip(at, depth, right, left):
        assert r == next((x - 1 for x in range(a + 1, 70) if v[x] < d), 69)
        assert s == next((x for x in range(a, -1, -1) if v[x] < d), 0)


def brute_components(docs):
    def shingles(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
        return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    for i, (doc_id, _) in enumerate(docs):
        c = least.get(find(i)) if sets[i] else doc_id
        yield doc_id, len(sets[i]), c, doc_id == c


def test_near_duplicates(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijkl") + str(rng.randrange(40))
    docs = []
    for size in (3, 5, 6, 8, 12, 40, 300, 2500):
        base = [word() for _ in range(size)]
        docs.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 6):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(size)] = word()
            docs.append("  ".join(w).upper())
    hot = [word() for _ in range(120)]   # copies of one text, unlike each other at times
    for _ in range(150):
        w = list(hot)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(120)] = word()
        docs.append(" ".join(w))
    rows = [(i * 3, t) for i, t in enumerate(docs)] + [(9000, None), (9001, ""), (9002, " \t\n"), (None, docs[0]), (None, "alone here"), (9003, "alone here"), (6, docs[2])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("id", F.lit(1)).withColumn("sig", F.lit("x"))
    got = sorted(map(repr, map(tuple, setsketch.near_duplicates(d).collect())))
    assert got == sorted(map(repr, brute_components(rows)))
    assert setsketch.near_duplicates(d.limit(0)).count() == 0


def test_sketch_is_mergeable_and_estimates():
    rng = np.random.default_rng(1)
    u = textkit.mix(rng.integers(0, 1 << 62, 1200).astype(np.uint64))
    a, b = u[:1000], u[200:]
    r = setsketch.registers(np.concatenate([a, b, u]), np.repeat([0, 1, 2], [1000, 1000, 1200]), 3)
    assert (setsketch.merge(r[0], r[1]) == r[2]).all()
    j, _, _ = setsketch.joint_estimate(r[:1], r[1:2], np.array([1000.]), np.array([1000.]))
    assert abs(j[0] - 800 / 1200) < 0.12
