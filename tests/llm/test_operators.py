"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing extra columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("livepricing.llm")
from livepricing.llm import (decontaminate, html_text, jaccard, mixing, packing, sharding, substring_dedup,  # noqa: E402
                             suffix_array, token_scan, tokens, topk, toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, id long, size long, row struct<a: int>"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, 3, None) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [a + b for a in "the an re on ti ha es".split() for b in "nd er st ou ing".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(n) for n in (30, 80, 200, 600)]
    out = [(i, t, f"s{i % 2}") for i, t in enumerate(base)]
    for i in range(40):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((10 + i, " ".join(w), None if i % 5 == 0 else "s1"))
    out += [(60, None, "s0"), (61, "", "s0"), (62, " \t\n", None), (63, "One two", "s0"), (64, "one TWO", "s2"), (65, "é" * 300, "s2"),
            (66, "x" * 500 + base[1], "s2"), (67, base[0], "s0"), (67, base[0], "s0"), (None, base[2], "s0"), (70, text(20000), "s0")]
    return out


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_sharding(spark, rows):
    d = make(spark, rows).withColumn("v0", F.lit(1))
    a = sharding.shard_rows(d, n_shards=7, block_rows=9, bucket_rows=4)
    assert a.columns == [*d.columns, "shard", "slot"]
    got = a.collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_rows(d.limit(0), 7).count() == 0


def test_hypergeometric_beyond_numpy(monkeypatch):
    exact = [sharding.hypergeometric(np.random.default_rng(i), 300, 700, 200) for i in range(2000)]
    monkeypatch.setattr(sharding, "_POPULATION", 1)
    own = [sharding.hypergeometric(np.random.default_rng(i), 300, 700, 200) for i in range(2000)]
    assert abs(np.mean(own) - np.mean(exact)) < 0.5 and abs(np.std(own) / np.std(exact) - 1) < 0.1
    caps = np.array([5, 0, 7])
    total = sum(sharding.block_counts(1, np.array([0, 3, 4, 12]), caps, b) for b in range(3))
    assert (total == caps).all()


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard(spark, rows, n, percent):
    d = make(spark, rows)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(d, n, percent).collect())
    sets = [shingles(t, n) for _, t, _ in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if a and 100 * c >= percent * (len(a) + len(sets[j]) - c):
                top[find(i)] = find(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    want = collections.Counter((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _, _) in enumerate(rows))
    assert got == want
    if n == 5:
        kept = jaccard.first_of_groups(d, n, percent)
        assert kept.columns == d.columns
        groups = len({find(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)
        assert kept.count() == groups


def test_partenum_shares_a_signature():
    rng = np.random.default_rng(1)
    e = jaccard.PartEnum(85)
    for _ in range(400):
        size = int(rng.integers(6, 400))
        s = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        d = e.differ(2 * len(s))
        drop = int(rng.integers(0, d + 1))
        t = np.unique(np.concatenate([s[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, d + 1))).astype(np.uint64)]))
        c = len(np.intersect1d(s, t))
        if 100 * c >= 85 * (len(s) + len(t) - c) and c < max(len(s), len(t)):
            assert len(np.intersect1d(e.signatures(s), e.signatures(t)))
            bits = sum(int(x).bit_count() for x in (jaccard.sketch(s) ^ jaccard.sketch(t)).view(np.uint64))
            assert bits <= len(s) + len(t) - 2 * c


def test_wide_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 255, 256, 257, 3000):
        s = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for cut, more in ((0, 0), (size // 9, size // 9), (0, size // 4), (size, size)):
            t = np.unique(np.append(s[cut:], rng.integers(0, 1 << 63, more).astype(np.uint64)))
            x, y = jaccard.wide_sketch(s), jaccard.wide_sketch(t)
            apart = len(np.setxor1d(s, t))
            assert jaccard.parity_distance(x, y) == jaccard.parity_distance(y, x) <= apart
            assert jaccard.parity_distance(x, y) > 0.2 * apart or apart < 20


def test_packing(spark, rows):
    got = packing.pack(make(spark, rows), length=64, block_tokens=1000).collect()
    seg = collections.defaultdict(collections.Counter)
    for r in got:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 64 and r.cu_seqlens[-1] == r.n_tokens
        for d, at, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (pos[a:b] == range(b - a)).all()
            seg[d][at, ids[a:b].tobytes()] += 1
    for d, t, _ in rows:
        ids = np.array([*tokens.encode(t), tokens.end_id()], "<u2")
        for at in range(0, len(ids), 64):
            assert seg[d][at, ids[at:at + 64].tobytes()] == sum(x == (d, t) for x in ((a, b) for a, b, _ in rows))
    assert len({r.pack_id for r in got}) == len(got)


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 40))]
        room, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(r, j) for j, r in enumerate(room) if r >= sizes[i]]
            if fits:
                r = min(fits)[0]
                j = next(j for j, x in enumerate(room) if x == r)
            else:
                j = len(room)
                room.append(20)
            room[j] -= sizes[i]
        got = packing.best_fit_decreasing(sizes, 20)
        assert sorted(20 - sum(sizes[i] for i in r) for r in got) == sorted(room)


def test_tokens_of_long_texts():
    e = tokens.encoding()
    text = ("word and " * 20000) + "  x"
    assert tokens.encode(text) == e.encode_ordinary(text)
    for t in (" " * 300_000, "x" + " \n" * 50_000 + "y", "a" * 100_000):
        assert e.decode(tokens.encode(t)) == t


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(500):
        t = rng.integers(0, int(rng.choice([1, 2, 4, 26])), int(rng.integers(1, 50)))
        t = np.concatenate([t, t, t]) if rng.random() < 0.3 else t
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffix_array.suffix_array(t).tolist() == want
        plcp = suffix_array.permuted_lcp(t, np.array(want), 20)
        for a, b in zip(want, want[1:]):
            common = next((i for i in range(len(t)) if b + i >= len(t) or a + i >= len(t) or t[a + i] != t[b + i]), len(t))
            assert plcp[b] == min(common, 20)


def test_substring_dedup(spark, rows):
    got = collections.Counter(tuple(r) for r in substring_dedup.repeated_spans(make(spark, rows), block_bytes=4000).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for doc, t, _ in order:
        b = (t or "").encode()
        for i in range(len(b) - 99):
            first.setdefault(b[i:i + 100], (doc, i))
    want = collections.Counter()
    for doc, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i:i + 100]] != (doc, i):
                gone[i:i + 100] = b"\1" * 100
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[doc, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    assert got == want


def test_mixing(spark, rows):
    d = make(spark, rows)
    sized = d.select("source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.source_plan(sized, block_tokens=32)
    p = {r.source: r for r in plan.collect()}
    seats = round(sum(r.target for r in p.values()) / 32)
    won = collections.Counter()
    for _ in range(seats):
        s = min(p, key=lambda s: (-p[s].target / (2 * won[s] + 1), p[s].ord))
        won[s] += 1
    assert all(r.quota == min(won[s], 2 * r.blocks) for s, r in p.items())
    assert abs(sum(r.target for r in p.values()) - 1.5 * sum(r.source_size for r in p.values())) < 1e-6
    quotas = collections.Counter()
    for r in mixing.shard_quotas(plan, 5).collect():
        quotas[r.source] += r.quota
        assert abs(r.quota - p[r.source].quota / 5) < 1
    assert all(quotas[s] == r.quota for s, r in p.items())
    got = mixing.mix(d).collect()
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - r.target) <= 64 for s, r in p.items())
    again = mixing.mixed_documents(d)
    assert again.columns == d.columns and again.where("doc_id in (60, 61, 62)").count() == 0
    assert mixing.mix(d.limit(0)).count() == 0


def test_html():
    page = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><a>menu</a></nav><div class="cookie-notice">no</div>
    <article><header><h1>Tit&amp;le</h1></header><p>One <b>bo</b>ld<br>x<p>Two &lt;b&gt;&nbsp;y<!-- no --><div class="ad">no</div>
    <ul class="comments"><li>no</li></ul><form>no</form></article><aside>no</aside><footer>no</footer></body></html>"""
    assert html_text.main_text(page, set()) == "Tit&le One bold x Two <b> y"
    assert html_text.main_text(None, set()) == "" and html_text.main_text("a < b", set()) == "a < b"


def test_html_template(spark):
    pages = [(i, "http://h.example/%d" % i, f"<body><div id=x><h2>Site</h2><p>own {i}</p><p>Same line</p></div></body>") for i in range(12)]
    pages += [(20, None, None), (21, "nonsense", ""), (22, "http://h.example/0", pages[0][2])]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract(d).collect()}
    assert got == {i: f"own {i}" for i in range(12)} | {20: "", 21: "", 22: "own 0"}


def test_token_scan(spark, rows, tmp_path):
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_scan.document_tokens(make(spark, rows), block_tokens=50).collect())
    assert got == collections.Counter((d, len(tokens.encode(t))) for d, t, _ in rows)
    flat = np.array([1, 2, 9, 9, 3, 9, 4, 5, 6, 7], "<u2")
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for size in (2, 4, 6, 100):
        c = token_scan.token_counts(token_scan.read_blocks(spark, str(tmp_path), size), 9).orderBy("ordinal").collect()
        assert [(r.ordinal, r.n_tokens, r.finished) for r in c] == [(0, 2, True), (1, 0, True), (2, 1, True), (3, 4, False)]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vec = [rng.normal(size=4).tolist() for _ in range(150)]
    data = [(i, v) for i, v in enumerate(vec)] + [(200 + i, vec[0]) for i in range(60)]
    data += [(300, None), (301, [1.0, None, 2.0, 3.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (304, [0.5]), (5, vec[5]), (None, vec[1]), (350, [1e6] * 4)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(topk.quantised(d), F.col("vec_id") % 50 == 0, shard_rows=40, query_rows=3).orderBy("query_id", "rank").collect()]
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in data
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in ints if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert got == want


def test_toxicity(spark):
    rng = random.Random(4)
    words = [a + b + c for a in "abcde" for b in "nmrst" for c in "aeiou"]
    docs, labels = [], []
    for i in range(400):
        t, bad = [rng.choice(words) for _ in range(rng.randrange(5, 60))], i % 5 == 0
        if bad:
            t += rng.sample(["idiot", "moron", "scum"], 2)
        docs.append((i, " ".join(t), "s"))
        if i < 300:
            labels.append((i, 1, int(bad)))
    docs += [(500, None, "s"), (501, "", "s"), (None, "idiot moron", "s"), (502, "idiot " * 30000, "s")]
    d, lab = make(spark, docs), spark.createDataFrame([*labels, (3, 1, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == (i % 5 == 0) for i in range(400)) >= 395
    assert got[None].predicted == got[502].predicted == 1 and got[500].predicted == got[501].predicted == 0
    clean = toxicity.without_toxic(d, lab)
    assert clean.columns == d.columns and clean.count() == sum(not r.predicted for r in got.values())
    assert toxicity.toxicity(d, lab.limit(0)).where("predicted = 1").count() == 0 and toxicity.toxicity(d.limit(0), lab).count() == 0


def test_block_max_index_is_exact():
    rng = np.random.default_rng(6)
    vecs = []
    for _ in range(500):
        i = np.unique(rng.integers(0, 30, int(rng.integers(0, 6))))
        vecs.append((i, rng.integers(1, 4, len(i))))
    index = toxicity.Index(vecs, rng.integers(0, 2, 500).astype(float), rng.random(30) + 1)
    full = [v for v in vecs if len(v[0])]
    dense = np.zeros((len(full), 30))
    for n, (i, c) in enumerate(full):
        dense[n, i] = index.unit(i, c)
    for i, c in full[:60]:
        s = dense[:, i] @ index.unit(i, c)
        want = sorted(((-round(x, 12), n) for n, x in enumerate(s) if x > 0))[:16]
        assert [(-round(x, 12), n) for x, n in index.nearest(i, c, 16)] == want


def _edit_match(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 8, 20, 40))] + [(9, None), (10, " "), (11, "Tiny")]
    docs = [(1, None), (2, ""), (3, "nothing here")]
    for i in range(60):
        t = list(rng.choice(items[:4])[1])
        for _ in range(rng.randrange(0, 1 + len(t) // 6)):
            t[rng.randrange(len(t))] = rng.choice("xyz ")
        docs.append((10 + i, f"{word()} {word()}\n{''.join(t).upper()} {word()}"))
    docs.append((90, "tiny " * 3))
    d = make(spark, [(i, t, "s") for i, t in docs])
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(d, b, block_chars=100).collect()}
    want = {}
    for doc, t in docs:
        for i, x in items:
            p = decontaminate.normal(x)
            if p and t:
                e = _edit_match(p, decontaminate.normal(t))
                if e <= decontaminate.budget(len(p), 0.1, 30):
                    want[doc, i] = e
    assert got == want
    clean = decontaminate.without_leaks(d, b, block_chars=100)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.leaks(d, b.limit(0)).count() == 0
