"""Registered queries on the given tables, whole, against plain Python."""

import collections
import hashlib
import html as html_lib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("livepricing.llm")
from livepricing.llm import queries, sharding, tokens, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_op1(spark, docs):
    got = queries.op1_sharding(spark, SF).collect()
    text = {d.doc_id: (d.text or "").encode() for d in docs}
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in text.items())
    by = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_op1_names_that_clash(spark, tmp_path):
    d = spark.createDataFrame([(i, -i, f"t{i}", i) for i in range(20)], "slot long, Shard long, v0 string, slot_0 long")
    out = sharding.shard_rows(d, n_shards=3)
    assert out.columns == ["slot_1", "Shard_0", "v0", "slot_0", "shard", "slot"]
    out.write.parquet(str(tmp_path / "out"))
    assert sorted((r.slot_1, r.Shard_0) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(i, -i) for i in range(20)]


def test_op3(spark, docs):
    """Every document comes back whole from the packed ids."""
    kind, end, parts = tokens.id_type(), tokens.end_id(), collections.defaultdict(dict)
    for r in queries.op3_token_packing(spark, SF).collect():
        ids, pos = np.frombuffer(r.input_ids, kind), np.frombuffer(r.position_ids, "<u2")
        assert r.n_tokens == r.cu_seqlens[-1] <= 2048 == len(ids) == len(pos)
        for doc, start, lo, hi in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert start not in parts[doc] and pos[lo:hi].tolist() == list(range(hi - lo))
            parts[doc][start] = ids[lo:hi].tolist()
    got = {doc: [x for s in sorted(p) for x in p[s]] for doc, p in parts.items()}
    assert got == {d.doc_id: [*tokens.encode(d.text), end] for d in docs}


def test_op4(spark, docs):
    seen, want = set(), []
    for d in sorted(docs, key=lambda d: d.doc_id):
        t = (d.text or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            w = t[i: i + 100]
            if w in seen:
                gone[i: i + 100] = True
            seen.add(w)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        want.append((d.doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = queries.op4_substring_dedup(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want


def test_op6(spark):
    """The given pages hold their text in one article without containers of other things."""
    def article(page):
        inside = re.search(r"<article>(.*)</article>", re.sub(r"<!--.*?-->", "", page or "", flags=re.S), re.S)
        text = re.sub(r"</?b>", "", inside[1]) if inside else ""
        return " ".join(html_lib.unescape(re.sub(r"<[a-z/][^>]*>", " ", text)).split())

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op6_html_extraction(spark, SF).collect()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got.values())
    assert {i: r.text for i, r in got.items()} == {p.page_id: article(p.html) for p in pages}


def test_op7(spark, docs):
    got = queries.op7_token_counts(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((d.doc_id, len(tokens.encode(d.text))) for d in docs)


def test_op8(spark, docs):
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, SF).collect()}
    assert sorted(got) == sorted(d.doc_id for d in docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op8_example_of_a_shared_id(spark):
    a, b = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5][:2]
    d = spark.createDataFrame([(a, "y"), (a, "x"), (a, None), (b, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, toxic int")
    for n in (1, 4):
        assert sorted(map(tuple, toxicity.examples(d.repartition(n), labels, 10).collect())) == [(a, "x", 1), (b, "z", 0)]
