"""Cases that earlier versions cut short."""

import random

import pytest

pytest.importorskip("livepricing.llm")
from livepricing.llm import decontaminate, html_text, jaccard, substring_dedup, toxicity  # noqa: E402

DOCS = "doc_id long, text string"


def unlike(rng, n=60):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_repeated_rows_keep_their_only_text(spark):
    rng = random.Random(1)
    a, b, c, end = (unlike(rng) for _ in range(4))
    # in all unlike texts; null ids with one beginning; a copy in a later document
    rows = [(1, a), (1, a), (None, b + " " + end), (None, b), (None, b + " " + end), (2, c), (2, c), (2, c), (3, c)]
    for n in (1, 3):
        d = spark.createDataFrame(rows, DOCS).repartition(n)
        got = sorted((r.doc_id or 9, r.n_bytes, r.n_removed) for r in substring_dedup.repeated_spans(d).collect())
        want = sorted((i or 9, len(t), len(t) if i == 3 else 0) for i, t in rows)
        assert got == want


def test_sift_carries_the_first_row_across_batches():
    import pyarrow as pa
    rows = [(5, 7, 1, 256), (5, 7, 1, 256), (5, 7, 1, 256), (5, 7, 1, 512), (5, 7, 2, 256), (6, 7, 2, 256), (6, 7, 2, 256)]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i:i + size])], names=["anchor", "ctx", "doc", "place"])
                   for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in substring_dedup._sift(batches) for r in b.to_pylist()]
        assert got == [("copy", *rows[3]), ("copy", *rows[4])]


def test_unlike_components_of_one_id_all_stay(spark):
    rng = random.Random(2)
    t = [unlike(rng) for _ in range(6)]
    # three unlike null ids, one of them twice; two unlike texts under one id, one copied under another
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (None, t[2]), (4, t[3]), (4, t[4]), (5, t[4]), (6, t[5])]
    d = spark.createDataFrame(rows, DOCS)
    kept = jaccard.first_of_groups(d, n=5, percent=80).collect()
    assert sorted(r.text for r in kept) == sorted(t)
    assert all(r.doc_id != 5 for r in kept) and kept[0].__fields__ == d.columns
    assert "c" not in jaccard.near_duplicates(d).columns


ARTICLE = "<article><h1>T</h1><p>body</p><div class=ad>no</div></article>"


@pytest.mark.parametrize("page", [
    "<div class='has-sidebar'>%s</div>", "<div class='no-sidebar'>%s</div>", "<div class='layout with-sidebar'>%s</div>",
    "<div class='search-results'>%s</div>", "<html class='x no-footer'><body>%s</body></html>", "<html class=footer>%s</html>",
    "<form>%s</form>", "<div class=discussion>%s</div>", "<main><div class=widget>%s</div></main>", "<head><meta a=b><body>%s",
    "<div class=comments><article>no</article></div>%s<form>no</form><div class='has-ads widget'>no</div>"])
def test_names_around_the_main_element(page):
    assert html_text.main_text(page % ARTICLE, set()) == "T body"


@pytest.mark.parametrize("inner, want", [
    ("<p class=ad>no<p>one<p>two", "one two"), ("<p class=ad>no<div>one</div>", "one"),
    ("<ul><li class=share>no<li>yes</ul><p>z", "yes z"), ("<table><tr><td class=ad>no<td>yes<tr><td>b</table>", "yes b"),
    ("<ul><li class=share>no<ul><li>no</li></ul>no</li><li>yes</li></ul>", "yes")])
def test_omitted_end_tags(inner, want):
    assert html_text.main_text(f"<article>{inner}</article>", set()) == want


def test_a_hot_half_is_split_into_windows(spark, monkeypatch):
    rng = random.Random(3)
    passage = unlike(rng, 40)
    rows = [(i, f"{unlike(rng, 30)} {passage} {unlike(rng, 30)}") for i in range(60)] + [(7, t) for t in (unlike(rng), passage)]
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    columns = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
    whole = sorted(map(str, substring_dedup.repeated_spans(d, block_bytes=1 << 20).select(columns).collect()))
    assert whole == sorted(map(str, substring_dedup.repeated_spans(d, block_bytes=1500).select(columns).collect()))
    sizes = []
    real = substring_dedup.repeated_windows
    monkeypatch.setattr(substring_dedup, "repeated_windows", lambda x, n: sizes.append(sum(len(b) + 1 for *_, b in x)) or real(x, n))
    import pyarrow as pa
    cols = [[k for k in range(40) for _ in range(3)], list(range(120)), [0] * 120, [0] * 120, [0] * 120, [rng.randbytes(130) for _ in range(120)]]
    batch = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:5]), pa.array(cols[5], pa.binary())], names=list("abcdef"))
    list(substring_dedup._suffixes(100, 1500)([batch]))
    assert max(sizes) <= 1500 and sum(sizes) == 120 * 131
    # one batch of contexts of a hot half: what starts later in it goes at once, one row a window is left
    same = passage.encode()[:120]
    cols = [[1] * 50, list(range(50)), [0] * 50, [0] * 50, [5] * 50, [same] * 50]
    batch = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:5]), pa.array(cols[5], pa.binary())], names=list("abcdef"))
    out = next(substring_dedup._windows(100)([batch])).to_pylist()
    assert [(r["doc"], r["start"], r["end"]) for r in out if r["hash"] is None] == [(i, 5, 125) for i in range(1, 50)]
    assert [(r["doc"], r["start"]) for r in out if r["hash"] is not None] == [(0, 5 + i) for i in range(21)]


def test_labels_of_unknown_documents_take_no_place_in_the_sample(spark):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(20)], DOCS)
    lab = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    want = d.where(~toxicity.held_out(d.doc_id)).count()
    assert toxicity.examples(d, lab, want).count() == want
    assert toxicity.examples(d, lab, 5).count() == 5


def test_items_without_an_id_leak_too(spark):
    rng = random.Random(4)
    a, b, c = (unlike(rng, 20) for _ in range(3))
    d = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y"), (3, f"x {c} y"), (4, f"{a} {b}")], DOCS)
    items = spark.createDataFrame([(None, a), (2**53 + 1, b), (None, None), (None, " ")], "item_id long, text string")
    for size in (100, 4_000_000):
        got = decontaminate.leaks(d, items, block_chars=size).collect()
        assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(1, 0), (2, 2**53 + 1), (4, 0), (4, 2**53 + 1)]
        assert [r.doc_id for r in decontaminate.without_leaks(d, items, block_chars=size).collect()] == [3]
