"""Toxicity by the nearest labelled examples (exact TF-IDF cosine, block-max inverted index).

1. Examples: at most ``max_examples`` labelled rows whose crc32(doc_id) mod 5 is not 0, by the
   order of md5(doc_id), of those whose documents are there; the bound is what makes the index small enough to be sent to every task.
2. Terms: words, and word beginnings of 4 to 6 bytes (words of one stem share them). Kept are the
   terms that stand in toxic examples far more often than in others (log-likelihood ratio above
   twice the log of the number of terms tried), at most ``max_terms``. So the cosine below is
   over these terms only, and texts with rarer toxic words alone have no nearest examples.
3. Document frequencies of these terms come from all documents and their whole texts.
4. Examples become unit TF-IDF vectors; postings are cut into blocks of examples, each with the
   largest weight per term. A query opens the blocks in order of their bound and stops when no
   block can beat its k-th cosine, so the k nearest are exact (ties: the earlier example).
5. Score: votes weighted by cosine, with the share of toxic examples as a prior of weight 1. A
   text without any term (an empty or null one too) gets the share of toxic ones among the
   examples without any.

Where documents share an id, the least of their texts (bytewise) is the example. Labels,
language, source and doc_id are never inputs of a score. Null labels and labels of
unknown documents teach nothing; a doc_id labelled twice counts as toxic if one label says so.
Without examples of both kinds every score is the prior (0 with no example).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import Scratch, row_key

BLOCK = 64


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text, mod 5, is 0 (a null id too)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each term occurrence, hash) of a slice: words and word beginnings."""
    data = tk.LOWER[data]
    starts, ends, first = tk.words(data, offsets)
    s = tk.prefix_hash(data)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    docs, out = [doc], [tk.span_hash(s, starts, ends) ^ np.uint64(0x57)]
    for n in (4, 5, 6):
        long = ends - starts >= n
        docs.append(doc[long])
        out.append(tk.span_hash(s, starts[long], starts[long] + n))
    return np.concatenate(docs), np.concatenate(out)


def examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    """doc_id, text, toxic: the bounded sample of labelled rows."""
    known = (labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .join(docs.select("doc_id"), "doc_id", "left_semi")
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_examples))
    return (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))


def _count_terms(batches):
    """Per task: term, number of toxic and of other examples that hold it."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, off in tk.text_slices(batch.column(0)):
            doc, term = term_hashes(data, off)
            if not len(term):
                continue
            pair = np.unique(np.rec.fromarrays([term, doc]))
            t, first = np.unique(pair.f0, return_index=True)
            pos = np.add.reduceat(toxic[i:j][pair.f1].astype(np.int64), first)
            n = np.diff(np.append(first, len(pair)))
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(t)), pa.array(pos), pa.array(n - pos)], names=["term", "pos", "neg"])


def choose_terms(counts: DataFrame, n_pos: int, n_neg: int, max_terms: int) -> list[int]:
    """Terms bound to label 1, by log-likelihood ratio; at most ``max_terms``."""
    if not n_pos or not n_neg:
        return []
    n = n_pos + n_neg
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    c, d = F.lit(float(n_pos)) - a, F.lit(float(n_neg)) - b
    part = lambda x, row, col: F.when(x > 0, x * F.log(x * n / (row * col))).otherwise(0.0)
    g = 2 * (part(a, a + b, F.lit(float(n_pos))) + part(b, a + b, F.lit(float(n_neg))) + part(c, c + d, F.lit(float(n_pos))) + part(d, c + d, F.lit(float(n_neg))))
    tried = counts.count()
    strong = counts.where(a / n_pos > 4 * b / n_neg).withColumn("g", g).where(F.col("g") > 2 * float(np.log(max(tried, 2))))
    return [r.term for r in strong.orderBy(F.desc("g"), "term").limit(max_terms).collect()]


def _sparse(terms: np.ndarray, extra: list[int]):
    """Per text: indices (into the sorted terms) and counts of its terms, beside other columns."""
    def run(batches):
        for batch in batches:
            idx_all, cnt_all = [], []
            for i, j, data, off in tk.text_slices(batch.column(0)):
                doc, term = term_hashes(data, off)
                at = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
                hit = terms[at] == term if len(terms) else np.zeros(len(term), bool)
                pair, n = np.unique(doc[hit] * len(terms) + at[hit], return_counts=True) if hit.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                cut = np.searchsorted(pair, np.arange(j - i + 1) * max(len(terms), 1))
                idx = (pair % max(len(terms), 1)).astype(np.int32)
                for lo, hi in zip(cut, cut[1:]):
                    idx_all.append(idx[lo:hi])
                    cnt_all.append(n[lo:hi].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in extra] + [pa.array(idx_all, pa.list_(pa.int32())), pa.array(cnt_all, pa.list_(pa.int32()))],
                                             names=[batch.schema.names[c] for c in extra] + ["idx", "cnt"])
    return run


class Index:
    """Block-max inverted index over unit example vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, idf: np.ndarray):
        self.idf, self.toxic = idf, toxic
        full = np.array([len(i) > 0 for i, _ in vectors], bool)
        self.prior = float(toxic.mean()) if len(toxic) else 0.0
        bare = toxic[~full]
        self.bare = (float(bare.sum()) + self.prior) / (len(bare) + 1) if len(toxic) else 0.0
        self.toxic = toxic[full]
        rows = [self.unit(i, c) for (i, c), f in zip(vectors, full) if f]
        self.size, self.blocks = len(rows), -(-len(rows) // BLOCK)
        term = np.concatenate([i for (i, _), f in zip(vectors, full) if f] or [np.zeros(0, np.int64)]).astype(np.int64)
        row = np.repeat(np.arange(self.size), [len(r) for r in rows])
        weight = np.concatenate(rows or [np.zeros(0)])
        order = np.lexsort((row, term))
        self.row, self.weight, term = row[order], weight[order], term[order]
        # postings of term t in block b: at[t * blocks + b] up to the next
        key = term * max(self.blocks, 1) + self.row // BLOCK
        self.at = np.searchsorted(key, np.arange(len(idf) * max(self.blocks, 1) + 1))
        self.most = np.zeros((len(idf), max(self.blocks, 1)))
        np.maximum.at(self.most.reshape(-1), key, self.weight)
        self.seen: dict[bytes, tuple] = {}

    def unit(self, idx: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        w = (1 + np.log(cnt)) * self.idf[idx]
        return w / np.sqrt((w * w).sum())

    def nearest(self, idx: np.ndarray, cnt: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(cosine, example), the best first, ties to the earlier example; cosines above 0."""
        q = self.unit(idx, cnt)
        bound = q @ self.most[idx]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] + 1e-12 < best[-1][0]:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(idx.tolist(), q.tolist()):
                lo, hi = self.at[t * self.blocks + b], self.at[t * self.blocks + b + 1]
                score[self.row[lo:hi] - b * BLOCK] += w * self.weight[lo:hi]
            best += [(s, b * BLOCK + int(r)) for r, s in enumerate(score.tolist()) if s > 0]
            best.sort(key=lambda x: (-round(x[0], 12), x[1]))
            del best[k:]
        return best

    def score(self, idx: np.ndarray, cnt: np.ndarray, k: int) -> tuple[float, list[tuple[float, int]]]:
        if not len(idx) or not self.size:
            return self.bare, []
        key = idx.tobytes() + cnt.tobytes()
        if key not in self.seen:
            near = self.nearest(idx, cnt, k)
            w = np.array([s for s, _ in near])
            y = self.toxic[[e for _, e in near]] if near else np.zeros(0)
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[key] = (float(((w * y).sum() + self.prior) / (w.sum() + 1)), near)
        return self.seen[key]


def toxicity(docs: DataFrame, labels: DataFrame, k: int = 16, max_examples: int = 16_384, max_terms: int = 4_096,
             evidence: int = 5) -> DataFrame:
    """Per document: doc_id, row_key, held_out, score, predicted, evidence (nearest example ids and
    cosines). ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    sample = scratch.stage(examples(docs, labels, max_examples), "toxic_examples")
    by_label = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos = by_label.get(1, 0)
    counts = scratch.stage(sample.select("text", "toxic").mapInArrow(_count_terms, "term long, pos long, neg long")
                           .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic_terms")
    terms = np.sort(np.array(choose_terms(counts, n_pos, sum(by_label.values()) - n_pos, max_terms), np.int64).view(np.uint64))
    ex = sorted((r.doc_id, r.toxic, r.idx, r.cnt) for r in sample.select("text", "doc_id", "toxic").mapInArrow(
        _sparse(terms, [1, 2]), "doc_id long, toxic int, idx array<int>, cnt array<int>").collect())
    vectors = scratch.stage(docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key")).mapInArrow(
        _sparse(terms, [1, 2]), "doc_id long, row_key long, idx array<int>, cnt array<int>"), "toxic_vectors")
    df = np.zeros(len(terms))
    for r in vectors.select(F.explode("idx").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        df[r.t] = r.n
    scratch.drop(counts, sample)
    idf = np.log((1 + vectors.count()) / (1 + df)) + 1
    ids = np.array([e[0] for e in ex if e[2]], np.int64)
    known = spark.sparkContext.broadcast(([(np.array(e[2], np.int64), np.array(e[3], np.int64)) for e in ex],
                                          np.array([e[1] for e in ex], np.float64), idf, ids))

    def judge(batches):
        index = Index(*known.value[:3])
        for pdf in batches:
            got = [index.score(np.asarray(i, np.int64), np.asarray(c, np.int64), k) for i, c in zip(pdf["idx"], pdf["cnt"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row_key": pdf["row_key"], "score": [s for s, _ in got],
                                "evidence": [[(int(known.value[3][e]), float(s)) for s, e in near[:evidence]] for _, near in got]})

    out = vectors.mapInPandas(judge, "doc_id long, row_key long, score double, evidence array<struct<doc_id: long, cosine: double>>")
    return out.select("doc_id", "row_key", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    bad = toxicity(docs, labels, **options).where("predicted = 1").select("row_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("row_key"))
    return rows.join(bad, "row_key", "left_anti").select("row.*")
