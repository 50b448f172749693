"""Token counts of flat token files by a separator scan.

A flat file is a bare stream of fixed-width ids; documents end with the end id and nothing says
where. It is read as blocks of equal size that ignore documents. Each block is searched for the
end id at once (one vector comparison) and reports its length, its separators and the counts
between them; a prefix scan over the blocks' few numbers gives each block the number of
documents before it and the place of the last separator, which closes the documents that cross
blocks. Ids after the last separator of a file are reported as an unfinished document.

``flat_files`` writes the streams (one per task) as a table of blocks with a list of the doc_ids
beside it; ``read_blocks`` cuts files on disk. Null and empty texts are documents of 0 tokens;
repeated documents count each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import Scratch


def flat_files(docs: DataFrame, scratch: Scratch, block_tokens: int = 1 << 19, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(blocks: file, block, ids; manifest: file, ordinal, doc_id), written in one pass."""

    def run(batches):
        kind, end = tokens.id_type(vocabulary), tokens.end_id(vocabulary)
        file, block, ordinal = TaskContext.get().partitionId(), 0, 0
        names = ["file", "place", "ids", "doc_ids", "kind"]

        def row(place, ids, docs_, k):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([place], pa.int64()), pa.array([ids], pa.binary()),
                                               pa.array([docs_], pa.list_(pa.int64())), pa.array([k])], names=names)

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for text in batch.column(1):
                ids = np.array([*tokens.encode(text.as_py(), vocabulary), end], kind)
                held.append(ids)
                size += len(ids)
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    cut = len(flat) // block_tokens * block_tokens
                    for lo in range(0, cut, block_tokens):
                        yield row(block, flat[lo: lo + block_tokens].tobytes(), None, "block")
                        block += 1
                    held, size = [flat[cut:]], len(flat) - cut
            yield row(ordinal, None, ids_of, "manifest")
            ordinal += len(ids_of)
        if size:
            yield row(block, np.concatenate(held).tobytes(), None, "block")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "file long, place long, ids binary, doc_ids array<long>, kind string")
    held = scratch.stage(rows, "flat_tokens", by=("kind",), compression="zstd")
    blocks = held.where("kind = 'block'").select("file", F.col("place").alias("block"), "ids")
    manifest = held.where("kind = 'manifest'").select("file", "place", F.posexplode("doc_ids").alias("n", "doc_id"))
    return blocks, manifest.select("file", (F.col("place") + F.col("n")).alias("ordinal"), "doc_id")


def read_blocks(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """file, block, ids of flat files on disk; ``block_bytes``: a multiple of the id width."""
    f = spark.read.format("binaryFile").load(path).where("length > 0")
    n = F.explode(F.sequence(F.lit(0), F.expr(f"int((length - 1) div {block_bytes})")))
    return f.select(F.col("path").alias("file"), "content", n.alias("block")).select(
        "file", F.col("block").cast("long").alias("block"), F.expr(f"substring(content, block * {block_bytes} + 1, {block_bytes})").alias("ids"))


def _scan(end: int, kind: np.dtype):
    def run(batches):
        for batch in batches:
            n, seps, first, last, inner = [], [], [], [], []
            for ids in batch.column(2):
                v = np.frombuffer(ids.as_buffer(), kind)
                at = np.flatnonzero(v == end)
                n.append(len(v))
                seps.append(len(at))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append((np.diff(at) - 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(seps, pa.int64()),
                                              pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                                             names=["file", "block", "n", "seps", "first", "last", "inner"])
    return run


def token_counts(blocks: DataFrame, end: int, kind: np.dtype = np.dtype("<u2")) -> DataFrame:
    """file, ordinal, n_tokens (without the end id), finished: one row per document of the
    streams. ``blocks``: file, block (from 0 in each file), ids."""
    key = dict(blocks.dtypes)["file"]
    b = blocks.select("file", "block", "ids").mapInArrow(_scan(end, kind), f"file {key}, block long, n long, seps long, first long, last long, inner array<long>")
    scratch = Scratch(blocks.sparkSession)
    b = scratch.stage(b, "token_scan")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = b.select("file", "block", "n", "seps", "first", "last").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    s = s.withColumn("ordinal", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    s = s.withColumn("open", F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(-1)))
    s = s.withColumn("is_last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    head = s.where("seps > 0").select("file", "ordinal", (F.col("start") + F.col("first") - F.col("open") - 1).alias("n_tokens"), F.lit(True).alias("finished"))
    inner = (b.where("seps > 1").select("file", "block", "inner").join(s.select("file", "block", "ordinal"), ["file", "block"])
             .select("file", "ordinal", F.posexplode("inner").alias("i", "n_tokens"))
             .select("file", (F.col("ordinal") + F.col("i") + 1).alias("ordinal"), "n_tokens", F.lit(True).alias("finished")))
    close = F.coalesce(F.col("start") + F.col("last"), F.col("open"))
    tail = s.where("is_last").select("file", (F.col("ordinal") + F.col("seps")).alias("ordinal"),
                                     (F.col("start") + F.col("n") - close - 1).alias("n_tokens"), F.lit(False).alias("finished")).where("n_tokens > 0")
    return head.unionByName(inner).unionByName(tail)


def document_tokens(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, block_tokens: int = 1 << 19) -> DataFrame:
    """doc_id, file, ordinal, n_tokens per document: written flat, then counted by the scan."""
    scratch = Scratch(docs.sparkSession)
    blocks, manifest = flat_files(docs, scratch, block_tokens, vocabulary)
    counts = token_counts(blocks, tokens.end_id(vocabulary), tokens.id_type(vocabulary))
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
