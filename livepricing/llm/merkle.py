"""Merkle manifest of a table of documents, climbed by a recursive query.

A row's leaf is the SHA-256 of its fields. The leaves of a language, ordered by doc_id, make a
binary tree (the last run of a level may hold one node); the subroots, ordered by language, make
the tree of the whole table.

Levels are built from below and stored as rows of nodes. To keep the climb short a stored row
links to its ancestor ``stride`` levels above and carries the siblings on the way there: a stride
of leaves is grouped, its levels are hashed within the group (2 ** stride digests), and the
groups' tops are the rows of the next stored level. A Spark recursive query starts at every leaf,
follows the links, appends the siblings it meets and folds them into the leaf (into the tampered
one where a row was tampered with), until it stands at the root.

Every leaf of a language passes the language's top, so a stored node is kept in as many copies as
it has strides of leaves below it, and a leaf takes the copy that its own group number gives: no
join key meets more than 2 ** stride leaves, and every level keeps about rows / 2 ** stride rows.
Positions come from a range sort, not from a window over a language.

Null fields count as ``-``. Rows without a language are a language of their own (first in order),
rows without a doc_id come first in theirs; rows of one doc_id are ordered by their leaf, repeated
rows are leaves of their own with equal digests. Rows without n_chars or doc_id are never tampered
with. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .ordering import positions
from .scratch import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MOD = 7

#: Hash of one digest or of two, all as binary; hashes are made of hex text.
_ONE = "unhex(sha2(lower(hex({a})), 256))"
_TWO = "unhex(sha2(concat(lower(hex({a})), lower(hex({b}))), 256))"


def leaf_digest(values: dict[str, Column]) -> Column:
    """Digest (binary) of a row's fields, each with its length in bytes before it."""
    def field(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[field(values[f].cast("string")) for f in FIELDS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, d (the leaf) and forged (the leaf after tampering, null without)."""
    values = {f: F.col(f) for f in FIELDS}
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    forged = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = (crc % TAMPER_MOD == 0) & F.col("n_chars").isNotNull()
    return docs.select("lang", "doc_id", leaf_digest(values).alias("d"), F.when(hit, leaf_digest(forged)).alias("forged"))


def fold_sql(start: str, path: str, place: str) -> str:
    """``start`` folded with the siblings of ``path`` (null: the node is alone in its run); the
    bits of ``place`` tell on which side the node stands."""
    left, right = _TWO.format(a="acc", b="x.s"), _TWO.format(a="x.s", b="acc")
    return (f"aggregate(transform({path}, (s, k) -> struct(s, shiftright({place}, k) & 1 AS odd)), {start}, (acc, x) -> "
            f"CASE WHEN x.s IS NULL THEN {_ONE.format(a='acc')} WHEN x.odd = 1 THEN {right} ELSE {left} END)")


def _levels(stride: int, carry: list[str], schema: pa.Schema):
    """Hashes the levels of each group: a row per node with the siblings up to the group's top,
    which the group's first row also brings."""
    def h(*nodes: bytes) -> bytes:
        return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()

    def run(batches):
        for batch in batches:
            for t, m, b, under, kids in zip(*(batch.column(i) for i in range(5))):
                m, kids = m.as_py(), kids.as_py()
                # up to the group's top: the whole stride, or what is left up to the root
                hops = stride if m > 1 << stride else (m - 1).bit_length()
                levels = [[k["d"] for k in kids]]
                for _ in range(hops):
                    low = levels[-1]
                    levels.append([h(*low[j: j + 2]) for j in range(0, len(low), 2)])
                beside = [[low[i ^ 1] if i ^ 1 < len(low) else None for i in range(len(low))] for low in levels[:hops]]
                n = len(kids)
                yield pa.RecordBatch.from_pydict({
                    "t": [t.as_py()] * n, "m": [m] * n, "b": [b.as_py()] * n, "under": [under.as_py()] * n,
                    **{c: [k[c] for k in kids] for c in ("i", "d", "leaves", *carry)},
                    "path": [[side[q >> k] for k, side in enumerate(beside)] for q in range(n)],
                    "top": [levels[-1][0]] + [None] * (n - 1)}, schema)
    return run


def _climbed(nodes: DataFrame, stride: int, carry: list[str], level: int, top_tree: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, tops): every node (t, i, d, m nodes in its level, leaves below it) with the siblings
    up to its group's top and the link to it, and the tops as nodes of the next level; ``final``
    marks those that are their tree's root."""
    size = 1 << stride
    kid = ["i", "d", "leaves", *carry]
    groups = (nodes.groupBy("t", "m", F.shiftright("i", stride).alias("b"))
              .agg(F.sort_array(F.collect_list(F.struct(*kid))).alias("kids"), F.sum("leaves").alias("under")))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("t", "m", "b", "under")]
                          + [nodes.schema[c] for c in kid]
                          + [T.StructField("path", T.ArrayType(T.BinaryType())), T.StructField("top", T.BinaryType())])
    rows = scratch.stage(groups.select("t", "m", "b", "under", "kids").mapInArrow(_levels(stride, carry, to_arrow_schema(schema)), schema), "merkle_level")
    final = F.col("m") <= size
    # the root of a language is a node of the top tree (-1); the top tree's own root has no link
    out = rows.select(
        "t", F.lit(level).alias("l"), "i", "d", "leaves", "path", "b", *carry,
        F.when(~final, F.col("t")).otherwise(F.lit(None if top_tree else -1)).cast("long").alias("pt"),
        F.when(final, F.lit(0)).otherwise(level + 1).alias("pl"),
        F.when(final, F.col("t")).otherwise(F.col("b")).alias("pi"),
        F.ceil(F.col("under") / size).cast("long").alias("pc"))
    tops = rows.where("top IS NOT NULL").select(
        "t", F.col("b").alias("i"), F.ceil(F.col("m") / size).cast("long").alias("m"), F.col("top").alias("d"),
        F.col("under").alias("leaves"), final.alias("final"))
    return out, tops


def _tree(nodes: DataFrame, most: int, stride: int, carry: list[str], top_tree: bool, scratch: Scratch):
    """All stored levels of the trees in ``nodes`` (the fullest has ``most`` nodes), and their roots."""
    levels, roots, level = [], [], 0
    while True:
        rows, tops = _climbed(nodes, stride, carry if level == 0 else [], level, top_tree, scratch)
        levels.append(rows)
        roots.append(tops.where("final").drop("final", "m"))
        if most <= 1 << stride:
            break
        nodes, most, level = tops.where("not final").drop("final"), -(-most >> stride), level + 1
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def manifest(docs: DataFrame, stride: int = 10) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. The driver gathers
    two numbers (rows of the largest language, languages)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    held = scratch.stage(leaves(docs), "merkle_leaves")
    placed = positions(held, ["lang"], ["doc_id", "d"], scratch, "merkle_sorted")
    trees = scratch.stage(positions(held.groupBy("lang").agg(F.count("*").alias("m")), [], ["lang"], scratch, "merkle_langs")
                          .withColumnRenamed("pos", "t"), "merkle_trees")
    most, n_trees = trees.agg(F.coalesce(F.max("m"), F.lit(0)), F.count("*")).first()
    # one row per language: AQE broadcasts it where it measures a small side, else it splits the skew
    nodes = placed.join(trees.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "t", F.col("pos").alias("i"), "m", "d", F.lit(1).cast("long").alias("leaves"), "doc_id", "forged")
    levels, subroots = _tree(nodes, most, stride, ["doc_id", "forged"], False, scratch)
    above, root = _tree(subroots.select(F.lit(-1).cast("long").alias("t"), F.col("t").alias("i"), F.lit(n_trees).cast("long").alias("m"), "d", "leaves"),
                        n_trees, stride, [], True, scratch)
    stored = None
    for rows in [*levels[1:], *above]:
        copies = F.ceil(F.col("leaves") / (1 << stride)).cast("long")
        r = rows.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("leaves", "b")
        stored = r if stored is None else stored.unionByName(r)
    stored = scratch.stage(stored.withColumn("sibs", F.expr("aggregate(filter(path, s -> s IS NOT NULL), X'', (a, s) -> concat(a, s))")), "merkle_nodes")
    climbed = spark.sql(f"""
        WITH RECURSIVE climb(doc_id, leaf, folded, proof, subroot, grp, pt, pl, pi, pc) AS (
          SELECT doc_id, d, {fold_sql('coalesce(forged, d)', 'path', 'i')},
                 aggregate(filter(path, s -> s IS NOT NULL), X'', (a, s) -> concat(a, s)), CAST(NULL AS BINARY), b, pt, pl, pi, pc
          FROM {{base}}
          UNION ALL
          SELECT c.doc_id, c.leaf, {fold_sql('c.folded', 'n.path', 'n.i')}, concat(c.proof, n.sibs),
                 CASE WHEN n.t = -1 AND n.l = 0 THEN n.d ELSE c.subroot END, c.grp, n.pt, n.pl, n.pi, n.pc
          FROM climb c JOIN {{stored}} n ON n.t = c.pt AND n.l = c.pl AND n.i = c.pi AND n.c = c.grp % c.pc)
        SELECT doc_id, leaf, subroot, folded, proof FROM climb WHERE pt IS NULL LIMIT ALL""",
                        base=levels[0], stored=stored)
    top = root.select("d").scalar()
    text = lambda c: F.lower(F.hex(c))
    return climbed.select("doc_id", text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(top).alias("root"),
                          F.sha2(text(F.col("proof")), 256).alias("proof_sha256"), text(F.col("folded")).alias("folded_root"),
                          (F.col("folded") == top).alias("verified"))


#: Unsigned CRC-32 of a decimal number as DuckDB SQL (``{n}``), bit by bit.
CRC32_SQL = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({n}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
             "lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: "
             "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")

_FIELDS_SQL = " || ".join("coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format(f"r.{f}") for f in FIELDS)

MERKLE_SQL = f"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT doc_id, lang, sha256({_FIELDS_SQL}) AS d,
         CASE WHEN {CRC32_SQL.format(n='doc_id')} % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_FIELDS_SQL.replace('r.n_chars', '(r.n_chars + 1)')}) END AS forged
  FROM documents r),
tree AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT lang FROM leaf)),
placed AS MATERIALIZED (
  SELECT leaf.*, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, d) - 1 AS i
  FROM leaf JOIN tree ON leaf.lang IS NOT DISTINCT FROM tree.lang),
low(t, l, i, d) AS (
  SELECT t, 0, i, d FROM placed
  UNION ALL
  SELECT t, l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM low) WHERE n > 1 GROUP BY t, l, i // 2),
height AS MATERIALIZED (SELECT t, max(l) AS h, arg_max(d, l) AS subroot FROM low GROUP BY t),
top(l, i, d) AS (
  SELECT 0, t, subroot FROM height
  UNION ALL
  SELECT l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY l, i // 2),
crown AS MATERIALIZED (SELECT max(l) AS h, arg_max(d, l) AS root FROM top),
step AS (
  SELECT p.t, p.i, s.l, b.d, (p.i >> s.l) & 1 AS odd FROM placed p JOIN height USING (t) CROSS JOIN unnest(range(h)) s(l)
  LEFT JOIN low b ON b.t = p.t AND b.l = s.l AND b.i = xor(p.i >> s.l, 1)
  UNION ALL
  SELECT p.t, p.i, 1000 + s.l, b.d, (p.t >> s.l) & 1 FROM placed p CROSS JOIN crown CROSS JOIN unnest(range(h)) s(l)
  LEFT JOIN top b ON b.l = s.l AND b.i = xor(p.t >> s.l, 1)),
path AS (
  SELECT t, i, string_agg(d, '' ORDER BY l) AS sibs, list(CASE WHEN d IS NULL THEN 'N' WHEN odd = 1 THEN 'L' || d ELSE 'R' || d END ORDER BY l) AS steps
  FROM step GROUP BY t, i),
folded AS (
  SELECT p.*, coalesce(sibs, '') AS sibs, list_reduce(list_prepend(coalesce(forged, p.d), coalesce(steps, [])),
         lambda a, s: CASE s[1] WHEN 'N' THEN sha256(a) WHEN 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS f
  FROM placed p LEFT JOIN path USING (t, i))
SELECT doc_id, d AS leaf, subroot, root, sha256(sibs) AS proof_sha256, f AS folded_root, f = root AS verified
FROM folded JOIN height USING (t) CROSS JOIN crown
"""
