"""Merkle manifest of a document table by a nested-struct rollup.

H is the lower-case hex sha256 of its inputs put together (digests as hex
text).  A row's leaf is H of doc_id, source, lang, n_chars and text, each
``-`` if null, else its UTF-8 byte count, ``:`` and its value.  Per lang the
leaves ascend by doc_id; while more than one node remains, every ``FAN``
consecutive ones (the last run may be shorter, even one) become their H.
What remains is the lang's subroot; the subroots, ordered by lang (null
first, bytewise), give the root by the same rule.

* Ranks: the leaves are range-partitioned by (lang, doc_id), so a lang with
  most of the rows is many slices; a row's rank is its place in the slice
  plus the rows of its lang in earlier slices.
* Rollup: a rank is written in digits to the base ``FAN``.  Inside blocks of
  ``FAN ** DIGITS`` ranks the digit columns are grouped away one after the
  other, lowest first; every grouping nests the structs of the children in
  their parent.  One exchange by (lang, block) serves all groupings of a
  block, and no row holds more than a block.  The blocks' hashes are the
  nodes of the next tier, as often as it takes.
* Proofs: a transform walks a block's nested structs and gives every child
  the siblings of each level on its way, an explode makes rows of them.  A
  block meets the siblings above it in a grouping of two rows.  Nothing is
  joined but the ranks' starts (one row per slice and lang).

Defined cases: null fields count as ``-``; a null doc_id comes first in its
lang and is never tampered with; rows with the same doc_id are ordered by
their leaf, and full copies are leaves of their own; a null lang is a lang;
empty and very long texts are hashed whole; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, saved, table

FAN = 8
DIGITS = 3
BLOCK = FAN ** DIGITS


# -------------------------------------------------------------------- leaves

def field(c: Column) -> Column:
    """``-`` for null, else the byte count, ``:`` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def leaves(docs: DataFrame, tamper: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """(lang, doc_id, leaf, tampered): ``tampered`` is the leaf with the
    tampered text where ``tamper`` holds, else null."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.lit(None).cast("string")
    if tamper is not None:
        changed = F.when(tamper, leaf(*own[:4], tampered_text))
    return docs.select("lang", "doc_id", leaf(*own).alias("leaf"), changed.alias("tampered"))


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0) of a row in its group by ``order`` and the
    group's ``total``; a group of any size is spread over slices.  Rows that
    tie in every column of ``order`` are ranked in any order."""
    src = rows.withColumn("tie", F.monotonically_increasing_id())  # splits runs of full copies
    by = [*group, *order, "tie"]
    slices = saved(src.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
                   .withColumns({"slice": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    heads = slices.groupBy("slice", *group).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    before = F.sum("n").over(w.orderBy("slice")) - F.col("n")
    heads = heads.select(F.col("slice").alias("s"), *[F.col(g).alias(f"g_{g}") for g in group],
                         (before - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total"))
    on = F.col("slice") == F.col("s")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"g_{g}"))
    return slices.join(heads, on).select(*rows.columns, (F.col("place") + F.col("shift")).alias("rank"), "total")


# -------------------------------------------------------------------- rollup

def rollup(nodes: DataFrame, group: list[str]) -> DataFrame:
    """(group, total, block, hash, kids): nodes (group, total, rank, hash,
    payload) nested by blocks.  ``hash`` is the block's node; a level of a
    group that has one node only leaves it as it is."""
    digit = [F.floor(F.col("rank") / FAN ** d) % FAN for d in range(DIGITS)]
    keys = [*group, "total", "block"]
    part = nodes.select(*group, "total", F.floor(F.col("rank") / BLOCK).alias("block"),
                        *[c.cast("int").alias(f"d{d}") for d, c in enumerate(digit)],
                        "hash", F.col("payload").alias("kids")).repartition(*group, "block")
    for d in range(DIGITS):
        up = [f"d{e}" for e in range(d + 1, DIGITS)]
        part = (part.groupBy(*keys, *up)
                .agg(F.sort_array(F.collect_list(F.struct(f"d{d}", "hash", "kids"))).alias("kids"))
                .select(*keys, *up, F.when(F.col("total") > FAN ** d, F.sha2(F.array_join("kids.hash", ""), 256))
                        .otherwise(F.col("kids")[0]["hash"]).alias("hash"), "kids"))
    return part


def _siblings(kids: Column, at: Column, counts: Column) -> Column:
    """The other nodes of a run, put together left and right of one; null
    where the level has one node only."""
    def joined(part):
        return F.array_join(F.transform(part, lambda k: k["hash"]), "")
    return F.when(counts, F.struct(joined(F.slice(kids, 1, at)).alias("left"),
                                   joined(F.slice(kids, at + 2, F.lit(FAN))).alias("right")))


def proofs(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, rank, hash, payload, path) of every child of the blocks (...,
    kids, path): the siblings of each level upwards, the block's own after."""
    counts = [F.col("total") > FAN ** d for d in range(DIGITS)]

    def down(kids, d, rank, above):
        def child(x, at):
            path = [_siblings(kids, at, counts[d]), *above]
            place = rank * FAN + at
            if d:
                return down(x["kids"], d - 1, place, path)
            return F.array(F.struct(place.cast("long").alias("rank"), x["hash"].alias("hash"),
                                    x["kids"].alias("payload"), F.array(*path).alias("steps")))
        return F.flatten(F.transform(kids, child))

    steps = F.filter("steps", lambda s: s.isNotNull())
    return (blocks.select(*keep, "path", F.inline(down(F.col("kids"), DIGITS - 1, F.col("block"), [])))
            .select(*keep, "rank", "hash", "payload", F.concat(steps, "path").alias("path")))


def _tiers(nodes: DataFrame, group: list[str]) -> list[DataFrame]:
    """Blocks of every tier, lowest first; the last has one block a group."""
    blocks = [saved(rollup(nodes, group))]
    most = blocks[0].agg(F.max("total")).first()[0] or 0
    while most > BLOCK:
        most = -(-most // BLOCK)
        up = blocks[-1].select(*group, F.ceil(F.col("total") / BLOCK).alias("total"), F.col("block").alias("rank"),
                               "hash", F.lit(None).cast("boolean").alias("payload"))
        blocks.append(saved(rollup(up, group)))
    return blocks


def _below(blocks: DataFrame, above: DataFrame, group: list[str], carry: list[str]) -> DataFrame:
    """Blocks with the path (and carried columns) of the node they are: one
    grouping of the two rows of a block."""
    kinds = dict(blocks.dtypes) | dict(above.dtypes)
    cols = ["total", "hash", "kids", "path", *carry]

    def typed(df, has):
        return df.select(*group, "block", *[F.col(c) if c in has else F.lit(None).cast(kinds[c]).alias(c) for c in cols])
    both = typed(blocks, ["total", "hash", "kids"]).unionByName(typed(above, ["path", *carry]))
    return both.groupBy(*group, "block").agg(*[F.any_value(c, F.lit(True)).alias(c) for c in cols])


def _walk(tiers: list[DataFrame], top: DataFrame, group: list[str], carry: list[str]) -> DataFrame:
    """Children of the lowest tier with their whole path; ``top`` has the
    path and carried columns of every group's last node."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tiers):
        got = proofs(_below(blocks, above, group, carry), [*group, *carry])
        above = got.withColumn("block", F.col("rank"))
    return got


def manifest(rows: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, path, folded_root) of leaves
    (lang, doc_id, leaf, tampered).  ``path`` has the siblings left and right
    of the row's node at every level, from its leaf to the root."""
    spread = ranked(saved(rows), ["lang"], ["doc_id", "leaf"])
    nodes = spread.select("lang", "total", "rank", F.col("leaf").alias("hash"),
                          F.struct("doc_id", "tampered").alias("payload"))
    lower = _tiers(nodes, ["lang"])
    subroots = lower[-1].select(F.lit(0).alias("all"), F.col("lang"), F.col("hash").alias("subroot"))
    upper_nodes = ranked(subroots, ["all"], ["lang"]).select(
        "all", "total", "rank", F.col("subroot").alias("hash"), F.struct("lang").alias("payload"))
    upper = _tiers(upper_nodes, ["all"])
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    top = upper[-1].select("all", F.col("hash").alias("root"), no_path.alias("path"))
    langs = _walk(upper, top, ["all"], ["root"]).select(
        F.col("payload.lang").alias("lang"), F.col("hash").alias("subroot"), "root", "path")
    got = _walk(lower, langs, ["lang"], ["subroot", "root"])
    folded = F.aggregate("path", F.coalesce("payload.tampered", "hash"),
                         lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    return got.select("payload.doc_id", "lang", F.col("hash").alias("leaf"), "subroot", "root", "path",
                      folded.alias("folded_root"))


def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tamper = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = manifest(leaves(docs, tamper, lower_ascii(F.col("text"))))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return got.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 by its bits, levels by recursion; the levels of all langs together
#: are the tree ``t``, a doc's node at level l of its lang is rank >> 3 l.
ORACLE = """
WITH RECURSIVE doc AS (
  SELECT doc_id, lang,
    concat(f(CAST(doc_id AS VARCHAR)), f(source), f(lang), f(CAST(n_chars AS VARCHAR)), f(text)) AS raw,
    concat(f(CAST(doc_id AS VARCHAR)), f(source), f(lang), f(CAST(n_chars AS VARCHAR)),
           f(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS low,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda d: ascii(d)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, one:
        xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, lang, sha256(raw) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(low) ELSE sha256(raw) END AS used,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(raw)) - 1 AS rk
  FROM doc),
t(lv, lang, i, h, n) AS (
  SELECT 0, lang, rk, leaf, count(*) OVER (PARTITION BY lang) FROM leaf
  UNION ALL
  SELECT lv + 1, lang, i // 8, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(any_value(n) / 8.0) AS BIGINT)
  FROM t WHERE n > 1 GROUP BY lv, lang, i // 8),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rk FROM t WHERE n = 1),
u(lv, i, h, n) AS (
  SELECT 0, rk, subroot, count(*) OVER () FROM sub
  UNION ALL
  SELECT lv + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(any_value(n) / 8.0) AS BIGINT)
  FROM u WHERE n > 1 GROUP BY lv, i // 8),
tower AS (
  SELECT lang, lv, i, h, n > 1 AS counts FROM t
  UNION ALL
  SELECT s.lang, 1000 + u.lv, u.i, u.h, u.n > 1 FROM sub s, u),
place AS (
  SELECT l.doc_id, l.leaf, l.rk, v.lv, v.lang,
         CASE WHEN v.lv < 1000 THEN l.rk // CAST(8 ** v.lv AS BIGINT)
              ELSE s.rk // CAST(8 ** (v.lv - 1000) AS BIGINT) END AS own
  FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang
  JOIN (SELECT DISTINCT lang, lv FROM tower WHERE counts) v ON v.lang IS NOT DISTINCT FROM l.lang),
step AS (
  SELECT p.doc_id, p.rk, p.lang, p.lv,
         coalesce(string_agg(w.h, '' ORDER BY w.i) FILTER (w.i < p.own), '') AS lft,
         coalesce(string_agg(w.h, '' ORDER BY w.i) FILTER (w.i > p.own), '') AS rgt
  FROM place p JOIN tower w ON w.lang IS NOT DISTINCT FROM p.lang AND w.lv = p.lv AND w.i // 8 = p.own // 8
  GROUP BY ALL),
path AS (
  SELECT lang, rk, string_agg(lft || rgt, '' ORDER BY lv) AS proof, list(lft ORDER BY lv) AS ls, list(rgt ORDER BY lv) AS rs
  FROM step GROUP BY lang, rk),
fold AS (
  SELECT l.lang, l.rk, list_reduce(list_prepend(l.used, list_transform(range(1, len(p.ls) + 1),
           lambda k: p.ls[k] || '|' || p.rs[k])),
           lambda a, b: sha256(concat(string_split(b, '|')[1], a, string_split(b, '|')[2]))) AS folded_root
  FROM leaf l LEFT JOIN path p ON l.lang IS NOT DISTINCT FROM p.lang AND l.rk = p.rk)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       coalesce(g.folded_root, l.used) AS folded_root, coalesce(g.folded_root, l.used) = r.h AS verified
FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang
JOIN (SELECT h FROM u WHERE n = 1) r ON true
LEFT JOIN path p ON l.lang IS NOT DISTINCT FROM p.lang AND l.rk = p.rk
LEFT JOIN fold g ON l.lang IS NOT DISTINCT FROM g.lang AND l.rk = g.rk
"""
for _c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "text",
           "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"):
    ORACLE = ORACLE.replace(f"f({_c})", f"coalesce(CAST(strlen({_c}) AS VARCHAR) || ':' || {_c}, '-')")
