"""Exact top-k search by inner product with MaxScore over sharded postings.

Components become integers floor(scale * x).  A dimension is a term, its
entries other than zero are the term's postings (row, impact), and a query's
weight of the term is its own component.  The rows are dealt into shards of
about ``SHARD`` rows; a shard keeps its postings by term, ordered by row, and
each term's largest and smallest impact, so that a query knows how much a
term can add to a score at most (zero at least: a row need not have it).

Per query and shard the terms are ordered by that bound.  The longest run of
smallest bounds whose sum stays below the score of the query's k-th best row
so far is non-essential: a row that has nothing else cannot compete.  The
postings of the essential terms are traversed and summed; rows that could
still reach the k-th score are then probed in the non-essential terms, the
largest bound first, as long as sum and remaining bounds stay competitive.
A shard whose bounds sum up to less is not read at all.  Rows that tie with
the k-th score are kept, so ties end by the smaller vec_id.

Queries are packed into blocks of about ``QUERIES``; every block meets every
group of shards once, in an ordinary join by group, and its best rows are
merged over the shards of the group inside the task.  So a query leaves at
most k rows a group, which a ranking window merges.  Work grows with queries
times rows, as exact search by a set of queries must; what moves is the
index once and the queries once a group (a group has at least ``GROUP``
shards or there are as many groups as tasks).

Defined cases: vectors that are null or hold null or non-finite components
take no part; vectors of different length do not meet; rows with the same
vec_id are rows of their own, each the other's candidate; a null vec_id is a
candidate that comes last among ties; zero vectors score zero; other columns
are ignored; an empty table gives no rows; scores beyond a long raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

SHARD = 2048
QUERIES = 512
GROUP = 64
_NULL_ID = np.iinfo(np.int64).max  # a null vec_id; its row's number is negative


def whole_vectors(vectors: DataFrame) -> Column:
    """True where ``embedding`` is an array of finite numbers."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(fine, F.lit(False))


# ------------------------------------------------------------------- shards

class Shard:
    """Postings of some rows: ``at`` bounds the entries of each term."""

    def __init__(self, ids, rows, at, docs, impacts, high, low):
        self.ids, self.rows, self.at, self.docs, self.impacts = ids, rows, at, docs, impacts
        self.high, self.low = high, low

    @staticmethod
    def build(ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> Shard:
        by_term = np.ascontiguousarray(x.T)
        term, docs = np.nonzero(by_term)
        at = np.searchsorted(term, np.arange(x.shape[1] + 1)).astype(np.int64)
        high = by_term.max(axis=1, initial=0)
        low = by_term.min(axis=1, initial=0)
        return Shard(ids, rows, at, docs.astype(np.uint32), by_term[term, docs], high, low)

    def pack(self) -> list[bytes]:
        return [a.tobytes() for a in (self.ids, self.rows, self.at, self.docs, self.impacts, self.high, self.low)]

    @staticmethod
    def unpack(parts) -> Shard:
        kinds = (np.int64, np.int64, np.int64, np.uint32, np.int64, np.int64, np.int64)
        return Shard(*(np.frombuffer(p, k) for p, k in zip(parts, kinds, strict=True)))

    def postings(self, term: int):
        a, b = self.at[term], self.at[term + 1]
        return self.docs[a:b], self.impacts[a:b]


def competitive(shard: Shard, q: np.ndarray, least: int | None):
    """(rows of the shard, scores) of all that reach ``least`` (None: all)."""
    bound = np.where(q > 0, q * shard.high, q * shard.low)
    order = np.argsort(bound, kind="stable")
    reach = np.cumsum(bound[order])
    extra = 0 if least is None else int(np.searchsorted(reach, least, "left"))
    if extra and extra == len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    score = np.zeros(len(shard.ids), np.int64)
    for term in order[extra:][::-1]:  # essential: traversed
        if q[term]:
            docs, impacts = shard.postings(term)
            if len(docs) == len(score):
                score += q[term] * impacts
            else:
                score[docs] += q[term] * impacts
    if least is None:
        return np.arange(len(score)), score
    rest = int(reach[extra - 1]) if extra else 0
    alive = np.nonzero(score + rest >= least)[0]
    score = score[alive]
    for term in order[:extra][::-1]:  # non-essential: probed while competitive
        if not len(alive):
            break
        docs, impacts = shard.postings(term)
        if len(docs):
            at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            score += q[term] * np.where(docs[at] == alive, impacts[at], 0)
        rest -= int(bound[term])
        near = score + rest >= least
        alive, score = alive[near], score[near]
    return alive, score


class Best:
    """The k best rows so far of every query of a block."""

    def __init__(self, k: int, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.k, self.ids, self.rows, self.x = k, ids, rows, x
        none = np.empty(0, np.int64)
        self.found = [(none, none, none) for _ in ids]  # score, id, row

    def search(self, shard: Shard) -> None:
        most = max(int(shard.high.max(initial=0)), -int(shard.low.min(initial=0)))
        if self.x.shape[1] * most * int(np.abs(self.x).max(initial=0)) >= 1 << 62:
            raise OverflowError("a score is beyond a long")
        for i, q in enumerate(self.x):
            score, vec, row = self.found[i]
            least = int(score[-1]) if len(score) == self.k else None
            docs, got = competitive(shard, q, least)
            other = shard.rows[docs] != self.rows[i]
            docs, got = docs[other], got[other]
            if len(docs):
                if len(docs) > 4 * self.k:  # only rows that reach the k-th of these can stay
                    kth = np.partition(got, len(got) - self.k)[len(got) - self.k]
                    docs, got = docs[got >= kth], got[got >= kth]
                score = np.concatenate([score, got])
                vec, row = np.concatenate([vec, shard.ids[docs]]), np.concatenate([row, shard.rows[docs]])
                top = np.lexsort((row, vec, -score))[:self.k]
                self.found[i] = score[top], vec[top], row[top]

    def rows_out(self) -> pa.RecordBatch:
        n = [len(f[0]) for f in self.found]
        cols = [np.repeat(self.rows, n), np.repeat(self.ids, n),
                *(np.concatenate([f[c] for f in self.found]) for c in (2, 1, 0))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "query_id", "row", "vec_id", "score"])


# ----------------------------------------------------------------- operator

def _matrix(lists: pa.Array, i: int):
    """ids, rows and numbers of one packed group of (id, row, x)."""
    one = lists[i].values
    ids = one.field("id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
    x = one.field("x").flatten().to_numpy(zero_copy_only=False)
    return ids, one.field("row").to_numpy(), x.reshape(len(ids), -1)


def index(rows: DataFrame, n: int) -> DataFrame:
    """(dim, shard, parts): every row (id, row, x) in one shard's postings."""
    count = -(-n // SHARD)
    dealt = rows.groupBy(F.size("x").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(count)).alias("shard")).agg(
        F.collect_list(F.struct("id", "row", "x")).alias("rows"))

    def build(batches):
        for b in batches:
            parts = [Shard.build(*_matrix(b.column(2), i)).pack() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.list_(pa.binary()))],
                                             ["dim", "shard", "parts"])
    return dealt.mapInArrow(build, "dim int, shard long, parts array<binary>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row that is a query, the k
    rows other than itself with the highest integer inner product."""
    spark = vectors.sparkSession
    number = F.monotonically_increasing_id()
    ints = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    rows = saved(vectors.filter(whole_vectors(vectors)).select(
        F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id").isNull(), -1 - number).otherwise(number).alias("row"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), ints.alias("x")))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards = -(-n // SHARD)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, min(shards, max(tasks, -(-shards // GROUP))))
    right = index(rows.select("id", "row", "x"), max(n, 1)).withColumn("g", F.col("shard") % groups).select("dim", "g", "parts")
    blocks = max(1, -(-asked // QUERIES))
    left = (rows.filter("asks").groupBy(F.size("x").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
            .agg(F.collect_list(F.struct("id", "row", "x")).alias("asked"))
            .withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))))
    # the left side streams: all shards of the group follow a block one by one
    pairs = left.join(right.hint("merge"), ["dim", "g"]).select("dim", "g", "block", "asked", "parts")

    def run(batches):
        own, best = None, None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
            for i, key in enumerate(keys):
                if key != own:
                    if best is not None:
                        yield best.rows_out()
                    own, best = key, Best(k, *_matrix(b.column(3), i))
                best.search(Shard.unpack([p.as_buffer() for p in b.column(4)[i].values]))
        if best is not None:
            yield best.rows_out()

    found = pairs.mapInArrow(run, "query long, query_id long, row long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("row") >= 0, F.col("vec_id")).alias("vec_id"), "score")


def op12(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, 1024.0)


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r,
         list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
scored AS (
  SELECT q.r AS qr, q.vec_id AS query_id, v.vec_id, v.r,
         CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.r <> v.r AND len(q.x) = len(v.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank
  FROM scored) WHERE rank <= 10
"""
