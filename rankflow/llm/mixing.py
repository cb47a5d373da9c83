r"""Mixing sources to target weights by entropy balancing.

For every source s with word target T the rates r_i of its documents
minimise the relative entropy  sum r log r - r + 1  subject to
sum size_i r_i = T and r_i <= cap.  The solution is the capped exponential
tilt  r_i = min(cap, exp(lambda_s * size_i / mean_s)),  and lambda_s solves
the convex dual.  All sources take their Newton step in one distributed
aggregation per iteration, kept inside a bracket.  The rate depends on the
source and the size only, so the steps run on the (source, size) histogram.

Rounding into whole copies: floor(r) copies for all, plus one more for K
documents of a histogram cell, K by cumulative rounding along the sizes of
the source, which leaves each source within about half its largest document
of the target.  Inside a cell the K documents are those first in hash order;
large cells are cut into hash buckets of bounded size first.

Defined cases: a null text counts 0 words, a null source is a source of its
own (last), a null doc_id is kept; repeated rows are separate documents;
documents without words take 0; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, saved, table, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
BUCKET_ROWS = 2000


def _source_key(c: str) -> Column:
    """Orders sources by code point, null last."""
    return F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(c)))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(skey, n, total, target) from (skey, size): ``budget`` times all words
    shared by weight; a target stops at ``cap`` times its source's words and
    the excess is reshared until none is above."""
    spark = sizes.sparkSession
    per = sizes.groupBy("skey").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    schema = T.StructType([T.StructField("skey", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("total", T.LongType()), T.StructField("pos", T.LongType())])
    ranked = per.orderBy("skey").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    src = saved(spark.createDataFrame(ranked, schema).withColumn("w", w))
    words = src.agg(F.sum("total")).first()[0] or 0
    level = 0.0  # words per unit of weight
    while words:
        above = F.col("w") * level >= F.col("total") * cap
        got = src.agg(F.sum(F.when(above, F.col("total")).otherwise(0)).alias("full"),
                      F.sum(F.when(above, 0).otherwise(F.col("w"))).alias("open")).first()
        if not got["open"]:
            break
        nxt = (budget * words - cap * got["full"]) / got["open"]
        if nxt <= level:
            break
        level = nxt
    return src.select("skey", "n", "total",
                      F.least(F.col("w") * F.lit(level), (F.col("total") * cap).cast("double")).alias("target"))


def solve_rates(hist: DataFrame, goal: DataFrame, cap: int = CAP, tol: float = 1e-9,
                max_iter: int = 200) -> DataFrame:
    """Newton on the dual of every source at once: (skey, lam, mean).

    ``hist`` is (skey, size, m), ``goal`` is (skey, n, total, target)."""
    mean = F.col("total") / F.col("n")
    state = saved(goal.filter("total > 0").select(
        "skey", "target", mean.alias("mean"),
        # a target at the cap needs every rate there: size >= 1 word suffices
        F.when(F.col("target") >= F.col("total") * cap, F.log(F.lit(float(cap))) * mean)
        .otherwise(F.log(F.col("target") / F.col("total"))).alias("lam"),
        F.lit(-1e12).alias("lo"), (F.log(F.lit(float(cap))) * mean).alias("hi")))
    for _ in range(max_iter):
        z = F.col("size") / F.col("mean")
        raw = F.exp(F.col("lam") * z)
        got = (hist.join(state, "skey").groupBy("skey").agg(
            F.sum(F.col("m") * F.col("size") * F.least(raw, F.lit(float(cap)))).alias("f"),
            F.sum(F.when(raw < cap, F.col("m") * F.col("size") * z * raw).otherwise(0.0)).alias("df")))
        err = F.col("f") - F.col("target")
        done = F.abs(err) <= F.col("target") * tol
        lo = F.when(err < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(err >= 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - err / F.when(F.col("df") > 0, F.col("df"))
        mid = F.when(F.col("lo2") <= -1e11, F.col("hi2") * 2 - 1 - F.abs(F.col("hi2"))).otherwise(
            (F.col("lo2") + F.col("hi2")) / 2)
        state = saved(state.join(got, "skey").withColumns({"lo2": lo, "hi2": hi, "step": step, "done": done})
                      .select("skey", "target", "mean",
                              F.when(F.col("done"), F.col("lam"))
                              .when((F.col("step") > F.col("lo2")) & (F.col("step") < F.col("hi2")), F.col("step"))
                              .otherwise(mid).alias("lam"),
                              F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "done"))
        if not state.filter(~F.col("done") & (F.col("hi") - F.col("lo") > 1e-13 * F.abs("hi"))).limit(1).count():
            break
        state = state.drop("done")
    # sums arrive in any order: the last digits are cut, so reruns agree
    return state.select("skey", F.round("lam", 9).alias("lam"), "mean")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP, keep: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate,
    copies, taken, and the column ``keep`` as ``kept``."""
    base = saved(docs.select("doc_id", "source", F.col(keep).alias("kept"), word_count(F.col("text")).alias("size"),
                             _source_key("source").alias("skey"),
                             F.xxhash64("doc_id").alias("h")))
    goal = saved(targets(base, weights, budget, cap))
    hist = saved(base.filter("size > 0").groupBy("skey", "size").agg(F.count(F.lit(1)).alias("m")))
    lam = solve_rates(hist, goal, cap)
    rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("mean")))
    cells = hist.join(lam, "skey").withColumn("rate", F.round(rate, 9))
    cells = cells.withColumn("extra", F.col("m") * (F.col("rate") - F.floor("rate")))
    run = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    # a source has at most as many cells as there are different sizes
    cells = (cells.withColumn("cum", F.round(F.sum("extra").over(run), 6))
             .withColumn("k", F.least(F.col("m"), F.floor(F.col("cum") + 0.5)
                                      - F.floor(F.round(F.col("cum") - F.col("extra"), 6) + 0.5)))
             .select("skey", "size", "m", "rate", "k",
                     F.ceil(F.col("m") / BUCKET_ROWS).alias("nb")))
    cells = saved(cells)
    placed = (base.join(cells, ["skey", "size"], "left")
              .withColumn("b", F.pmod(F.col("h"), F.coalesce("nb", F.lit(1))))
              # else the cell's own layout would serve the window below, whole cells in one task
              .repartition("skey", "size", "b"))
    # the k extra copies of a large cell, spread over its hash buckets
    buckets = (base.join(cells.filter("nb > 1"), ["skey", "size"])
               .withColumn("b", F.pmod(F.col("h"), F.col("nb")))
               .groupBy("skey", "size", "b").agg(F.count(F.lit(1)).alias("mb"), F.first("m").alias("bm"),
                                                 F.first("k").alias("bk")))
    cum = F.sum("mb").over(Window.partitionBy("skey", "size").orderBy("b")
                           .rowsBetween(Window.unboundedPreceding, 0))
    buckets = (buckets.withColumn("cb", cum)
               .select("skey", "size", "b",
                       F.expr("(cb * bk) div bm - ((cb - mb) * bk) div bm").alias("kb")))
    order = Window.partitionBy("skey", "size", "b").orderBy("h", "doc_id")
    words = placed.filter("size > 0").join(buckets, ["skey", "size", "b"], "left")
    words = (words.withColumn("extra", (F.row_number().over(order) <= F.coalesce("kb", "k")).cast("long"))
             .withColumn("copies", F.floor("rate") + F.col("extra")))
    none = placed.filter("size = 0").withColumn("copies", F.lit(0).cast("long"))
    cols = ["doc_id", "source", "kept", "skey", "size", "rate", "copies"]
    return (words.select(cols).unionByName(none.select(cols)).join(goal, "skey")
            .select("doc_id", "source", "size", F.col("total").alias("source_size"), "target",
                    F.coalesce("rate", F.lit(0.0)).alias("rate"), F.col("copies").cast("long").alias("copies"),
                    (F.col("copies") * F.col("size")).cast("long").alias("taken"), "kept"))


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it,
    with the number of the copy (from 1).  Rows with the same id, source and
    text count as one document that is taken as often as they are together."""
    name = free_name(docs, "copy")
    key = F.xxhash64("doc_id", "source", "text")
    rated = mix(docs.withColumn(free_name(docs, "key"), key), keep=free_name(docs, "key"), **how)
    plan = saved(rated.groupBy(F.col("kept").alias("key")).agg(F.count(F.lit(1)).alias("n"),
                                                               F.sum("copies").alias("copies")).filter("copies > 0"))
    rows = docs.alias("d").join(plan.alias("p"), F.xxhash64("d.doc_id", "d.source", "d.text") == F.col("p.key"))
    once = rows.filter("p.n = 1").select("d.*", F.col("p.copies").alias(name))
    again = (rows.filter("p.n > 1").groupBy("p.key", "p.copies")
             .agg(F.min_by(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]),
                           F.struct("d.lang", "d.n_chars")).alias("row"))
             .select("row.*", F.col("copies").alias(name)))
    return once.unionByName(again).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name))))


def op9(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate")
