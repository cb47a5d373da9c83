"""Benchmark decontamination by template windows and slot consistency.

A text becomes a template: words are cut at white space, signs around and
inside them are dropped, letters are lower-cased, and numbers, units behind
a number, and names (capitalised words inside a sentence) are replaced by
typed placeholders.  A second, case-folded form leaves names as lower-case
words, so a copy in capitals or in lower case matches too.  Windows of
``WINDOW`` words of either form, of which at least ``LITERALS`` are no
placeholders, are hashed and joined with the windows of the benchmark; a
window that is the same in both forms goes once.  Of an item with fewer
words the whole template is its one window, and of an item without a window
of enough literals all windows with a literal count; such an item is found only if one alignment has all its windows.  Matches are grouped by
document, item, form and alignment; within
an alignment a slot value of the item must always stand for the same value
of the document; if more than ``CONFLICTS`` of the values conflict, the
alignment is no copy with new parameters and is dropped.  An item is leaked into a document if the windows
that are left cover ``COVER`` of the item's windows of one form, or ``RUN``
words of it in one alignment.

Only DataFrame functions are used.  All windows of all texts take part; they
are hashed inside the scan's stage.  If the benchmark's windows were counted
to be ``BROADCAST_WINDOWS`` or fewer, windows whose hash is not among the
benchmark's by a table of bits (it errs to one side only) end there, and the
others meet the benchmark in a broadcast hash join; else all are exploded to
a shuffled join.  Only matches are shuffled.

Defined cases: null and empty texts, items of one word and items without a
literal match nothing; a very long text is one array of hashes in its task;
ties do not occur (every leaked item of a document is reported); a null doc_id, repeated ids and repeated rows are told apart by the text's hash;
null item texts are left out; an empty table or benchmark gives no matches;
other columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

WINDOW = 5
LITERALS = 3
COVER = 0.8
RUN = 20
CONFLICTS = 0.2
BROADCAST_WINDOWS = 1_000_000

# Placeholders: control characters 1 (name), 2 (unit) and 3 (number).
UNITS = ("km|kilometers?|kilometres?|cm|mm|m|meters?|metres?|miles?|feet|ft|inch(?:es)?|kg|g|mg|grams?|kilograms?|lbs?|"
         "pounds?|ounces?|oz|tons?|l|ml|liters?|litres?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|"
         "months?|years?|dollars?|cents?|euros?|usd|eur|percent|degrees?|mph|kmh|watts?|kw|volts?|amps?")
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’–—…¿¡"


def templates(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` plus ``raw``, ``canon`` and ``folded``: aligned arrays of words,
    template words and case-folded words without names."""
    # a line break stays a word of its own until the names are found, as it
    # ends a sentence like a full stop does
    flat = F.replace(F.translate(F.col(text), "\t\x0b\f\r", "    "), F.lit("\n"), F.lit(" \n "))
    df = df.select(*keys, flat.alias("__t"))
    canon = F.regexp_replace("__t", r"\p{Lu}(?<=[\p{L}\p{N},;)'\"] \p{Lu})[\p{L}'’-]*", "\u0001")

    def typed(c):
        return F.when(F.col("__t").rlike("[0-9]"), F.regexp_replace(
            F.regexp_replace(c, rf"(?<=[0-9])( ?)(?:{UNITS})(?![\p{{L}}\p{{N}}])", "$1\u0002"),
            _NUMBER, "\u0003")).otherwise(c)
    canon = F.lower(F.translate(typed(canon), _PUNCTUATION, ""))
    folded = F.translate(typed(F.lower("__t")), _PUNCTUATION, "")
    # all arrays are split at the same blanks, so they stay aligned
    return df.select(*keys, F.split("__t", " ").alias("raw"), F.split(canon, " ").alias("canon"),
                     F.split(folded, " ").alias("folded"))


def _slot(word: Column) -> Column:
    return word.rlike("[\u0001-\u0003]")


def _window_hash(hs: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[hs[i + k] for k in range(size)])


def _value(word: Column) -> Column:
    return F.lower(F.translate(word, _PUNCTUATION, ""))


def windows(df: DataFrame, keys: list[str], text: str, size: int = WINDOW, wanted: Bits | None = None) -> DataFrame:
    """``keys``, ``pos``, ``h``, ``vals`` (the slots' values in order, null
    without slots), ``form`` (1: template, 2: case-folded, 3: the same in
    both) and ``n_words`` (of the text) of all windows of ``size`` words, or
    of those whose hash ``wanted`` may hold."""
    t = templates(df, keys, text)
    pairs = F.filter(F.arrays_zip("raw", "canon", "folded"), lambda x: (x["canon"] != "") & (x["canon"] != "\n"))
    # bound once inside the generator: neither later uses nor a filter on the
    # result compute the windows again
    w = F.transform(F.array(F.struct(pairs.alias("p"))), lambda s: _window_array(s["p"], size, wanted))[0]
    return t.select(*keys, F.explode(w).alias("x")).select(*keys, "x.pos", "x.h", "x.vals", "x.form", "x.n_words")


def _window_array(p: Column, size: int, wanted: Bits | None) -> Column:
    def hashed(name):
        return F.transform(p, lambda x: F.xxhash64(x[name]))
    state = F.array(F.struct(p.alias("p"), hashed("canon").alias("canon"), hashed("folded").alias("folded")))

    def every(last):
        return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def starts_of_other(s, last):
        """Windows with a word that differs between the forms."""
        other = F.filter(every(F.size(s["p"]) - 1), lambda i: s["canon"][i] != s["folded"][i])
        near = F.transform(other, lambda i: F.when(last >= 0, F.sequence(
            F.least(F.greatest(i - size + 1, F.lit(0)), last), F.least(i, last))).otherwise(F.array().cast("array<int>")))
        return F.array_distinct(F.flatten(near))

    def of(s, starts, name):
        """(pos, h) of the windows of one form that are wanted."""
        got = F.transform(starts, lambda i: F.struct(i.alias("pos"), _window_hash(s[name], i, size).alias("h")))
        return got if wanted is None else F.filter(got, lambda x: wanted.may_hold(x["h"]))

    def whole(s, x, name, form):
        part = F.slice(s["p"], x["pos"] + 1, size)
        vals = F.transform(F.filter(part, lambda y: _slot(y[name])), lambda y: _value(y["raw"]))
        return F.struct(x["pos"].alias("pos"), x["h"].alias("h"), F.when(F.size(vals) > 0, vals).alias("vals"),
                        form.cast("int").alias("form"), F.size(s["p"]).alias("n_words"))

    def build(s):
        last = F.size(s["p"]) - size

        def same(x):
            return F.slice(s["canon"], x["pos"] + 1, size) == F.slice(s["folded"], x["pos"] + 1, size)
        template = F.transform(of(s, every(last), "canon"), lambda x: whole(
            s, x, "canon", F.when(same(x), 3).otherwise(1)))
        folded = F.transform(of(s, starts_of_other(s, last), "folded"), lambda x: whole(s, x, "folded", F.lit(2)))
        return F.when(s["canon"] == s["folded"], template).otherwise(F.concat(template, folded))

    return F.transform(state, build)[0]


class Bits:
    """A set of hashes as bits of an array: holds all of them, and about one
    in sixteen others."""

    def __init__(self, hashes: DataFrame, n: int):
        self.words = 1 << max(6, (n * 16 // 64).bit_length())
        word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(self.words - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
        rows = hashes.groupBy(word.alias("i")).agg(F.bit_or(bit).alias("b")).collect()  # self.words at most
        full = [0] * self.words
        for i, b in rows:
            full[i] = b
        self.array = F.from_json(F.lit(str(full)), "array<bigint>")  # folded to a constant

    def may_hold(self, h: Column) -> Column:
        word = F.get(self.array, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(self.words - 1)).cast("int"))
        return F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, ns, needs, item_pos, h, item_vals, item_form, size) of the
    windows of items (item_id, text) that count: ``ns`` the number by form,
    ``needs`` the share of them that makes a leak (null: the usual one)."""
    items = items.withColumn("it", F.xxhash64("text"))
    every = None
    for size in range(2, WINDOW + 1):
        part = windows(items, ["item_id", "it"], "text", size).withColumn("size", F.lit(size))
        part = part if size == WINDOW else part.filter(F.col("n_words") == size)
        every = part if every is None else every.unionByName(part)
    every = saved(every.withColumn("literals", F.col("size") - F.coalesce(F.size("vals"), F.lit(0))))
    rich = F.col("literals") >= F.least(F.lit(LITERALS), F.col("size"))

    def counts(form):
        return F.count(F.when(F.col("form") != 3 - form, 1)), F.count(F.when((F.col("form") != 3 - form) & rich, 1))
    n = every.groupBy("item_id", "it").agg(F.array(*[counts(f)[1] == 0 for f in (1, 2)]).alias("sparse")).alias("n")
    w = every.alias("w").join(n, F.expr("w.item_id <=> n.item_id and w.it = n.it")).select("w.*", "sparse")
    # of items without rich windows all count that have a literal, and all are needed
    uses = F.array(*[(F.col("form") != 3 - f) & (rich | (F.col("sparse")[f - 1] & (F.col("literals") > 0))) for f in (1, 2)])
    form = F.when(uses[0] & uses[1], 3).when(uses[0], 1).when(uses[1], 2)
    w = w.withColumn("form", form).filter("form is not null")
    total = w.groupBy("item_id", "it").agg(
        F.array(*[F.count(F.when(F.col("form") != 3 - f, 1)) for f in (1, 2)]).alias("ns")).alias("n")
    return w.alias("w").join(total, F.expr("w.item_id <=> n.item_id and w.it = n.it")).select(
        "w.item_id", "ns", F.transform("sparse", lambda x: F.when(x, 1.0)).alias("needs"), F.col("pos").alias("item_pos"),
        "h", F.col("vals").alias("item_vals"), F.col("form").alias("item_form"), "size")


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, run: int = RUN,
          broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, th, item_id, coverage, longest_run, n_slots) of every leaked
    item; ``th`` is the hash of the document's text."""
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    item_w = saved(item_windows(items))
    n, sizes = item_w.limit(broadcast_windows + 1).count(), sorted(
        r[0] for r in item_w.select("size").distinct().collect())  # WINDOW - 1 at most
    small = n <= broadcast_windows
    wanted = Bits(item_w, n) if small and n else None
    src = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").filter("text is not null")
    found = None
    for size in sizes or [WINDOW]:
        part = windows(src, ["doc_id", "th"], "text", size, wanted)
        found = part if found is None else found.unionByName(part)
    hits = found.join(F.broadcast(item_w) if small else item_w, "h")
    # the same slots in an item and a document, by their place in the window
    pairs = F.when(F.col("vals").isNotNull(), F.zip_with(
        "item_vals", "vals", lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    both = F.col("form").bitwiseAND(F.col("item_form"))
    forms = F.filter(F.array(F.lit(1), F.lit(2)), lambda f: both.bitwiseAND(f) != 0)
    hits = hits.select("doc_id", "th", "item_id", "ns", "needs", "size", "item_pos", F.explode(forms).alias("form"),
                       (F.col("pos") - F.col("item_pos")).alias("shift"), pairs.alias("pairs"))
    hits = hits.withColumns({"item_n": F.col("ns")[F.col("form") - 1], "need": F.col("needs")[F.col("form") - 1]})
    # an alignment has each item position once, or as often as the row repeats
    along = hits.groupBy("doc_id", "th", "item_id", "item_n", "need", "size", "form", "shift").agg(
        F.collect_set("item_pos").alias("at"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    values = F.array_distinct(F.transform("pairs", lambda x: x["a"]))
    along = (along.withColumn("n_slots", F.size(values))
             .filter(F.size("pairs") - F.col("n_slots") <= F.col("n_slots") * CONFLICTS)
             # an item whose windows are all needed is found in one piece
             .filter(F.col("need").isNull() | (F.size("at") >= F.col("item_n")))
             .withColumn("at", F.array_sort("at")))
    runs = F.aggregate("at", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("len"), F.lit(0).alias("best")),
                       lambda s, x: F.transform(
                           F.array(F.when(x == s["last"] + 1, s["len"] + 1).otherwise(F.lit(1))),
                           lambda n: F.struct(x.alias("last"), n.alias("len"), F.greatest(s["best"], n).alias("best")))[0])
    along = along.withColumn("longest", runs["best"])
    out = along.groupBy("doc_id", "th", "item_id", "item_n", "size", "form").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("covered"),
        F.max("longest").alias("longest"), F.max("n_slots").alias("n_slots"))
    # the better form counts
    out = out.groupBy("doc_id", "th", "item_id").agg(
        F.max(F.col("covered") / F.col("item_n")).alias("coverage"),
        F.max(F.col("longest") + F.col("size") - 1).cast("long").alias("longest_run"),
        F.max("n_slots").cast("long").alias("n_slots"))
    return out.filter((F.col("coverage") >= cover) | (F.col("longest_run") >= run))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` into which no item has leaked."""
    bad = leaks(docs, benchmark, **how).select("doc_id", "th").distinct().alias("bad")
    same = F.col("d.doc_id").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64("d.text") == F.col("bad.th"))
    return docs.alias("d").join(bad, same, "left_anti")


def op5(spark, sf_dir):
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("th")
