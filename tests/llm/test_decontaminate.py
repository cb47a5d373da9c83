"""Decontamination: planted passages, new parameters, plain-Python windows."""

import random
import re

import pytest

from rankflow.llm import decontaminate as D

from .conftest import clash

ITEM = ("Alice walks 5 km to the shop in Paris and then Bob walks 7 km back to the house with 5 apples "
        "while the old man counts all of the birds on the roof.")


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, ITEM), (2, "too short"), (3, None), (4, "the rain fell on the quiet town and the river rose above its banks"),
            (4, "another text under the same number that nobody ever copied into a page")]
    return spark.createDataFrame(rows, "item_id long, text string")


def found(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_planted(spark, bench):
    texts = {
        1: ITEM, 2: "Before. " + ITEM + " After it.", 3: ITEM.upper().lower(),
        4: ITEM.replace("5", "9").replace("7", "3").replace("Paris", "Rome").replace("Bob", "Dan"),  # new parameters
        5: ITEM.replace(" ", "\n  "), 6: "x " * 50 + "The rain fell, on the quiet town; and the river rose above its banks!",
        # slots that contradict each other are no copy with new parameters
        7: ITEM.replace("5 km", "9 km").replace("5 apples", "4 apples").replace("Paris", "Rome"),
        8: "Alice walks 5 km to the shop", 9: "the rain fell on the loud city and a river sank below its banks",
        10: None, 11: "", 12: "word " * 5000, 13: "1 2 3 4 5 6 7 8 9 " * 100,
    }
    got = found(D.leaks(docs_of(spark, texts), bench))
    assert {(d, 1) for d in (1, 2, 4)} | {(6, 4)} <= got
    assert not {d for d, _ in got} & {8, 9, 10, 11, 12, 13}


def test_line_breaks_end_sentences(spark, bench):
    # names after a line break are not told from first words, the rest still matches
    got = D.leaks(docs_of(spark, {5: ITEM.replace(". ", ".\n")}), bench)
    assert found(got) == {(5, 1)}


def test_conflicting_slots(spark):
    item = "take 5 of the red stones and 5 of the blue stones and 6 of the green stones then count"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    same = item.replace("5", "8").replace("6", "2")
    torn = "take 8 of the red stones and 9 of the blue stones and 6 of the green stones then count"
    assert found(D.leaks(docs_of(spark, {1: same, 2: torn}), bench)) == {(1, 1)}


def slow_windows(text):
    """Windows of texts without numbers and inner capitals."""
    words = [re.sub(r"[^\w]", "", w.lower()) for w in text.split()]
    words = [w for w in words if w]
    return {tuple(words[i:i + D.WINDOW]): i for i in range(len(words) - D.WINDOW + 1)}


def test_coverage_against_plain_windows(spark):
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("ala", "ere", "iti", "oso")]
    items = {i: " ".join(rng.choices(vocab, k=rng.randint(8, 40))) for i in range(12)}
    texts = {}
    for d in range(60):
        words = items[d % 12].split()
        cut = rng.randint(0, len(words) // 2)
        texts[d] = " ".join(rng.choices(vocab, k=30) + words[cut:] + rng.choices(vocab, k=30))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = set()
    for d, t in texts.items():
        have = slow_windows(t)
        for i, item in items.items():
            at = sorted(p for w, p in slow_windows(item).items() if w in have)
            run = best = 0
            for k, p in enumerate(at):
                run = run + 1 if k and at[k - 1] == p - 1 else 1
                best = max(best, run)
            n = len(item.split()) - D.WINDOW + 1
            if len(at) / n >= D.COVER or best and best + D.WINDOW - 1 >= D.RUN:
                want.add((d, i))
    assert found(D.leaks(docs_of(spark, texts), bench)) == want
    assert found(D.leaks(docs_of(spark, texts), bench, broadcast_windows=0)) == want


def test_query_finds_whole_passages(spark, sf, sf_docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in sf_docs for i, x in items if t and x in t}
    got = found(D.op5(spark, sf))
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}


def test_clean_keeps_columns_and_odd_rows(spark, odd, no_docs, bench):
    names = ("th", "h", "pos", "vals", "raw", "canon", "item_id", "__t")
    wide = clash(odd, *names)
    kept = D.clean(wide, bench)
    assert kept.columns == wide.columns and kept.count() == odd.count()
    bad = spark.createDataFrame([(None, ITEM, "en", None, 1), (5, ITEM, "en", "a", 1), (5, ITEM, "en", "a", 1)], odd.schema)
    both = clash(odd.unionByName(bad), *names)
    assert sorted(map(str, D.clean(both, bench).collect())) == sorted(map(str, kept.collect()))
    assert D.clean(no_docs, bench).count() == 0
    assert D.leaks(odd, bench.limit(0)).count() == 0


def test_copies_in_other_cases(spark, bench):
    """Capitals, lower case and title case, also re-flowed; a torn copy stays none."""
    flow = ITEM.upper().replace(" ", "\n  ", 3)
    got = D.leaks(docs_of(spark, {1: ITEM.upper(), 2: ITEM.lower(), 3: ITEM.title(), 4: "x y z. " + flow + " Z", 5: ITEM.upper().replace(
        "5 KM", "9 KM").replace("5 APPLES", "4 APPLES"), 6: ITEM.upper().replace("5", "8").replace("7", "6"), 7: ITEM}), bench)
    assert found(got) == {(i, 1) for i in (1, 2, 3, 4, 6, 7)}
    assert {r.doc_id: r.coverage for r in got.collect()}[1] == 1


SHORT = {0: "What is 12 + 7 * 3 - 4?", 1: "Solve 3x + 5 = 20", 2: "Who wrote Hamlet?", 3: "Word", 4: "1 2 3 4 5 6 7 8"}


def test_short_and_number_dense_items(spark):
    bench = spark.createDataFrame(list(SHORT.items()), "item_id long, text string")
    texts = {**{k: f"before. {t} after" for k, t in SHORT.items()},
             10: "What is 9 + 8 * 7 - 6?", 11: "now Solve 5x + 7 = 21 ok", 12: "and who wrote Macbeth?",
             13: "9 8 7 6 5 4 3 2 1 9 8 7", 14: "What is 1, and what is 2 + 3?", 15: "she wrote it", 16: "WHO WROTE HAMLET"}
    want = {(k, k) for k in (0, 1, 2)} | {(10, 0), (11, 1), (12, 2), (16, 2)}
    assert found(D.leaks(docs_of(spark, texts), bench)) == want
    assert found(D.leaks(docs_of(spark, texts), bench, broadcast_windows=0)) == want


def test_dense_item_among_others_needs_all_windows(spark):
    dense = "Add 1 2 3 4 5 and 6 7 8 9 now"
    bench = spark.createDataFrame([(1, dense), (2, ITEM)], "item_id long, text string")
    texts = {1: dense, 2: "Add 9 8 7 6 5 and 4 3 2 1 now", 3: "Add 1 2 3 4 5 and 6 7 8 then", 4: ITEM}
    assert found(D.leaks(docs_of(spark, texts), bench)) == {(1, 1), (2, 1), (4, 2)}


def slow_templates(text):
    """Template words with their values, by plain rules: numbers, and capitalised words inside a sentence."""
    out = []
    for m in re.finditer(r"\S+", text):
        word = m[0]
        inner = m.start() > 1 and re.match(r"[\w,;)'\"] ", text[m.start() - 2:m.start()])
        plain = re.sub(r"[^\w]", "", word).lower()
        if re.fullmatch(r"\d+", plain):
            out.append(("N", plain))
        elif inner and word[0].isupper():
            out.append(("NAME", plain))
        elif plain:
            out.append((plain, None))
    return out


def test_slots_against_plain_templates(spark):
    """Items with numbers and names, copied with other ones, consistently or not."""
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("ala", "ere", "iti")]
    names = ["Alice", "Bob", "Carol", "Dan", "Eve"]

    def item():
        words = rng.choices(vocab, k=12)
        for at in rng.sample(range(1, 12), 3):
            words[at] = rng.choice(names + ["12", "7", "55"])
        return " ".join(words)
    items = {i: item() for i in range(15)}
    texts = {}
    for d in range(90):
        swap = {w: rng.choice(names) for w in names} | {w: str(rng.randrange(100, 900)) for w in ("12", "7", "55")}
        words = [swap.get(w, w) for w in items[d % 15].split()]
        if d % 3 == 1:  # torn: one place takes a value of its own
            slots = [k for k, w in enumerate(items[d % 15].split()) if w in swap]
            words[rng.choice(slots)] = "Zoe" if rng.random() < 0.5 else "4711"
        texts[d] = "zaza zozo " + " ".join(words) + " zizi"
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")

    def aligned(t, i):
        """Windows of the item found at one shift, with consistent slots."""
        a, b = slow_templates(items[i]), slow_templates(texts[t])
        rich = [p for p in range(len(a) - 4) if sum(v is None for _, v in a[p:p + 5]) >= 3]
        best = 0
        for shift in range(-len(a), len(b)):
            hit = [p for p in rich if 0 <= p + shift <= len(b) - 5
                   and [w for w, _ in a[p:p + 5]] == [w for w, _ in b[p + shift:p + shift + 5]]]
            pairs = {(a[p + k][1], b[p + shift + k][1]) for p in hit for k in range(5) if a[p + k][1]}
            if len(pairs) - len({x for x, _ in pairs}) <= 0.2 * len({x for x, _ in pairs}):
                best = max(best, len(hit))
        return best / len(rich)
    got = {(r.doc_id, r.item_id): r.coverage for r in D.leaks(docs_of(spark, texts), bench).collect()}
    for d in texts:
        share = aligned(d, d % 15)
        # the case-folded form can only add to what the template finds
        assert share < D.COVER or got[d, d % 15] >= share - 1e-9, (d, items[d % 15], texts[d])
        if d % 3 != 1:
            assert share == 1.0 and (d, d % 15) in got
    assert {i for d, i in got if d % 15 != i} == set()
