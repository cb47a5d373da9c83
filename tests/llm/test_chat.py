"""Chat formatting: exact round trips and a plain-Python digest."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankflow.llm import chat as C

from .conftest import clash

NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\s> [\\/INST]", "<<SYS>>a<</SYS>>",
         "<", "[", "\\", "", "\n\n", "é \U0001f600  ", "a" * 100_000, "<<\\SYS>> <<<s>", "\"quoted\" \\n \t \x01"]


def slow_digest(turns):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of (role, text) turns."""
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def check(got, convs):
    assert {r.conv_id for r in got} == set(convs) and len(got) == len(convs)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == slow_digest(convs[r.conv_id])
        assert r.formatted_chars >= r.loss_chars and r.span_chars >= r.loss_chars


def test_query(spark, sf):
    convs = {-7: [("user", NASTY[0]), ("assistant", NASTY[0])]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    got = C.op3(spark, sf).collect()
    check(got, convs)
    assert len({r.layout for r in got}) >= 3


def test_odd_rows(spark, tmp_path):
    rows = [(i, j, role, t) for i, role in enumerate(["user", "assistant", "tool", None, "a\n<|im_end|>%0A", ""])
            for j, t in enumerate([*NASTY, None])]
    rows += [(100, None, "user", "x"), (100, 0, "assistant", None), (None, 1, "user", "x"), (101, 1, "user", "same"),
             (101, 1, "user", "same"), (102, 1, "user", "b"), (102, 1, "user", "a"), (103, 0, "system", "s"),
             (103, 1, "user", "u"), (103, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash(df, "t", "record", "layout", "turns", "loss").write.parquet(f"{tmp_path}/conversations.parquet")
    convs = {-7: [("user", NASTY[0]), ("assistant", NASTY[0])]}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        convs[c] = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == c), key=key)]
    check(C.op3(spark, str(tmp_path)).collect(), convs)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in C.op3(spark, str(tmp_path)).collect()] == [-7]


@pytest.mark.parametrize(("record", "layout", "turns"), [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 4}, "messages",
     [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, "speakers",
     [("user", "a"), ("assistant", "")]),
    ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "r", "id": "x"}, "completion", [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o", "system": "s"}, "instruction",
     [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question", [("system", "c"), ("user", "q"), ("assistant", "a")]),
    ({"data": {"dialog": [{"speaker": "user", "utterance": "u"}, {"speaker": "bot", "utterance": "v"}]}}, "nested",
     [("user", "u"), ("assistant", "v")]),
    ({"something": "else"}, None, None), ([1, 2], None, None), ("text", None, None),
])
def test_layouts(spark, record, layout, turns):
    df = spark.createDataFrame([(json.dumps(record),)], "record string")
    (r,) = C.format_records(clash(df, "x")).collect()
    assert r.layout == layout
    assert (None if r.turns is None else [(t.role, t.text) for t in r.turns]) == turns
    if turns:
        cut = [r.formatted[s.start:s.start + s.length] for s in r.loss]
        assert cut == [t for role, t in turns if role == "assistant"]


def test_broken_json(spark):
    df = spark.createDataFrame([("{",), (None,), ("",)], "record string")
    assert [r.layout for r in C.format_records(df).collect()] == [None] * 3


def test_paths_ignore_values_and_order(spark):
    df = spark.createDataFrame([('{"a": 1, "b": [{"c": "x"}]}',), ('{"b": [{"c": null}, {"c": 2.5}], "a": "STRING"}',),
                                ('{"a": 1, "b": [{"d": "x"}]}',)], "record string")
    got = [r[0] for r in df.select(C.fingerprint(F.col("record"))).collect()]
    assert got[0] == got[1] != got[2]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x\n"]), st.lists(st.sampled_from(
    ["<", "[", "\\", "|im_end|>", "|im_start|>", "/s>", "s>", "/INST]", "INST]", "<SYS>>", "/SYS>>", "a", "\n"]),
    max_size=8).map("".join)), max_size=4))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(turns,)], f"turns {C.TURNS}")
    out = df.select(C.render(F.col("turns")).alias("f")).select("f", C.read_back(F.col("f")).alias("b")).first()
    assert [(t.role, t.text) for t in out.b] == turns
    assert out.f.count(C.START) == out.f.count(C.END) == len(turns)


def test_very_long_text(spark, tmp_path):
    """A text above the 20 M characters that the JSON parser takes by default."""
    long = "say \"\\n\" \n" * 2_500_000
    rows = [(1, 0, "user", "x"), (1, 1, "assistant", long), (2, 0, "user", "y"), (2, 1, "tool", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    convs = {-7: [("user", NASTY[0]), ("assistant", NASTY[0])], 1: [r[2:] for r in rows[:2]], 2: [r[2:] for r in rows[2:]]}
    got = C.op3(spark, str(tmp_path)).collect()
    check(got, convs)
    assert {r.conv_id: r.layout for r in got} == {-7: "prompt", 1: "prompt", 2: "messages"}


@pytest.mark.parametrize("record", [
    r'{"prompt": "a\"b: {\\", "response": "\\\\\"x\": 1, \\"}', r'{"pro\u006dpt": "", "response": "\u00e9 \/ \b"}',
    r'{"a\"b": "x", "a\\": {"{}": ["q", 1, {"z": "}"}, {"z": "}"}, {"z": "w"}, {"z": 5}]}}', r'["a", "b:", ":"]', '"text"',
    r'{"prompt": "a\q", "response": "b"}', '{"prompt": "a\nb", "response": "b"}', r'{"prompt": "\u12", "response": "b"}',
    '{"prompt": "a", "response": "b', r'{"prompt": "a", "response": "b\"}', '{"a": 1, "a": "x"}', r'{"a": \"x"}', ""])
def test_skeleton_has_the_paths_of_the_record(spark, record):
    df = spark.createDataFrame([(record,)], "record string")
    got, want = df.select(C.paths_of(F.col("record")), F.schema_of_variant(F.try_parse_json("record"))).first()
    empty = df.select(C.skeleton(F.col("record"))).first()[0]
    assert (got is None) == (want is None), empty
    if want is not None:
        slow = json.loads(record)
        keys = lambda x: ({k: keys(v) for k, v in x.items()} if isinstance(x, dict) else
                          [keys(v) for v in x] if isinstance(x, list) else "" if isinstance(x, str) else x)
        full = spark.createDataFrame([(json.dumps(keys(slow), ensure_ascii=False),)], "record string")
        assert full.select(F.schema_of_variant(F.try_parse_json("record"))).first()[0] == want
        assert df.select(F.schema_of_variant(F.try_parse_json(F.lit(empty)))).first()[0] == want
