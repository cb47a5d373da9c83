r"""Chat formatting by schema fingerprints.

Conversations arrive as JSON records of mixed layouts.  The nested field
paths of a record are hashed; the hash selects a declarative mapping, which
reads the layout's fields and gives canonical turns (role, text).  Records
whose fingerprint no mapping claims keep a null layout and null turns.

Template: every turn is ``<|im_start|>role\ntext<|im_end|>\n``.  Control
strings inside a text (those marks, and the sentence, instruction and system
marks of other common templates) are broken by one backslash behind their
first sign; a control string that has k backslashes there already gets k + 1,
so removing one restores any text.  Roles escape ``%``, ``<`` and line
breaks.  The loss mask is the text of the assistant turns.

Only DataFrame functions are used.

Defined cases: null texts and roles count as empty; turns are ordered by
turn number (null first), then role and text; repeated rows are repeated
turns; rows with a null conversation id form one conversation; a record that
is no JSON object has no layout; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
_TAIL = r"(?=\|im_(?:start|end)\|>|/?s>|</?SYS>>|/?INST\])"
TURNS = "array<struct<role: string, text: string>>"


# ------------------------------------------------------------- fingerprints

def skeleton(record: Column) -> Column:
    """The record with empty texts, so its size does not depend on them
    (``try_parse_json`` gives null for a text of over 20 M characters or a
    record of over 128 MiB).  Broken JSON stays broken."""
    # the same JSON without a quote inside a string
    plain = F.replace(F.replace(record, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    # names with their colon are kept; strings with control signs are no JSON and stay
    empty = F.regexp_replace(plain, r'("[^"\x00-\x1f]*+"[ \t\r\n]*+:)|(")[^"\x00-\x1f]*+(")', "$1$2$3")
    once = F.regexp_replace(empty, r'(\{"[^{}]*+\},)\1++', "$1")  # equal neighbours in a list
    broken = plain.rlike(r"\\(?![/bfnrt]|u[0-9a-fA-F]{4})")
    return F.when(broken, None).otherwise(once)


def paths_of(record: Column) -> Column:
    """The nested field paths of a JSON record, without the types of values."""
    schema = F.schema_of_variant(F.try_parse_json(skeleton(record)))
    return F.regexp_replace(schema, r"(?<=[:<] ?)(?:STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|VARIANT|BINARY|DATE|"
                                    r"TIMESTAMP(?:_NTZ)?|DECIMAL\([0-9, ]*\))(?=[,>])", "_")


def fingerprint(record: Column) -> Column:
    return F.sha2(paths_of(record).cast("binary"), 256)


@dataclass(frozen=True)
class Mapping:
    """One layout: required and optional fields (name -> path text as
    ``paths_of`` writes it), the schema to read and the turns to build."""

    name: str
    required: dict[str, str]
    optional: dict[str, str]
    schema: str
    turns: Callable[[Column], Column]

    def fingerprints(self) -> list[str]:
        found = []
        for use in product([False, True], repeat=len(self.optional)):
            fields = self.required | {k: v for (k, v), on in zip(self.optional.items(), use, strict=True) if on}
            text = "OBJECT<" + ", ".join(f"{k}: {fields[k]}" for k in sorted(fields)) + ">"
            found.append(hashlib.sha256(text.encode()).hexdigest())
        return found


def _turn(role, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _list(items: Column, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    def one(x):
        r = x[role]
        for old, new in (names or {}).items():
            r = F.when(x[role] == old, F.lit(new)).otherwise(r)
        return _turn(r, x[text])
    return F.transform(items, one)


def _fixed(*turns: tuple[str, Column]) -> Column:
    """Turns of single fields; a missing field has no turn."""
    some = F.array(*[F.when(c.isNotNull(), _turn(role, c)) for role, c in turns])
    return F.filter(some, lambda x: x.isNotNull())


def _instruction(r: Column) -> Column:
    ask = F.when(F.coalesce(r["input"], F.lit("")) == "", r["instruction"]).otherwise(
        F.concat(F.coalesce(r["instruction"], F.lit("")), F.lit("\n\n"), r["input"]))
    return _fixed(("system", r["system"]), ("user", ask), ("assistant", r["output"]))


MAPPINGS = (
    Mapping("messages", {"messages": "ARRAY<OBJECT<content: _, role: _>>"}, {"id": "_"},
            "messages array<struct<role: string, content: string>>",
            lambda r: _list(r["messages"], "role", "content")),
    Mapping("speakers", {"conversations": "ARRAY<OBJECT<from: _, value: _>>"}, {"id": "_"},
            "conversations array<struct<from: string, value: string>>",
            lambda r: _list(r["conversations"], "from", "value", {"human": "user", "gpt": "assistant"})),
    Mapping("prompt", {"prompt": "_", "response": "_"}, {"system": "_", "id": "_"},
            "system string, prompt string, response string",
            lambda r: _fixed(("system", r["system"]), ("user", r["prompt"]), ("assistant", r["response"]))),
    Mapping("completion", {"completion": "_", "prompt": "_"}, {"id": "_"},
            "prompt string, completion string",
            lambda r: _fixed(("user", r["prompt"]), ("assistant", r["completion"]))),
    Mapping("instruction", {"instruction": "_", "output": "_"}, {"input": "_", "system": "_", "id": "_"},
            "system string, instruction string, input string, output string", _instruction),
    Mapping("question", {"answer": "_", "question": "_"}, {"context": "_", "id": "_"},
            "context string, question string, answer string",
            lambda r: _fixed(("system", r["context"]), ("user", r["question"]), ("assistant", r["answer"]))),
    Mapping("nested", {"data": "OBJECT<dialog: ARRAY<OBJECT<speaker: _, utterance: _>>>"}, {"id": "_"},
            "data struct<dialog: array<struct<speaker: string, utterance: string>>>",
            lambda r: _list(r["data"]["dialog"], "speaker", "utterance", {"bot": "assistant"})),
)


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` to JSON records."""
    by_print = F.create_map(*[F.lit(x) for m in MAPPINGS for f in m.fingerprints() for x in (f, m.name)])
    turns = F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        read = F.transform(F.array(F.from_json(record, m.schema, {"maxStringLen": str(2 ** 31 - 1)})), m.turns)[0]  # parsed once
        turns = F.when(F.col("layout") == m.name, read).otherwise(turns)
    return (records.withColumn("fingerprint", fingerprint(F.col(record)))
            .withColumn("layout", F.try_element_at(by_print, F.col("fingerprint")))
            .withColumn("turns", turns.cast(TURNS)))


# ----------------------------------------------------------------- template

def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2")


_ROLE = (("%", "%25"), ("<", "%3C"), ("\n", "%0A"))


def _escape_role(role: Column) -> Column:
    for a, b in _ROLE:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _unescape_role(role: Column) -> Column:
    for a, b in reversed(_ROLE):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def render(turns: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))), "")


def read_back(formatted: Column) -> Column:
    """The canonical turns of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.transform(
        F.array(F.substring_index(p, "\n", 1)), lambda role: F.struct(
            _unescape_role(role).alias("role"),
            unescape(F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - (len(END) + 2))).alias("text")))[0])


def loss_spans(formatted: Column) -> Column:
    """(start, length) in code points of every assistant text in the output."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    marked = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(
        F.length(p).alias("n"), F.length(F.substring_index(p, "\n", 1)).alias("r"),
        (F.substring_index(p, "\n", 1) == "assistant").alias("on")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))
    return F.aggregate(marked, start, lambda s, x: F.struct(
        (s["at"] + len(START) + x["n"]).alias("at"),
        F.when(x["on"], F.concat(s["spans"], F.array(F.struct(
            (s["at"] + len(START) + x["r"] + 1).alias("start"),
            (x["n"] - x["r"] - (len(END) + 2)).alias("length"))))).otherwise(s["spans"]).alias("spans")))["spans"]


def format_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Records with layout, formatted text and loss spans."""
    return (canonical(records, record).withColumn("formatted", render(F.col("turns")))
            .withColumn("loss", loss_spans(F.col("formatted"))))


# -------------------------------------------------------------------- query

def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record): one JSON record per conversation of turn rows, in
    the layout that its turns fit: prompt and response, instruction with a
    system text, or a list of messages or speakers."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), "|")

    def text(i):
        return F.col("t")[i]["text"]
    prompt = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    instruction = F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(
        x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    known = F.forall("t", lambda x: x["role"].isin("user", "assistant", "system"))
    speakers = F.to_json(F.struct(F.transform("t", lambda x: F.struct(
        F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"),
        x["text"].alias("value"))).alias("conversations")))
    return conv.select("conv_id", F.when(roles == "user|assistant", prompt)
                       .when(roles == "system|user|assistant", instruction)
                       .when(known & (F.pmod("conv_id", F.lit(2)) == 0), speakers)
                       .otherwise(messages).alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted text gives when it is read back."""
    said = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    spans = F.aggregate("loss", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return (formatted.withColumn("back", read_back(F.col("formatted"))).withColumn("lost", loss)
            .select("conv_id", F.size("back").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
                    F.length("lost").cast("long").alias("loss_chars"),
                    F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"),
                    "layout", spans.alias("span_chars")))


def op3(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(
        *[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
          for i, role in enumerate(("user", "assistant"))])).alias("x")).select("conv_id", "x.*")
    return digest(format_records(records_of_rows(rows.unionByName(own))))


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT CAST(-7 AS BIGINT), t, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, role)),
x AS (
  SELECT *, length(text) + len(regexp_extract_all(text,
           '[<\[]\\*(?:\|im_(?:start|end)\|>|/?s>|</?SYS>>|/?INST\])')) AS coded,
         length(role) + 2 * len(regexp_extract_all(role, '[%<\n]')) AS role_coded,
         role = 'assistant' AS said FROM r),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE said), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE said), '')) AS loss_sha256,
    -- the marks: 12 characters and a line break before a text, 10 and a line break behind it
    CAST(sum(12 + role_coded + 1 + coded + 10 + 1) AS BIGINT) AS formatted_chars,
    CAST(coalesce(sum(coded) FILTER (WHERE said), 0) AS BIGINT) AS span_chars,
    string_agg(role, '|' ORDER BY turn NULLS FIRST, role, text) AS roles,
    bool_and(role IN ('user', 'assistant', 'system')) AS known
  FROM x GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, span_chars,
  CASE WHEN roles = 'user|assistant' THEN 'prompt' WHEN roles = 'system|user|assistant' THEN 'instruction'
       WHEN known AND conv_id % 2 = 0 THEN 'speakers' ELSE 'messages' END AS layout
FROM c"""
