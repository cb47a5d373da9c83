r"""License scan: Aho-Corasick for notice phrases and identifier tags, and a
shunting-yard evaluation of and/or/with license expressions.

A text is lower-cased (A-Z) and cut into words
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; one automaton pass over the words
joined by a space finds all phrases and identifier tags
(``SPDX-License-Identifier:``) with their places.  The expression behind a
tag is read from its place up to the end of the line and evaluated: AND, OR
and WITH with the usual order (WITH binds strongest, OR weakest) and
parentheses.  Operands are licence ids that are known (``LICENSES``, with
``+``, ``-only`` or ``-or-later``) or begin with ``LicenseRef-``; anything
else behind an operator is prose and ends the expression before the
operator.  An expression is open if a choice exists that needs permissive
licenses only.

Defined cases: null text counts as empty; texts without words have no
findings; a very long text takes time in proportion to its length, whatever
number of tags it has; findings are in the order of their places, at one
place phrases before expressions; malformed expressions are kept as findings that are not valid and
give no labels; null doc_id and repeated rows are kept as they are; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Phrases and labels of the base scan of ``op1``.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# The base phrases of a scan that names none.
PLAIN_PHRASES = {
    "the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notice phrases beyond the base.
MORE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "creative commons attribution 4": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    "licensed under the apache license": "apache-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license version 1 0": "bsl",
    "eclipse public license": "epl",
    "this software is provided as is without any express or implied warranty in no event": "zlib",
    "european union public licence": "eupl",
}
# Common SPDX licence ids and exceptions, in lower case.
LICENSES = frozenset("""
0bsd afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0
bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 bzip2-1.0.6
cc0-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0
cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0
efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd icu ijg
imagemagick isc jpnic json lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libpng-2.0 libtiff lppl-1.3c mit mit-0 mit-cmu mpl-1.0
mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa npl-1.1 odbl-1.0 odc-by-1.0 ofl-1.1 openssl osl-2.1 osl-3.0 pddl-1.0
php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0
vim w3c wtfpl x11 xnet zend-2.0 zlib zlib-acknowledgement zpl-2.1
""".split())
EXCEPTIONS = frozenset("""
autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0
font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 libtool-exception linux-syscall-note
llvm-exception ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0 qt-gpl-exception-1.0
swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1
""".split())
TAG = "spdx license identifier"
PERMISSIVE = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "cc-by-4.0", "0bsd",
              "zlib", "bsl-1.0")
EXCEPTION_OPENS = ("classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception")

_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
_TAG_TEXT = re.compile(rb"spdx[-_ ]license[-_ ]identifier\s*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*|\S")
_RANK = {"or": 1, "and": 2, "with": 3}


def _license_id(name: str) -> bool:
    plain = name.removesuffix("+").removesuffix("-only").removesuffix("-or-later")
    return plain in LICENSES or name.startswith(("licenseref-", "documentref-"))


def evaluate(expression: str) -> tuple[bool, list[str], bool]:
    """(valid, licenses, open) of a license expression by shunting-yard."""
    values: list[tuple[frozenset, bool]] = []
    ops: list[str] = []

    def apply() -> bool:
        if len(values) < 2:
            return False
        (rn, ro), (ln, lo) = values.pop(), values.pop()
        op = ops.pop()
        if op == "with":  # an exception names no license; some lift a condition
            values.append((ln, lo or bool(rn & set(EXCEPTION_OPENS))))
        else:
            values.append((ln | rn, (lo and ro) if op == "and" else (lo or ro)))
        return True

    want = True  # an operand comes next
    for tok in _TOKEN.findall(expression.lower()):
        if tok in ("*/", "-->") or tok in "*\"'`,;>" and not want:
            break  # the end of a comment or quotation around the tag
        if tok in _RANK:
            if want:
                return False, [], False
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[tok]:
                if not apply():
                    return False, [], False
            ops.append(tok)
            want = True
        elif tok == "(":
            if not want or ops and ops[-1] == "with":  # an exception is one name
                return False, [], False
            ops.append(tok)
        elif tok == ")":
            if want:
                return False, [], False
            while ops and ops[-1] != "(":
                if not apply():
                    return False, [], False
            if not ops:
                return False, [], False
            ops.pop()
        else:
            if not want:
                break  # prose behind the expression
            if not tok[0].isalnum():
                return False, [], False
            name = tok.rstrip(".:-")
            if not (name in EXCEPTIONS if ops and ops[-1] == "with" else _license_id(name)):
                if not values or not ops or ops[-1] == "(":
                    return False, [], False
                ops.pop()  # prose behind the expression
                want = False
                break
            values.append((frozenset([name]), name in PERMISSIVE))
            want = False
    while ops:
        if ops[-1] == "(" or want or not apply():
            return False, [], False
    if want or len(values) != 1:
        return False, [], False
    names, opened = values[0]
    return True, sorted(names), opened


@cache
def _automaton(base: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    # later ones replace earlier ones: a base phrase is no other phrase too
    for kind, phrases in (("more", PLAIN_PHRASES | MORE_PHRASES), ("base", dict(base)), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    a.make_automaton()
    return a


def scan_text(text: bytes | None, base: dict[str, str] = PLAIN_PHRASES) -> tuple[int, list[dict]]:
    """Word count and findings of one text; ``base``: the base phrases and
    their labels.  Another phrase inside a base one is no finding of its own."""
    raw = text or b""
    words = raw.translate(_WORDS).split()
    line = " " + b" ".join(words).decode("utf-8", "replace") + " "
    found, seen, at, starts, base_end = [], 0, 0, None, -1
    for end, (kind, label, width) in sorted(_automaton(tuple(base.items())).iter(line),
                                            key=lambda x: x[0] - x[1][2]):
        start = end - width + 1
        seen += line.count(" ", at, start)
        at = start
        if kind == "base":
            base_end = max(base_end, end)
        elif kind == "more" and end <= base_end:
            continue
        if kind == "tag":
            if starts is None:  # where each word begins in the text
                solid = np.frombuffer(raw.translate(_WORDS), np.uint8) != 0x20
                starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
                lower = raw.lower()
            m = _TAG_TEXT.match(lower, int(starts[seen]))
            if m:
                expr = m[1].decode("utf-8", "replace").strip()
                valid, names, opened = evaluate(expr)
                found.append({"kind": "expression", "word": seen, "labels": names, "expression": expr,
                              "valid": valid, "open": opened})
        else:
            found.append({"kind": kind, "word": seen, "labels": [label], "expression": None, "valid": True,
                          "open": label in ("mit", "apache-2", "isc", "bsd", "bsd-2-clause", "bsd-3-clause", "cc-by",
                                            "cc0", "unlicense")})
    return len(words), found


FINDING = pa.struct([("kind", pa.string()), ("word", pa.int64()), ("labels", pa.list_(pa.string())),
                     ("expression", pa.string()), ("valid", pa.bool_()), ("open", pa.bool_())])


def scan(docs: DataFrame, base: dict[str, str] = PLAIN_PHRASES) -> DataFrame:
    """(doc_id, n_words, findings) per row; a finding has its kind (base,
    more, expression), first word, labels, expression text, whether it is
    valid, and whether it is open (permissive).  ``base``: the base phrases
    and their labels."""
    def run(batches):
        for b in batches:
            got = [scan_text(t, base) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(FINDING))],
                ["doc_id", "n_words", "findings"])

    src = docs.select("doc_id", F.col("text").cast("binary").alias("t"))
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, n_words long, findings array<struct<"
                               "kind: string, word: long, labels: array<string>, expression: string, "
                               "valid: boolean, open: boolean>>")


def op1(spark, sf_dir):
    f = scan(table(spark, sf_dir, "documents"), BASE_PHRASES)
    base = F.filter("findings", lambda x: x["kind"] == "base")
    words = F.transform("base", lambda x: x["word"])

    def names(c):
        return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda x: x["labels"])))), ",")

    f = f.withColumn("base", base)
    miss = F.aggregate("findings", F.lit(1.0), lambda acc, x: acc * F.when(~x["valid"], 0.8).when(
        x["kind"] == "expression", 0.01).otherwise(0.1))
    return f.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        names("base").alias("base_labels"), names("findings").alias("labels"),
        (1.0 - miss).alias("score"), F.size("findings").cast("long").alias("n_findings"),
        F.when(F.size("findings") > 0, F.forall("findings", lambda x: x["open"])).alias("all_open"))
