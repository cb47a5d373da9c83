"""License scan against a plain search and hand-made expressions."""

import re
import time

import pytest

from rankflow.llm import licenses as L

from .conftest import clash


def slow_base(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = []
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), hits


def check(rows, docs):
    for r in rows:
        n, hits = slow_base(docs[r.doc_id])
        assert r.n_words == n and r.n_base == len(hits)
        at = [i for i, _ in hits]
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.n_findings > 0)


def test_query_matches_plain_search(spark, sf, sf_docs):
    rows = L.op1(spark, sf).collect()
    assert len(rows) == len(sf_docs)
    check(rows, dict(sf_docs))


@pytest.mark.parametrize(("text", "want"), [
    ("MIT", (True, ["mit"], True)),
    ("MIT OR GPL-3.0-only", (True, ["gpl-3.0-only", "mit"], True)),
    ("MIT AND GPL-3.0-only", (True, ["gpl-3.0-only", "mit"], False)),
    # AND binds stronger than OR
    ("MIT OR Apache-2.0 AND GPL-2.0", (True, ["apache-2.0", "gpl-2.0", "mit"], True)),
    ("(MIT OR Apache-2.0) AND GPL-2.0", (True, ["apache-2.0", "gpl-2.0", "mit"], False)),
    ("GPL-2.0 WITH Classpath-exception-2.0", (True, ["gpl-2.0"], True)),
    ("GPL-2.0 with Font-exception-2.0 or MIT", (True, ["gpl-2.0", "mit"], True)),
    ("((MIT))", (True, ["mit"], True)),
    ("MIT */", (True, ["mit"], True)),
    ("MIT and so on OR", (True, ["mit"], True)), ("MIT and others", (True, ["mit"], True)),
    ("see LICENSE file", (False, [], False)), ("(see MIT)", (False, [], False)), ("MIT OR (so on)", (False, [], False)),
    ("GPL-2.0 WITH (A OR B)", (False, [], False)), ("GPL-2.0-or-later WITH nothing", (True, ["gpl-2.0-or-later"], False)),
    ("LicenseRef-Own AND LGPL-2.1+", (True, ["lgpl-2.1+", "licenseref-own"], False)),
    ("", (False, [], False)), ("AND MIT", (False, [], False)), ("(MIT", (False, [], False)),
    ("MIT)", (False, [], False)), ("MIT OR", (False, [], False)), ("()", (False, [], False)),
])
def test_expressions(text, want):
    assert L.evaluate(text) == want


def test_findings_of_one_text():
    text = "xé The MIT\n License!\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nthe mit licenses"
    n, found = L.scan_text(text.encode())
    assert n == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
    base = [f for f in found if f["kind"] == "base"]
    assert [f["word"] for f in base] == [1]
    (expr,) = [f for f in found if f["kind"] == "expression"]
    assert expr["labels"] == ["apache-2.0", "bsd-3-clause", "mit"] and expr["open"]
    assert any(f["labels"] == ["bsd-3-clause"] and f["kind"] == "more" for f in found)


def test_odd_rows(spark, odd, no_docs, tmp_path):
    def rows(df, name):
        clash(df, "t", "findings", "base", "n_words").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return L.op1(spark, f"{tmp_path}/{name}").collect()
    got = rows(odd, "odd")
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    check([r for r in got if r.doc_id is not None], texts)
    assert rows(no_docs, "none") == []


def test_many_tags_take_linear_time():
    def seconds(n):
        text = ("SPDX-License-Identifier: MIT OR GPL-2.0-only\n" + "some words of a source file " * 11 + "\n").encode() * n
        t = time.process_time()
        _, found = L.scan_text(text)
        assert len(found) == n and found[-1]["word"] == (n - 1) * (3 + 6 + 66)
        return time.process_time() - t
    seconds(100)
    assert seconds(4000) < 10 * max(seconds(1000), 0.02)


def test_tags_in_other_dress():
    def names(text):
        return [x["labels"] for x in L.scan_text(text.encode())[1] if x["kind"] == "expression"]
    assert names("spdx_license identifier : MIT") == [["mit"]]
    assert names("é SPDX-License-Identifier:MIT\r\nSPDX License Identifier\n: ISC") == [["mit"], ["isc"]]
    assert names("SPDX-License-Identifier MIT") == [] and names("SPDX -License-Identifier: MIT") == []


def test_notice_texts():
    mit = "Permission is hereby granted, free of charge, to any person\n obtaining a copy of this software and"
    assert [x["labels"] for x in L.scan_text(mit.encode())[1]] == [["mit"]]


def test_base_phrases_of_the_query(spark, tmp_path):
    # "the mit license" alone is no base phrase of the query, but a label of the method
    texts = {1: "The MIT License", 2: "released Under the MIT\n License; the MIT license. CC-BY-NC",
             3: "under the apache license, version 2", 4: "under the mit licenses", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in L.op1(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0, None, None, "", "mit"), 2: (11, 2, 1, 8, "cc-by-nc,mit", "cc-by-nc,mit"),
                   3: (6, 1, 2, 2, "apache-2", "apache-2"), 4: (4, 0, None, None, "", ""),
                   5: (0, 0, None, None, "", "")}
    _, found = L.scan_text(texts[2].encode(), L.BASE_PHRASES)
    assert [(x["kind"], x["word"]) for x in found] == [("base", 1), ("more", 5), ("base", 8)]
