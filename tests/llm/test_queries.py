"""Registration, SQL, and the library without the subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb

import __spark_entry__ as ent

ROOT = Path(__file__).resolve().parents[2]


def test_one_query_per_operator():
    names = [n for n in ent.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in ent.queries()


def test_chat_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    cur = con.execute(ent.oracle_sql()["op3_chat_format"])
    cols = sorted(d[0] for d in cur.description)
    want = sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({ent.oracle_sql()['op3_chat_format']})").fetchall()))
    df = ent.queries()["op3_chat_format"](spark, sf)
    assert sorted(df.columns) == cols
    assert sorted(str(tuple(r)) for r in df.select(cols).collect()) == want


def test_library_does_not_need_the_subpackage(tmp_path):
    for p in ROOT.rglob("*.py"):
        part = p.relative_to(ROOT).parts
        if "llm" in part or part[0] == "corpus_pipeline.py":
            continue
        to = tmp_path.joinpath(*part)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(p.read_text())
        if part[0] in ("rankflow", "bench.py", "tools"):
            assert not re.search(r"rankflow[.]llm|import llm|[.]llm\b", p.read_text()), p
    code = ("import __spark_entry__ as e; q = e.queries(); "
            "assert 'pipeline' not in q and not any(n.startswith('op4') for n in q) and 'rank_step' in q")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
