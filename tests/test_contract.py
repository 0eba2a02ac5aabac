import importlib
import os
import re
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_imports_without_the_llm_package():
    code = "import sys; sys.modules['ledgerloom.llm.queries'] = None; sys.modules['ledgerloom.llm.oracle'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('p1_') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1] == "False"


def test_nothing_in_the_core_names_the_llm_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "ledgerloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"ledgerloom\.llm|from \.+llm", open(os.path.join(folder, f), encoding="utf-8").read()), f


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["pick_latest", "chunk_ids", "section_path", "bm25_topk", "query_intent", "star_rollup", "no_section_ratio", "session_windows"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    order = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    relation = con.sql(entry.oracle_sql()[name])
    at = [relation.columns.index(c) for c in order]
    assert sorted(repr([plain(r[c]) for c in order]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in relation.fetchall())
