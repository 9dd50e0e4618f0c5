"""What plans must look like at scale: filters and columns reach the scan, no Python, no global sort or window in one task."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from loomframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, SF).explain("formatted")
    return out.getvalue()


def test_filter_reaches_the_scan(spark):
    text = plan(spark, "filter_project")
    assert re.search(r"PushedFilters: \[.*EqualTo\(c_mktsegment,BUILDING\)", text)
    assert "c_nationkey" not in re.search(r"ReadSchema: (.*)", text)[1]


def test_only_needed_columns_are_read(spark):
    schema = re.search(r"ReadSchema: (.*)", plan(spark, "calc_arith"))[1]
    assert set(re.findall(r"(l_\w+):", schema)) == {"l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"}


@pytest.mark.parametrize("name", ["flagship", "calc_multi", "lookup_many_to_one", "agg_sum", "diff_summary", "impute_ffill", "label_numbers", "round_banker"])
def test_no_python_in_plans(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


def test_aggregates_are_partial_first(spark):
    assert "partial_sum" in plan(spark, "agg_sum")


@pytest.mark.parametrize("name", ["impute_ffill", "impute_bfill", "impute_interpolate", "lineage_excluded"])
def test_windows_over_rows_are_dealt_and_run_one_way(spark, monkeypatch, name):
    from loomframe.operators import impute

    monkeypatch.setattr(impute, "RANGE_ROWS", 40)
    text = plan(spark, name)
    windows = re.findall(r"\(\d+\) Window.*?Arguments: (.*?)\n\n", text, re.DOTALL)
    assert any("__zone" in w for w in windows)
    assert "unboundedfollowing" not in text.lower()


def test_entry_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "loomframe", tmp_path / "loomframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)})
    queries, sql, pipeline = done.stdout.split()
    assert int(queries) > 100 and queries == sql and pipeline == "False"
