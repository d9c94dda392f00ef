"""Every query with SQL gives DuckDB's rows on sf0.001; the entry points hold without the optional parts."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from sieveline.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(df):
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, expect = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expect.columns)
    assert canonical(got) == canonical(expect)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["stratum", "source", "n"] and df.count() > 0


def test_entry_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_a_broken_part_is_not_hidden(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "tests", "llm", "corpus_pipeline.py", "__pycache__"))
    (tmp_path / "r/sieveline/llm").mkdir()
    (tmp_path / "r/sieveline/llm/__init__.py").write_text("")
    (tmp_path / "r/sieveline/llm/registry.py").write_text("import no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode and "no_such_module_at_all" in done.stderr


def test_reports_need_no_second_pass(spark):
    """Column pruning and pushed filters reach the scan."""
    plan = QUERIES["u3_difference"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    plan = QUERIES["a6_distinct_sources"](spark, SF)._jdf.queryExecution().toString()
    assert "text" not in plan.split("== Physical Plan ==")[1]


def test_boosted_queries_grow_200_trees(spark, monkeypatch):
    from sieveline.operators import quality

    seen = []

    def spy(**parameters):
        seen.append(parameters["maxIter"])
        raise StopIteration

    monkeypatch.setattr(quality, "GBTClassifier", spy)
    for name in ("x5_x8_gbt_extrapolation", "x6_cross_validated_f1", "x7_feature_importances"):
        with pytest.raises(StopIteration):
            QUERIES[name](spark, SF)
    assert seen == [200] * 3


def test_features_are_made_of_the_documents_in_use(spark):
    """Labels are joined below the features, so training leaves unlabelled documents out before."""
    from sieveline.plans.registry import _labelled

    df, _ = _labelled(spark, SF)
    plan = df.where("quality is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan[: plan.index("Join Inner")] and "regexp_extract_all" not in plan[plan.index("Join Inner") :]
