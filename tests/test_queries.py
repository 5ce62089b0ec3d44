"""Every registered query against its SQL at the smallest scale, and plan checks."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module
from compare import connect, differences

NAMES = sorted(entry_module.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, name):
    got = entry_module.queries()[name](spark, folder).toPandas()
    sql = entry_module.oracle_sql().get(name)
    assert len(got) > 0
    if sql:
        assert differences(got, connect(folder).execute(sql).df()) is None


def test_oracle_names_are_queries():
    assert set(entry_module.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", ["de_table", "ssgsea", "gsva", "vaf_compare", "kruskal_by", "sample_gram", "zscore", "matrix_build"])
def test_plan_has_no_cross_join(spark, folder, name):
    plan = entry_module.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned_and_filtered(spark, folder):
    plan = entry_module.queries()["meta_select"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "o_totalprice" not in plan


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["contrast", "feature", "logfc", "t", "p_value", "adj_p"]


@pytest.mark.parametrize("missing", ["zstandard", "cohortile.llm", "corpus_pipeline"])
def test_entry_without_what_the_subpackage_needs(missing):
    code = f"""import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
from cohortile.plans.catalog import QUERIES
assert set(QUERIES) <= set(e.queries()) and "pipeline" not in e.queries() and e.oracle_sql()"""
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
