import os
import subprocess
import sys

import __spark_entry__ as entry
from almanac.plans import QUERIES

from .conftest import SF_SMALL


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["year", "rank", "id", "title", "w_range", "item_class", "tags"]
    assert len(rows) > 0


def test_every_oracle_has_a_query():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    # Every query of the core has oracle SQL, but for two that tests/test_cases.py holds against plain Python.
    assert set(QUERIES) - set(sql) == {"q_tags_extract_cases", "q_tags_dictionary_cases"}
    assert len(QUERIES) >= 50


def test_queries_build_on_small_data(spark):
    qs = entry.queries()
    for name in ("q_week_list", "q_tag_top", "q_cosine_topk", "q_bm25", "q_table_values"):
        assert qs[name](spark, SF_SMALL).count() > 0


def test_queries_stay_when_the_optional_subpackage_cannot_be_imported():
    """A package that only the optional subpackage needs is missing: the library's queries are all there."""
    code = ("import sys\n"
            "for name in ('ahocorasick', 'zstandard', 'almanac.llm'): sys.modules[name] = None\n"
            "import __spark_entry__ as e\n"
            "assert set(e.QUERIES) == set(e.queries()) and len(e.queries()) >= 83")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
