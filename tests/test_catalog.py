import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import __spark_entry__ as E  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_names():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) > 90 and all(callable(f) for f in q.values())


def test_core_stands_without_the_subpackage():
    root = Path(__file__).parents[1] / "tessera"
    own = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert own and not any("tessera.llm" in p.read_text() for p in own)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["word_count", "p2_found", "p4_found", "p5_found", "p7_found", "trip_stats_region"])
def test_queries_have_rows(spark, name):
    df = E.queries()[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_entry(spark):
    assert E.entry(spark).count() > 0
