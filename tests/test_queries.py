"""Every query of the engine against its SQL, on the least tables."""

import pytest

from corpusmith.plans import queries as P

from .compare import assert_same, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(P.SQL))
def test_sql(spark, name):
    assert_same(P.QUERIES[name](spark, SF), SF, P.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert rows_of(e.entry(spark))[1]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(P.QUERIES) <= set(e.queries())


def test_without_optional_subpackage():
    """The rest imports and lists its queries when the optional parts are gone."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpusmith.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert not [n for n in e.queries() if n.startswith('op') and n[2].isdigit()]\nassert 'disj_topk' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)


@pytest.mark.parametrize("name", ["identity_order", "doc_table", "varbyte_bytes", "sample_docs", "doc_table_dump"])
def test_doc_table_needs_no_index(spark, monkeypatch, name):
    """What reads the doc table only doesn't build lists."""
    def built(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(P, "_index", built)
    assert P.QUERIES[name](spark, SF).count()
