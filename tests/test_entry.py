import os

import pytest

import __spark_entry__ as entry
from swathe import queries

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_nothing_else_imports_the_optional_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "swathe")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(folder, f)).read()
                    assert "swathe.llm" not in text and "corpus_pipeline" not in text, f


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["vector_name", "raster_count"] and df.count() > 0
