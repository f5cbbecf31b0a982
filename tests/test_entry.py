"""The driver contract."""

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["sample", "chr", "episcore", "zscore", "ezscore"] and df.count() == 220


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 140


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent / "cohortlens"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "cohortlens.llm" not in path.read_text(), path
