import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_corpus_operators(tmp_path):
    """The library stands without gridledger/llm and corpus_pipeline.py."""
    for p in ("gridledger", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", REPO / p, tmp_path / p], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "gridledger/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fact_retrieval' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["fact_id", "path", "value", "evidence"]
