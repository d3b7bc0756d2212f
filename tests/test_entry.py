"""The driver contract holds with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout


def test_imports_without_a_session():
    assert int(run("import __spark_entry__ as e; print(len(e.queries()))")) > 100


def test_corpus_part_is_optional():
    code = "import sys; sys.modules['barspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    count, corpus = run(code).split()
    assert int(count) > 100 and corpus == "False"


def test_sql_belongs_to_queries():
    run("import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())")


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
