"""The driver's entry, with and without what the training-data queries need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(*blocked: str) -> list[str]:
    code = f"import sys; sys.modules.update(dict.fromkeys({blocked!r})); import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_queries_without_a_library():
    engine = [x for x in names() if not x.startswith("op") and x != "pipeline"]
    assert "agg_group" in engine and names("sentencepiece") == engine and names("lodestone.llm", "corpus_pipeline") == engine


def test_queries_without_the_pipeline():
    assert set(names()) - set(names("corpus_pipeline")) <= {"pipeline"}
