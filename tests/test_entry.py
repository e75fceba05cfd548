import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 100


def test_entry_has_one_row_for_each_threshold(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["threshold", "tp", "fp", "fn", "tn", "jaccard", "dice", "precision", "recall"] and df.count() == 9


def test_the_core_does_not_import_the_corpus_operators():
    code = "import sys, voxlake.plans, voxlake.streaming, voxlake.sources.chunks; sys.exit(any(m.startswith('voxlake.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
