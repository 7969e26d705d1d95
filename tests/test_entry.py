"""The entry module with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(code: str) -> str:
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_queries_have_sql_of_their_names():
    out = run("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), len(s))")
    queries, sql = map(int, out.split())
    assert queries > 90 and sql > 80


def test_the_rest_works_without_the_subpackage():
    block = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('quarry.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
q = e.queries()
assert 'score_dimensions' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']
assert set(e.oracle_sql()) <= set(q)
"""
    run(block)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quarry.llm" not in p.read_text(), p
