import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(*blocked):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {blocked!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries())
print(*e.queries())
"""
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_entry_stands_alone():
    alone = names("plumeline.llm", "corpus_pipeline")
    assert "highlights" in alone and not any(n.startswith("op") or n == "pipeline" for n in alone)
    assert set(alone) <= set(names())


def test_flagship(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and {"doc_id", "idx", "word_level", "surface"} <= set(df.columns)
