import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    code = "import tracelith.plans.trace_queries, sys; assert not any('tracelith.llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
