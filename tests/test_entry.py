import importlib
import subprocess
import sys

import __spark_entry__


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_training_data_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'tremorlake.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.llm is None and not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()] and len(e.queries()) > 70\n"
    )
    folder = importlib.util.find_spec("__spark_entry__").origin.rsplit("/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=folder).returncode == 0
