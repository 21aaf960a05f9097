import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from flowweft.llm.queries import QUERIES

ROOT = Path(__file__).resolve().parents[2]


def test_fourteen_queries_are_registered():
    names = [n for n in entry.queries() if n == "pipeline" or n[:2] == "op" and n[2].isdigit()]
    assert len(names) == 14 and {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} == set(names) and "op2_source_mix" in entry.oracle_sql()


def test_entry_works_without_this_package():
    """As if the folder and the pipeline were gone: the other queries stay, and other import errors are not hidden."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == GONE: raise ModuleNotFoundError('gone', name=NAMED)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print('pipeline' in e.queries(), 'trace' in e.queries(), len(e.oracle_sql()) > 100)\n"
    )
    def run(gone, named):
        text = code.replace("GONE", repr(gone)).replace("NAMED", repr(named))
        return subprocess.run([sys.executable, "-c", text], cwd=ROOT, capture_output=True, text=True)

    for gone in ("flowweft.llm", "corpus_pipeline"):
        assert run(gone, gone).stdout.split() == ["False", "True", "True"]
    assert run("public_tokenizers", "public_tokenizers").returncode != 0
