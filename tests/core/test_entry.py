import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TELL = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_without_the_training_data_folders(tmp_path, pipeline):
    """A copy of the tree without both llm folders, with the pipeline's module and without it."""
    shutil.copytree(f"{ROOT}/statuta", tmp_path / "statuta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "statuta" / "llm" / "__pycache__").mkdir(parents=True)  # what deleting sources may leave
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run([sys.executable, "-c", TELL], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert made.returncode == 0, made.stderr
    queries, oracles = json.loads(made.stdout)
    assert len(queries) >= 50 and len(oracles) >= 41
    assert set(oracles) <= set(queries)
    assert not [q for q in queries if q == "pipeline" or q.startswith("op")]
