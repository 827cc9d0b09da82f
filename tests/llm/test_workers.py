"""Workers need not have the package: the queries run in a session whose
driver alone can import it."""

import os
import subprocess
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from gradewell.session import build_session

spark = build_session("local[2]", shuffle_partitions=2, extra={{"spark.ui.showConsoleProgress": "false"}})
spark.sparkContext.setCheckpointDir({folder!r})


def importable(_):
    import importlib.util

    return importlib.util.find_spec("gradewell") is not None


assert not any(spark.sparkContext.parallelize(range(4), 2).map(importable).collect())
from gradewell.llm.queries import QUERIES

for name in {names!r}:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
"""


@pytest.mark.parametrize(
    "names",
    [
        ["op1_decontaminate", "op3_bpe", "op4_line_dedup", "op5_token_store", "op6_language_id", "op7_simhash", "op8_token_counts"],
        ["op9_quality", "op10_toxicity", "op11_language_model", "op12_manifest", "op13_periodic_runs"],
    ],
)
def test_queries_where_workers_lack_the_package(names):
    folder = tempfile.mkdtemp()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != REPO]
    env["PYTHONPATH"] = os.pathsep.join(paths)
    script = SCRIPT.format(repo=REPO, folder=f"{folder}/shared", names=names)
    done = subprocess.run([sys.executable, "-c", script], cwd=folder, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
