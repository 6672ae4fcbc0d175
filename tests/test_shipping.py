"""The package reaches executors that have it on no path of their own."""
import os
import subprocess
import sys
import textwrap

from conftest import ROOT


def test_functions_run_on_workers_without_the_package(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent("""
        import sys
        sys.path.insert(0, sys.argv[1])
        from flowlens.session import build_session
        from flowlens.operators import flows
        spark = build_session("local-cluster[1,1,1024]", shuffle_partitions=2)

        def where(batches):
            import flowlens
            import pyarrow as pa
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([flowlens.__file__] * b.num_rows)], ["f"])

        print("FOUND", spark.range(1).mapInArrow(where, "f string").first().f)
        spark.stop()
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["SPARK_LOCAL_IP"] = "127.0.0.1"
    env["FLOWLENS_DRIVER_MEM"] = "1g"
    said = subprocess.run([sys.executable, str(script), ROOT], cwd=tmp_path, env=env | {
        "PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir=file://{tmp_path}/ck --conf spark.executor.memory=512m "
                               "pyspark-shell"}, capture_output=True, text=True, timeout=200)
    found = [x for x in said.stdout.splitlines() if x.startswith("FOUND")]
    assert found and ".zip" in found[0], said.stderr[-2000:]
