"""The package run as a script from another folder, with workers that have no copy of it."""

import os
import subprocess
import sys
import zipfile

import orderlake
from orderlake.shipping import package_zip

MAIN = os.path.join(os.path.dirname(orderlake.__file__), "__main__.py")


def test_zip_holds_the_package(tmp_path):
    names = zipfile.ZipFile(package_zip(str(tmp_path))).namelist()
    assert {"orderlake/__init__.py", "orderlake/sources/split_csv.py"} <= set(names)
    assert all(n.endswith(".py") for n in names)


def test_jobs_run_as_a_script_from_another_folder(tmp_path):
    # Cells with line breaks are put together by Python workers.
    (tmp_path / "in.csv").write_text('Order_Number,Customer_Name\n12,"Ann\nB"\n13,Bob\n')
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONSAFEPATH")}
    env |= {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    run = lambda *job: subprocess.run(
        [sys.executable, MAIN, *job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    built = run("build", "in.csv", str(tmp_path / "store"))
    assert "records: 2" in built.stdout, built.stderr[-2000:]
    found = run("search", str(tmp_path / "store"), "ann", "--out", str(tmp_path / "found"))
    assert found.returncode == 0 and any(n.endswith(".parquet") for n in os.listdir(tmp_path / "found"))
