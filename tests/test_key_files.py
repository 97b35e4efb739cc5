"""One file per key: the same files as Spark's partitioned text writer gives, without its processes."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import flows


def tree(root):
    found = {}
    for path in glob.glob(f"{root}/**/*.txt", recursive=True):
        with open(path, "rb") as f:
            found.setdefault(os.path.basename(os.path.dirname(path)), []).append(sorted(f.read().split(b"\n")))
    return found


@pytest.mark.parametrize("empty", [False, True])
def test_files_are_those_of_the_partitioned_writer(spark, tmp_path, empty):
    rows = spark.createDataFrame([(1, b"a\nb"), (None, b"n"), (2, b"A=\xff"), (1, b"c"), (-3, None), (4, b"")], "key long, raw binary")
    rows = (rows.limit(0) if empty else rows).select("key", F.col("raw").cast("string").alias("value")).repartition(3, "key")
    rows.write.partitionBy("key").text(f"{tmp_path}/spark")
    flows.one_file_per_key(rows, f"file://{tmp_path}/own")
    assert tree(f"{tmp_path}/own") == tree(f"{tmp_path}/spark") and len(tree(f"{tmp_path}/own")) == (0 if empty else 5)
    # One file a key and no checksum files: those cost the writer a process each.
    assert not glob.glob(f"{tmp_path}/own/**/.*", recursive=True)
    read = [sorted(spark.read.text(f"{tmp_path}/{x}/*").select(F.col("value").cast("binary")).collect()) for x in ("own", "spark")]
    assert read[0] == read[1]
