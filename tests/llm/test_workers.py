"""Workers need no copy of the package: functions travel with their code."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # the driver's path only
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from graphloom.llm import queries
docs = spark.createDataFrame([(i, "some words to read in text %d\\nand a line" % i, "en", "s", 40) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
docs.write.parquet({out!r} + "/documents.parquet")
spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet({out!r} + "/labels.parquet")
spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet({out!r} + "/benchmark.parquet")
spark.createDataFrame([(1, "http://a/b", "<p>x</p>")], "page_id long, url string, html string").write.parquet({out!r} + "/pages.parquet")
for name, query in queries.queries().items():
    print(name, query(spark, {out!r}).count())
"""


def test_workers_without_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, out=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    counts = dict(line.split() for line in run.stdout.split("\n") if line.startswith("op"))
    assert len(counts) == 10 and all(counts[k] == "20" for k in counts if k.split("_")[0] in ("op2", "op3", "op4", "op5", "op7", "op9", "op10"))
