"""Functions on executors need no copy of this package: the operators run from a folder that has none."""

import os
import subprocess
import sys


REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # of the driver alone
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
from tidewater.llm import decontaminate, language, lm, toxicity
from pyspark.sql import functions as F
docs = spark.createDataFrame([(k, "some words of a text number %d that is learned from" % k, "ab"[k % 2]) for k in range(30)], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
bench = spark.createDataFrame([(1, "some words of a text")], "item_id long, text string")
model = language.fit(docs)
tox = toxicity.fit(docs, labels)
done = [language.identify(docs, model), language.known_language(docs, model), decontaminate.contamination(docs, bench), decontaminate.spans_removed(docs, bench), toxicity.score(docs, tox), toxicity.offending_sentences(docs, tox), lm.score(docs, F.lit(True))]
print("ROWS", [d.count() for d in done])
"""


def test_operators_run_where_the_package_is_not(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS [30," in got.stdout, got.stderr[-2000:]
