import os
import subprocess
import sys
import uuid

import pytest

from lodestone.errors import NotSupported
from lodestone.session import shared_dir
from lodestone.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CLUSTER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
     .config("spark.checkpoint.dir", "file://" + sys.argv[2] + "/shared").config("spark.sql.warehouse.dir", sys.argv[2] + "/warehouse").getOrCreate())
from lodestone.plans.catalogue import ORACLES, QUERIES
from tests.oracle import same
same(QUERIES["q70_jdbc"](s, sys.argv[3]), ORACLES["q70_jdbc"], sys.argv[3])
print("same")
"""


def test_a_database_is_read_by_executors_of_their_own(tmp_path, sf_dir):
    got = subprocess.run([sys.executable, "-c", CLUSTER, ROOT, str(tmp_path), sf_dir], capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert got.stdout.endswith("same\n"), got.stderr[-2000:]


def test_values_come_back_from_a_database(spark):
    rows = [(1, "a,b", 1.5), (2, 'say "so"', None), (3, "", 0.0), (4, None, -1e300), (5, "two\nlines", 1e-7), (6, "  käse 茶 ", 3.0), (7, "\\", 1.0), (None, '"', 2.0)]
    given = spark.createDataFrame(rows, "id long, name string, amount double")
    url = tables.load_derby(given, f"{shared_dir(spark)}/derby-{uuid.uuid4().hex}", "things")
    assert sorted(map(tuple, tables.read_jdbc(spark, url, "things", "id", 3).collect()), key=str) == sorted(rows, key=str)
    url = tables.load_derby(given.where("id > 10"), f"{shared_dir(spark)}/derby-{uuid.uuid4().hex}", "things")
    assert tables.read_jdbc(spark, url, "things", "id").count() == 0


def test_what_a_database_would_not_give_back_is_refused(spark):
    with pytest.raises(NotSupported):
        tables.load_derby(spark.sql("SELECT current_date() AS day"), f"{shared_dir(spark)}/derby-{uuid.uuid4().hex}", "days")
    with pytest.raises(NotSupported):
        tables.load_derby(spark.range(1), "hdfs://host/derby", "ids")
