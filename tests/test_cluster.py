"""Queries whose executors are processes of their own, as on a cluster."""

import os
import subprocess
import sys

import duckdb

from tessella.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tessella.plans import registry
from tessella.sources.tables import ForeignServer

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
print("ROWS", sorted(map(tuple, registry.queries()["foreign_table"](spark, "/root/testdata/sf0.001").collect())))
server = ForeignServer(spark, "jdbc:derby:memory:other;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
df = spark.range(1200).selectExpr("id", "CAST(nullif(id % 3, 0) AS double) AS x", "CAST(concat('t', id) AS varchar(9)) AS s")
server.insert(df, "t")
server.insert(df, "t")
print("SAME", df.union(df).exceptAll(server.table("t")).count(), server.table("t").exceptAll(df.union(df)).count(), server.table("t", where='"id" < 10').count())
spark.stop()
"""


def test_foreign_table_on_a_cluster(tmp_path):
    """An in-memory database is the driver's; executors must not look for it in their own processes."""
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13", "SPARK_WORKER_DIR": str(tmp_path / "work"), "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    out = subprocess.run([sys.executable, "-c", RUN, ROOT], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=env)
    said = dict(line.split(" ", 1) for line in out.stdout.splitlines() if line.startswith(("ROWS", "SAME")))
    assert said["SAME"] == "0 0 20", out.stderr[-2000:]
    assert said["ROWS"].count("(") == 14 and "(1000, '5')" in said["ROWS"]


LATERAL = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tessella.plans import registry

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
spark.range(50).toDF("c_custkey").write.parquet(sys.argv[2] + "/customer.parquet")
spark.range(0, 20000, 1, 8).selectExpr("id AS o_orderkey", "CASE WHEN id % 61 < 55 THEN id % 61 END AS o_custkey", "CASE WHEN id % 97 > 0 THEN CAST(pmod(xxhash64(id), 500) AS double) END AS o_totalprice").write.parquet(sys.argv[2] + "/orders.parquet")
for c, o in registry.queries()["join_lateral"](spark, sys.argv[2]).collect():
    print("ROW", c, o)
spark.stop()
"""


def test_join_lateral_on_a_cluster(tmp_path):
    """The first two by the order asked for, wherever the rows of a key come from."""
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13", "SPARK_WORKER_DIR": str(tmp_path / "work"), "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    out = subprocess.run([sys.executable, "-c", LATERAL, ROOT, str(tmp_path)], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=env)
    got = sorted(tuple(map(int, line.split()[1:])) for line in out.stdout.splitlines() if line.startswith("ROW"))
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(c.execute(registry.oracle_sql()["join_lateral"]).fetchall()), out.stderr[-2000:]
