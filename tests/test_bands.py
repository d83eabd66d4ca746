"""Self-joins by bands on odd rows, against their SQL; how their work is dealt out."""

import re

from granary.plans import joins
from tests.oracle import rows_of, rows_of_sql


def parts(spark, folder, rows):
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def sql(folder, name, table):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return rows_of_sql(con, joins.ORACLES[name])


def same_keys(df):
    """The keys of each join of a plan."""
    return re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def test_join_band_odd_rows(spark, tmp_path):
    hot = [(i, "n", "A", "t", 7 + (i % 150 == 0), 1.0) for i in range(600)]  # blocks of one cell meet each other
    odd = [(k, "n", b, "t", z, 1.0) for k, b, z in ((5, "B", 1), (5, "B", 1), (5, "B", 2), (6, "B", 2), (-9, "B", 0), (7, "B", -1), (8, "B", 4), (None, "B", 1), (9, None, 1), (10, None, 1), (11, "B", None), (12, "C", 1))]
    folder = parts(spark, tmp_path, hot + odd)
    got = rows_of(joins.QUERIES["join_band"](spark, folder))
    assert len(got[1]) > 170_000 and got == sql(folder, "join_band", "part")


def test_join_band_work(spark, tmp_path):
    folder = parts(spark, tmp_path, [(i, "n", "A", "t", 7, 1.0) for i in range(9000)])
    df = joins.QUERIES["join_band"](spark, folder)
    assert all("_band" in keys for keys in same_keys(df)) and same_keys(df)  # not all parts of a brand
    assert df.rdd.getNumPartitions() >= 20  # 40 million pairs of one size


def customers(spark, folder, rows):
    spark.createDataFrame([(k, "n", n, float(v) if v is not None else None, s) for k, n, v, s in rows], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_join_self_odd_rows(spark, tmp_path):
    values = [0.0, -0.0, -5e-324, 5e-324, 49.99, 50.0, -50.0, -49.995, 63.999, 64.0, 113.98, 114.0, 99.99999999999999, 100.0, 149.99999999999997, 150.0, 1e17, 1e17 + 32, -1e17, 6e17, 1e25, 1e25, -1e25, 1e300, 1e300, -1e300, float("nan"), float("nan"), float("inf"), float("inf"), float("-inf"), None, None]
    odd = [(k, n, v, "A") for n in (1, 2) for k, v in enumerate(values if n == 1 else values[::-1])]
    keys = [(5, 3, 1, "A"), (5, 3, 2, "A"), (None, 3, 1, "A"), (6, 3, 3, "A"), (7, None, 1, "A"), (8, None, 1, "A"), (9, 3, 1, None), (10, 3, 1, None), (11, 3, 1, "B")]
    hot = [(i * 7919 % 601, 4, i % 97 * 1.37, "A") for i in range(500)]  # blocks of near cells meet each other, in any order of keys
    folder = customers(spark, tmp_path, odd + keys + hot)
    got = rows_of(joins.QUERIES["join_self"](spark, folder))
    assert len(got[1]) > 50_000 and got == sql(folder, "join_self", "customer")


def test_join_self_work(spark, tmp_path):
    folder = customers(spark, tmp_path, [(i, 1, 7, "A") for i in range(9000)])
    df = joins.QUERIES["join_self"](spark, folder)
    assert all("_band" in keys for keys in same_keys(df)) and same_keys(df)  # not all customers of a nation and segment
    assert df.rdd.getNumPartitions() >= 20  # 40 million pairs of one balance
