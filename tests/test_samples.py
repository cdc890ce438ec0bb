from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from factloom.operators import builder
from factloom.sources import parquet

DATA = "/root/testdata/sf0.001"


def test_joins_of_whole_tables(spark):
    read = lambda name, *columns: [tuple(r.values()) for r in pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns)).to_pylist()]
    customers, suppliers = read("customer", "c_custkey", "c_nationkey"), read("supplier", "s_suppkey", "s_nationkey")
    nations = {n for (n,) in read("nation", "n_nationkey")}
    queries = __spark_entry__.queries()
    got = Counter((r.s, r.c) for r in queries["join_trailing_field"](spark, DATA).collect())
    assert got == Counter((s, c) for s, m in suppliers for c, n in customers if m == n) and max(c for _, c in got) >= 20
    got = Counter((r.n, r.k) for r in queries["disj_joined"](spark, DATA).collect())
    assert got == Counter((n, k) for k, n in customers + suppliers if n in nations) and max(k for _, k in got) >= 40


def test_many_to_many_is_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    """One nation has nearly all pairs: they are made by many tasks, each pair once, copies as often as they stand there."""
    suppliers = [(k, 3) for k in range(120)] + [(7, 3), (7, 3), (200, 5), (201, 8), (202, None)]
    customers = [(k, 3) for k in range(150)] + [(9, 3), (300, 5), (301, 5), (302, 9), (303, None)]
    for name, x, rows in (("supplier", "s", suppliers), ("customer", "c", customers)):
        table = {f"{x}_{'supp' if x == 's' else 'cust'}key": pa.array([k for k, _ in rows], pa.int64()), f"{x}_nationkey": pa.array([n for _, n in rows], pa.int32())}
        table |= {f"{x}_name": ["x"] * len(rows), f"{x}_acctbal": [0.5] * len(rows)} | ({"c_mktsegment": ["x"] * len(rows)} if x == "c" else {})
        pq.write_table(pa.table(table), tmp_path / f"{name}.parquet")
    monkeypatch.setattr(builder, "SMALL", 0, raising=False)
    monkeypatch.setattr(builder, "CELL", 8, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = __spark_entry__.queries()["join_trailing_field"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter((r.s, r.c) for r in got) == Counter((s, c) for s, m in suppliers for c, n in customers if m == n is not None)
    assert max(Counter(r.task for r in got).values()) < len(got) / 4


@pytest.mark.parametrize("text", [
    "{s = S, c = C} where tpch.Supplier {suppkey = S, nation = N}; tpch.Customer {custkey = C, nation = N}",
    "{s = S, c = C, r = N.region.name} where tpch.Supplier {suppkey = S, nation = N}; K = tpch.Customer {custkey = C, nation = N}; !tpch.Order {customer = K, status = \"F\"}",
    "{s = S, k = K} where tpch.Supplier {suppkey = S, nation = N}; tpch.Customer {custkey = K, nation = N} | tpch.Supplier {suppkey = K, nation = N}",
    "{a = A, b = B} where tpch.Part {partkey = A, brand = X, size = S}; tpch.Part {partkey = B, brand = X, size = S}",
    "{a = A, b = B} where C = tpch.Customer {segment = A}; tpch.Order {customer = C, priority = P}; tpch.Order {orderkey = B, priority = P}; B < 20",
    "{i = I, j = J} where feed.Typed {what = X, id = I}; feed.Typed {what = X, id = J}; I < J",
    "{l = L, p = P} where tpch.LineItem {line = L, part = X}; tpch.Part {size = L, partkey = P}; P < 20; X = tpch.Part {size = 7}",
])
def test_dealt_joins_have_the_same_rows(spark, monkeypatch, text):
    session, dealt = parquet.session(spark, DATA), []
    rows = lambda df: Counter(tuple(r) for r in df.groupBy(df.columns).count().collect())
    plain = rows(session.query(text))
    monkeypatch.setattr(builder, "SMALL", 0)
    monkeypatch.setattr(builder, "CELL", 4)
    spread = builder.Builder.spread
    monkeypatch.setattr(builder.Builder, "spread", lambda *x: dealt.append(1) or spread(*x))
    assert rows(session.query(text)) == plain and plain and dealt


@pytest.mark.parametrize("name", ["join_shared_var", "fetch_two_refs", "join_leading_ref", "disj_joined", "disj_of_outer_values", "alias_as_key"])
def test_joins_on_what_one_side_has_once_are_not_dealt(spark, monkeypatch, name):
    monkeypatch.setattr(builder, "SMALL", 0)
    monkeypatch.setattr(builder.Builder, "spread", lambda *x: pytest.fail("dealt"))
    __spark_entry__.queries()[name](spark, DATA)
