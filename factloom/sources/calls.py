"""Samples beyond a query's rows: counts, pages, profiles, expansion, and what a database does with facts of whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources import parquet
from factloom.sources.files import read_facts
from factloom.sources.store import Catalog, Database, StoreError
from factloom.streaming.ingest import ingest

SCHEMA = """
schema geo {
  predicate Region : { regionkey : int, name : string }
  predicate Nation : { nationkey : int, name : string, region : Region } -> int
  predicate About : { what : { region : Region = 1 | nation : Nation = 2 }, note : string }
}
"""


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and the executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="factloom-")
    return f"{base.removeprefix('file://').rstrip('/')}/databases/{uuid.uuid4().hex}"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole facts: each nation with its region in it."""
    nation, region = (parquet.read(spark, f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    inner = F.struct(F.struct(F.col("r_regionkey").cast("long").alias("regionkey"), F.col("r_name").alias("name")).alias("key"))
    key = F.struct(F.col("n_nationkey").cast("long").alias("nationkey"), F.col("n_name").alias("name"), inner.alias("region"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(key.alias("key"), F.length("n_name").cast("long").alias("value"))


def _about(facts: DataFrame, even: bool) -> DataFrame:
    """A fact about each nation, or its region, in a union; nested facts and all."""
    nation = F.struct("key", "value")
    what = F.struct(F.when(F.lit(even), 1).otherwise(2).alias("disc"), F.when(F.lit(even), F.col("key.region")).alias("region"), F.when(F.lit(not even), nation).alias("nation"))
    return facts.select(F.struct(what.alias("what"), F.concat(F.lit("of "), F.col("key.name")).alias("note")).alias("key"))


def _written(spark: SparkSession, sf_dir: str) -> tuple[Catalog, Database]:
    catalog = Catalog(spark, _folder(spark))
    db = catalog.create("geo", SCHEMA)
    db.write({"geo.Nation": _nations(spark, sf_dir)})
    return catalog, db


def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(parquet.session(spark, sf_dir).count("{a = A} where tpch.Customer {custkey = A}; tpch.Order {customer = C}; C = tpch.Customer {custkey = A}"),)], "n long")


_PAGED = "{k = K, n = N} where tpch.Customer {custkey = K, name = N}"


def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r["k"], r["n"]) for r in parquet.session(spark, sf_dir).page(_PAGED, 25).rows], "k long, n string")


def page_after_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = parquet.session(spark, sf_dir)
    return spark.createDataFrame([(r["k"], r["n"]) for r in session.page(_PAGED, 25, session.page(_PAGED, 25).token).rows], "k long, n string")


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r["k"], r["n"]) for r in parquet.session(spark, sf_dir).objects(_PAGED, 7)], "k long, n string")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = parquet.session(spark, sf_dir).profile('{k = K} where X = tpch.Nation {nationkey = K}; tpch.Supplier {nation = X}')
    return spark.createDataFrame([(k, s["rows"]) for k, s in enumerate(steps)], "step long, rows long")


def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = parquet.session(spark, sf_dir).expand("{s = S, n = N} where tpch.Supplier {suppkey = S, nation = N}", 2)
    return got.select("s", F.col("n.name").alias("nation"), F.col("n.region.name").alias("region"))


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, db = _written(spark, sf_dir)
    db.finish()
    return db.session().query("{nation = N.name, length = N.value, region = N.region.name} where N = geo.Nation _")


def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second write of the same facts, and more about them, creates and finds."""
    _, db = _written(spark, sf_dir)
    facts = _nations(spark, sf_dir)
    first, more = db.write({"geo.Nation": facts}), db.write({"geo.About": _about(facts, False)})
    return spark.createDataFrame([("again", first.created, first.deduped), ("more", more.created, more.deduped)], "write string, created long, deduped long")


def store_hash_of_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether writers' order, and so ids, even within unions, leaves the content's hash."""
    hashes = []
    for order in ((False, True), (True, False)):
        db = Catalog(spark, _folder(spark)).create("geo", SCHEMA)
        for even in order:
            db.write({"geo.About": _about(_nations(spark, sf_dir), even)})
        hashes.append(db.finish())
    return spark.createDataFrame([(hashes[0] == hashes[1],)], "same boolean")


def store_union_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, db = _written(spark, sf_dir)
    db.write({"geo.About": _about(_nations(spark, sf_dir), True)})
    got = db.session().expand("{w = W, n = N} where geo.About {what = W, note = N}")
    return got.select(F.col("n").alias("note"), F.col("w.region.name").alias("region"))


def store_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of a write that gives stored keys other values, and the facts there before and after it."""
    _, db = _written(spark, sf_dir)
    before = db.facts("geo.Nation").count()
    try:
        db.write({"geo.Nation": _nations(spark, sf_dir).withColumn("value", F.col("value") + 1)})
        code = "written"
    except StoreError as e:
        code = e.code
    return spark.createDataFrame([(code, before, db.facts("geo.Nation").count())], "code string, before long, after long")


def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's virtual predicates, joined with each other."""
    catalog, db = _written(spark, sf_dir)
    db.finish()
    return catalog.session(db).query("{name = N, status = S, facts = F, hits = H, misses = M} where system.db.List {name = N, instance = I, status = S, facts = F}; system.db.Interning {instance = I, hits = H, misses = M}")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions from a stream of fact files, delivered twice."""
    folder = Path(_folder(spark))
    db = Catalog(spark, str(folder / "root")).create("geo", SCHEMA)
    source = str(folder / "in")
    region = parquet.read(spark, f"{sf_dir}/region.parquet")
    for _ in range(2):
        region.select(F.struct(F.col("r_regionkey").cast("long").alias("regionkey"), F.col("r_name").alias("name")).alias("key")).write.mode("append").json(source)
        ingest(read_facts(spark, db.schema, "geo.Region", source, 1, streaming=True), db, "geo.Region", str(folder / "state"), available_now=True).awaitTermination()
    return db.session().query("{k = K, n = N} where geo.Region {regionkey = K, name = N}")


def schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new schema does to readers of an old one."""
    from factloom.schema.fingerprint import compare
    from factloom.schema.parser import parse_schema

    old = parse_schema("schema s { predicate P : string predicate Q : int }")
    new = {"same": "schema s { predicate P : string predicate Q : int }", "added": "schema s { predicate P : string predicate Q : int predicate R : int }", "changed": "schema s { predicate P : int predicate Q : int }"}
    return spark.createDataFrame([(k, compare(old, parse_schema(v))[0] == "breaking") for k, v in new.items()], "change string, breaking boolean")


_NATIONS = "nation join region on n_regionkey=r_regionkey"
#: Name: (what to call, SQL).
CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "count": (count, "select count(*) as n from orders join customer on o_custkey=c_custkey"),
    "first_page": (first_page, "select c_custkey as k, c_name as n from customer order by c_custkey, c_name limit 25"),
    "page_after_token": (page_after_token, "select c_custkey as k, c_name as n from customer order by c_custkey, c_name limit 25 offset 25"),
    "first_rows": (first_rows, "select c_custkey as k, c_name as n from customer order by c_custkey, c_name limit 7"),
    "profile": (profile, "select 0::bigint as step, count(*) as rows from nation union all select 1, count(*) from nation join supplier on n_nationkey=s_nationkey"),
    "expand": (expand, f"select s_suppkey as s, n_name as nation, r_name as region from supplier join {_NATIONS.replace(' join', ' on s_nationkey=n_nationkey join')}"),
    "store_round_trip": (store_round_trip, f"select n_name as nation, length(n_name)::bigint as length, r_name as region from {_NATIONS}"),
    "store_counters": (store_counters, f"select 'again' as write, 0::bigint as created, 2*count(*) as deduped from {_NATIONS} union all select 'more', count(*), 2*count(*) from {_NATIONS}"),
    "store_hash_of_any_order": (store_hash_of_any_order, "select true as same"),
    "store_union_expand": (store_union_expand, f"select 'of ' || n_name as note, r_name as region from {_NATIONS}"),
    "store_conflict": (store_conflict, f"select 'conflict' as code, count(*) as before, count(*) as after from {_NATIONS}"),
    "store_listing": (store_listing, f"select 'geo' as name, 'complete' as status, count(*) + count(distinct n_regionkey) as facts, count(*) - count(distinct n_regionkey) as hits, count(*) + count(distinct n_regionkey) as misses from {_NATIONS}"),
    "stream_ingest": (stream_ingest, "select r_regionkey::bigint as k, r_name as n from region"),
    "schema_changes": (schema_changes, "select 'same' as change, false as breaking union all select 'added', false union all select 'changed', true"),
}
