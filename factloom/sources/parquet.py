"""Predicates over plain Parquet tables.

A binding says which columns of a table are a predicate's key and value, as expressions. A table's own non-negative
integer key becomes the fact's sequence (plus one, as sequences start there), so ids and references need no job. The
model has integers and strings only: money is in cents, times are microseconds since the epoch.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from factloom.schema.model import SEQUENCE_BITS, Schema
from factloom.schema.parser import parse_schema
from factloom.session import Session

SCHEMA_TEXT = """
schema tpch {
  predicate Region   : { regionkey : int, name : string }
  predicate Nation   : { nationkey : int, name : string, region : Region }
  predicate Customer : { custkey : int, name : string, nation : Nation, segment : string } -> int
  predicate Supplier : { suppkey : int, name : string, nation : Nation } -> int
  predicate Part     : { partkey : int, name : string, brand : string, type : string, size : int } -> int
  predicate Order    : { orderkey : int, customer : Customer, status : string, priority : string, date : int } -> int
  predicate CustomerName : string
  predicate LineItem : { order : Order, line : int, part : Part, supplier : Supplier, shipdate : int, flag : string, status : string } -> int
}
schema feed {
  type What = { user : int = 3 | kind : string = 0 }
  predicate Event : { id : int, user : int, type : string, ts : int } -> string
  predicate Typed : { what : What, id : int }
  predicate Span  : { at : { user : int, ts : int }, id : int }
}
schema corpus {
  predicate Doc   : { id : int, lang : string, source : string, chars : int } -> string
  predicate Label : { doc : Doc, quality : int, toxic : int }
}
"""


@dataclass(frozen=True)
class Binding:
    """SQL expressions over a table's columns."""

    table: str
    #: The fact's sequence, from 1; none numbers the rows of the scan, for predicates that nothing refers to.
    sequence: str | None
    key: dict[str, str]
    value: str | None = None

    @property
    def unique(self) -> frozenset[str]:
        """The key fields that are the table's own key."""
        return frozenset(f for f, e in self.key.items() if f"{e} + 1L" == self.sequence)


def long(name: str) -> str:
    return f"cast({name} as bigint)"


def cents(name: str) -> str:
    return f"cast(round({name} * 100) as bigint)"


def micros(name: str) -> str:
    return f"unix_micros(cast({name} as timestamp))"


def bindings(schema: Schema) -> dict[str, Binding]:
    def ref(predicate: str, column: str) -> str:
        return f"{schema.get(predicate).number << SEQUENCE_BITS}L + {long(column)} + 1L"

    def after(column: str) -> str:
        return f"{long(column)} + 1L"

    purchase = "event_type <=> 'purchase'"  # never null, so that a test of the tag is this comparison, which scans can take
    what = f"named_struct('disc', if({purchase}, 3, 0), 'user', if({purchase}, {long('user_id')}, null), 'kind', if({purchase}, null, event_type))"
    return {
        "tpch.Region": Binding("region", after("r_regionkey"), {"regionkey": long("r_regionkey"), "name": "r_name"}),
        "tpch.Nation": Binding("nation", after("n_nationkey"), {"nationkey": long("n_nationkey"), "name": "n_name", "region": ref("tpch.Region", "n_regionkey")}),
        "tpch.Customer": Binding("customer", after("c_custkey"), {"custkey": long("c_custkey"), "name": "c_name", "nation": ref("tpch.Nation", "c_nationkey"), "segment": "c_mktsegment"}, cents("c_acctbal")),
        "tpch.Supplier": Binding("supplier", after("s_suppkey"), {"suppkey": long("s_suppkey"), "name": "s_name", "nation": ref("tpch.Nation", "s_nationkey")}, cents("s_acctbal")),
        "tpch.Part": Binding("part", after("p_partkey"), {"partkey": long("p_partkey"), "name": "p_name", "brand": "p_brand", "type": "p_type", "size": long("p_size")}, cents("p_retailprice")),
        "tpch.Order": Binding("orders", after("o_orderkey"), {"orderkey": long("o_orderkey"), "customer": ref("tpch.Customer", "o_custkey"), "status": "o_orderstatus", "priority": "o_orderpriority", "date": micros("o_orderdate")}, cents("o_totalprice")),
        "tpch.CustomerName": Binding("customer", after("c_custkey"), {"key": "c_name"}),
        "tpch.LineItem": Binding("lineitem", None, {"order": ref("tpch.Order", "l_orderkey"), "line": long("l_linenumber"), "part": ref("tpch.Part", "l_partkey"), "supplier": ref("tpch.Supplier", "l_suppkey"), "shipdate": micros("l_shipdate"), "flag": "l_returnflag", "status": "l_linestatus"}, cents("l_extendedprice")),
        "feed.Event": Binding("events", after("event_id"), {"id": long("event_id"), "user": long("user_id"), "type": "event_type", "ts": micros("ts")}, "props"),
        "feed.Typed": Binding("events", after("event_id"), {"what": what, "id": long("event_id")}),
        "feed.Span": Binding("events", after("event_id"), {"at": f"named_struct('user', {long('user_id')}, 'ts', {micros('ts')})", "id": long("event_id")}),
        "corpus.Doc": Binding("documents", after("doc_id"), {"id": long("doc_id"), "lang": "lang", "source": "source", "chars": long("n_chars")}, "text"),
        "corpus.Label": Binding("labels", after("doc_id"), {"doc": ref("corpus.Doc", "doc_id"), "quality": long("quality"), "toxic": long("toxic")}),
    }


def bound(read: Callable[[str], DataFrame], schema: Schema, bindings: dict[str, Binding]) -> Callable[[str], DataFrame]:
    """Predicates' DataFrames; only the columns that a query reads reach the scan."""

    def facts(name: str) -> DataFrame:
        b, p = bindings[name], schema.get(name)
        sequence = "monotonically_increasing_id() + 1L" if b.sequence is None else b.sequence
        value = [] if b.value is None else [f"{b.value} as __value"]
        return read(b.table).selectExpr(f"{p.number << SEQUENCE_BITS}L + {sequence} as fact_id", *(f"{e} as `{f}`" for f, e in b.key.items()), *value)

    return facts


@functools.lru_cache(1)
def schema() -> Schema:
    return parse_schema(SCHEMA_TEXT)


#: Columns of the tables read so far, by path, so that footers are read for them once in a process.
_COLUMNS: dict[str, StructType] = {}


def read(spark: SparkSession, path: str) -> DataFrame:
    if path not in _COLUMNS:
        _COLUMNS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_COLUMNS[path]).parquet(path)


def session(spark: SparkSession, folder: str) -> Session:
    """A session over the tables of ``folder``."""
    tables = bindings(schema())
    return Session(spark, schema(), bound(lambda table: read(spark, f"{folder}/{table}.parquet"), schema(), tables), identity=folder, unique=lambda p: tables[p].unique)
