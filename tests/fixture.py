"""The small database that the language's tests ask."""

from factloom.schema.model import fact_id, spark_schema
from factloom.schema.parser import parse_schema

# The schema and facts that the acceptance table is about.
SCHEMA = parse_schema("""
schema test {
  type What = { num : int = 3 | text : string = 0 }
  predicate Foo    : { id : int, name : string } -> string
  predicate Bar    : { id : int }
  predicate Edge   : { from : int, to : int }
  predicate Node   : { id : int }
  predicate Nested : { outer : { inner : int } }
  predicate Name   : string
  predicate Count  : int
  predicate Shadow : { value : int }
  predicate Wide   : { outer : { extra : int, inner : int } }
  predicate Ref    : { of : Foo }
  predicate Link   : { at : int, of : Foo }
  predicate Deep   : { via : Ref }
  predicate Boxed  : { id : int } -> { lo : int, hi : int }
  predicate Named  : { name : string, of : Foo }
  predicate Tagged : { what : What, id : int }
  predicate Label  : { id : int, what : What }
}
""")


def _id(name: str, n: int) -> int:
    return fact_id(SCHEMA.get(f"test.{name}"), n)


def _num(n: int) -> tuple:
    return (3, n, None)


def _text(s: str) -> tuple:
    return (0, None, s)


FACTS = {
    "Foo": [(1, "ann", "one"), (2, "bob", "two"), (3, "ann", "three")],
    "Bar": [(1,), (2,)],
    "Edge": [(1, 2), (1, 3), (2, 3)],
    "Node": [(2,), (3,)],
    "Nested": [((1,),), ((7,),)],
    "Name": [("abc",), ("ann",), ("anna",), ("bob",)],
    "Count": [(-(2**63),), (-42,), (7,), (1000,)],
    "Shadow": [(5,)],
    "Wide": [((1, 2),)],
    "Ref": [(_id("Foo", 1),), (_id("Foo", 2),)],
    "Link": [(10, _id("Foo", 1)), (11, _id("Foo", 2)), (12, _id("Foo", 2))],
    "Deep": [(_id("Ref", 1),), (_id("Ref", 2),)],
    "Boxed": [(1, (10, 20)), (2, (30, 40))],
    "Named": [("a", _id("Foo", 1)), ("ab", _id("Foo", 2))],
    "Tagged": [(_num(1), 10), (_text("a"), 20), (_num(2), 30), (_text("b"), 40)],
    "Label": [(10, _num(1)), (20, _text("a")), (30, _num(2)), (40, _text("b"))],
}


def tables(spark):
    return {f"test.{n}": spark.createDataFrame([(_id(n, k + 1), *r) for k, r in enumerate(rows)], spark_schema(SCHEMA.get(f"test.{n}"))).coalesce(1).cache() for n, rows in FACTS.items()}
