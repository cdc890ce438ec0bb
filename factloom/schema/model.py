"""Schemas: predicates, their key and value types, and how they are laid out in Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


class Type:
    """A type of a key, a value or a part of one."""


@dataclass(frozen=True)
class Int(Type):
    pass


@dataclass(frozen=True)
class Str(Type):
    pass


@dataclass(frozen=True)
class Ref(Type):
    """A reference to a fact of the named predicate."""

    predicate: str


@dataclass(frozen=True)
class Record(Type):
    fields: tuple[tuple[str, Type], ...]

    def get(self, name: str) -> Type | None:
        return dict(self.fields).get(name)


@dataclass(frozen=True)
class Alternative:
    name: str
    tag: int
    type: Type


@dataclass(frozen=True)
class Union(Type):
    alternatives: tuple[Alternative, ...]

    def get(self, name: str) -> Alternative | None:
        return next((a for a in self.alternatives if a.name == name), None)


UNIT = Record(())


@dataclass(frozen=True)
class Predicate:
    name: str
    number: int
    key: Type
    value: Type | None = None

    @property
    def fields(self) -> tuple[tuple[str, Type], ...]:
        """The key's columns: a record's fields, or one column ``key``."""
        return self.key.fields if isinstance(self.key, Record) else (("key", self.key),)

    @property
    def scalar(self) -> bool:
        return not isinstance(self.key, Record)


@dataclass
class Schema:
    predicates: dict[str, Predicate] = field(default_factory=dict)

    def get(self, name: str) -> Predicate | None:
        return self.predicates.get(name)

    def by_number(self, number: int) -> Predicate | None:
        return next((p for p in self.predicates.values() if p.number == number), None)


#: Bits of a fact id below the predicate's number.
SEQUENCE_BITS = 40


def fact_id(predicate: Predicate, sequence: int) -> int:
    return predicate.number << SEQUENCE_BITS | sequence


def spark_type(t: Type) -> T.DataType:
    """``long``, ``string``, structs; a union is a struct of its tag and one nullable field per alternative."""
    if isinstance(t, Str):
        return T.StringType()
    if isinstance(t, Record):
        return T.StructType([T.StructField(n, spark_type(x)) for n, x in t.fields]) if t.fields else T.BooleanType()
    if isinstance(t, Union):
        return T.StructType([T.StructField("disc", T.IntegerType()), *(T.StructField(a.name, spark_type(a.type)) for a in t.alternatives)])
    return T.LongType()


def spark_schema(p: Predicate) -> T.StructType:
    """The columns of a predicate's facts."""
    out = [T.StructField("fact_id", T.LongType(), False), *(T.StructField(n, spark_type(t)) for n, t in p.fields)]
    if p.value is not None:
        out.append(T.StructField("__value", spark_type(p.value)))
    return T.StructType(out)
