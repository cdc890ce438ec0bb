"""Rows as text and as JSON."""

from __future__ import annotations

from factloom.schema.model import SEQUENCE_BITS, UNIT, Record, Ref, Schema, Type, Union


def render(value, t: Type, schema: Schema) -> str:
    """``1``, ``ann``, ``{a = 1}``, ``ns.Pred#1``, ``{alternative = payload}``."""
    if isinstance(t, Ref):
        p = schema.by_number(value >> SEQUENCE_BITS)
        return f"{p.name if p else '?'}#{value & (1 << SEQUENCE_BITS) - 1}"
    if isinstance(t, Record):
        return "{" + ", ".join(f"{n} = {render(value[n], x, schema)}" for n, x in t.fields) + "}"
    if isinstance(t, Union):
        alt = next(a for a in t.alternatives if a.tag == value["disc"])
        return f"{{{alt.name} = {'{}' if alt.type == UNIT else render(value[alt.name], alt.type, schema)}}}"
    return str(value)


def plain(value, t: Type):
    """The value as JSON takes it; a union is an object of its alternative."""
    if isinstance(t, Record):
        return {n: plain(value[n], x) for n, x in t.fields}
    if isinstance(t, Union):
        alt = next(a for a in t.alternatives if a.tag == value["disc"])
        return {alt.name: {} if alt.type == UNIT else plain(value[alt.name], alt.type)}
    return value
