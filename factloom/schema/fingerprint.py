"""Identity of schemas: a fingerprint per predicate, and compatibility as containment of them."""

from __future__ import annotations

from factloom.schema.model import Int, Predicate, Record, Ref, Schema, Str, Type, Union

_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = (h ^ b) * _PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def _form(t: Type, known: dict[str, int]) -> str:
    if isinstance(t, Int | Str):
        return "int" if isinstance(t, Int) else "string"
    if isinstance(t, Ref):
        return f"@{t.predicate}#{known.get(t.predicate, 0):016x}"
    if isinstance(t, Record):
        return "{" + ",".join(f"{n}:{_form(x, known)}" for n, x in t.fields) + "}"
    return "<" + "|".join(f"{a.name}:{_form(a.type, known)}={a.tag}" for a in sorted(t.alternatives, key=lambda a: a.tag)) + ">"


def canonical(p: Predicate, known: dict[str, int]) -> str:
    """A predicate's text; a reference is spelled with its target's fingerprint, 0 where that isn't known."""
    return f"{p.name}:{_form(p.key, known)}" + ("" if p.value is None else f"->{_form(p.value, known)}")


def _targets(t: Type | None) -> set[str]:
    if isinstance(t, Ref):
        return {t.predicate}
    parts = [x for _, x in t.fields] if isinstance(t, Record) else [a.type for a in t.alternatives] if isinstance(t, Union) else []
    return set().union(*map(_targets, parts)) if parts else set()


def _groups(schema: Schema) -> list[list[str]]:
    """Strongly connected groups of references, targets first."""
    edges = {n: sorted(t for t in _targets(p.key) | _targets(p.value) if t in schema.predicates) for n, p in schema.predicates.items()}
    reach = {n: set(edges[n]) for n in edges}
    grew = True
    while grew:
        grew = False
        for n in reach:
            more = set().union(*(reach[t] for t in reach[n])) if reach[n] else set()
            if not more <= reach[n]:
                reach[n] |= more
                grew = True
    out, done = [], set()
    while len(done) < len(edges):
        for n in sorted(edges):
            if n in done:
                continue
            group = {n} | {m for m in reach[n] if n in reach[m]}
            if reach[n] - group <= done:
                out.append(sorted(group))
                done |= group
    return out


def fingerprints(schema: Schema) -> dict[str, int]:
    """By predicate. References within a cycle count as 0 in a member's own hash, which is then joined with the group's."""
    known: dict[str, int] = {}
    for group in _groups(schema):
        own = {n: fnv1a(canonical(schema.predicates[n], known).encode()) for n in group}
        if len(group) == 1 and group[0] not in _targets(schema.predicates[group[0]].key) | _targets(schema.predicates[group[0]].value):
            known |= own
            continue
        cycle = fnv1a(b"".join(own[n].to_bytes(8, "big") for n in group))
        known |= {n: fnv1a(own[n].to_bytes(8, "big") + cycle.to_bytes(8, "big")) for n in group}
    return known


def schema_fingerprint(schema: Schema) -> int:
    known = fingerprints(schema)
    lines = sorted(canonical(p, known) for p in schema.predicates.values())
    return fnv1a(("schema\n" + "".join(f"{x}\n" for x in lines)).encode())


def compare(old: Schema, new: Schema) -> tuple[str, list[str]]:
    """``identical``, ``compatible`` with the added predicates, or ``breaking`` with those changed or gone."""
    a, b = fingerprints(old), fingerprints(new)
    broken = sorted(n for n in a if b.get(n) != a[n])
    if broken:
        return "breaking", broken
    added = sorted(set(b) - set(a))
    return ("compatible", added) if added else ("identical", [])
