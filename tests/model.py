"""Nested loops over the fixture, in plain Python: what a plan means."""

from factloom.lang.syntax import Access, Const, Prefix, Rec, Var, Wild
from factloom.plans.analysis import Absent, Derive, Level
from factloom.schema.model import Record, Ref, Union
from tests.fixture import FACTS, SCHEMA, _id

BY_ID = {}
ALL = {}
for _name, _rows in FACTS.items():
    p = SCHEMA.get(f"test.{_name}")
    for _k, _row in enumerate(_rows):
        fields = _row[: len(p.fields)]
        fact = {"id": _id(_name, _k + 1), "p": p, "key": fields[0] if p.scalar else tuple(fields), "value": _row[len(fields)] if p.value is not None else None}
        BY_ID[fact["id"]] = fact
        ALL.setdefault(p.name, []).append(fact)


class Model:
    def __init__(self, plan):
        self.plan, self.types = plan, plan.types

    def value(self, e, env):
        """(value, type); nothing if a union holds another alternative."""
        if isinstance(e, Const):
            return e.value, None
        if isinstance(e, Rec):
            return tuple(self.value(x, env)[0] for _, x in e.fields), None
        if isinstance(e, Var):
            if e.name in self.plan.constants:
                return self.value(self.plan.constants[e.name], env)
            return env[e.name] if e.name in env else self.value(self.plan.places[e.name], env)
        assert isinstance(e, Access)
        base = self.value(e.base, env)
        if base is None:
            return None
        v, t = base
        if isinstance(t, Ref):
            f = BY_ID[v]
            if e.field == "value":
                return f["value"], f["p"].value
            v, t = f["key"], f["p"].key
        if e.select:
            alt = t.get(e.field)
            return (v[1 + t.alternatives.index(alt)], alt.type) if v[0] == alt.tag else None
        return v[[n for n, _ in t.fields].index(e.field)], t.get(e.field)

    def match(self, e, v, t, env):
        if isinstance(e, Wild):
            return env
        if isinstance(e, Prefix):
            return env if v.startswith(e.text) else None
        if isinstance(e, Rec) and isinstance(t, Union):
            alt = t.get(e.fields[0][0])
            return self.match(e.fields[0][1], v[1 + t.alternatives.index(alt)], alt.type, env) if v[0] == alt.tag else None
        if isinstance(e, Rec) and isinstance(t, Record):
            for n, x in e.fields:
                env = self.match(x, v[[f for f, _ in t.fields].index(n)], t.get(n), env)
                if env is None:
                    return None
            return env
        if isinstance(e, Var) and e.name not in env and e.name not in self.plan.constants and e.name not in self.plan.places:
            return env | {e.name: (v, t)}
        got = self.value(e, env)
        return env if got is not None and got[0] == v else None

    def run(self):
        rows = [{}]
        for s in self.plan.steps:
            out = []
            for env in rows:
                if isinstance(s, Level):
                    for f in s.facts:
                        for fact in ALL[f.predicate]:
                            new = self.match(f.key, fact["key"], fact["p"].key, env)
                            if new is not None and (s.row not in new or new[s.row][0] == fact["id"]):
                                out.append(new | ({s.row: (fact["id"], Ref(fact["p"].name))} if s.row else {}))
                elif isinstance(s, Absent):
                    if not any(self.match(f.key, x["key"], x["p"].key, env) is not None for f in s.facts for x in ALL[f.predicate]):
                        out.append(env)
                elif isinstance(s, Derive):
                    total = sum(sign * self.value(e, env)[0] for sign, e in s.sum.terms)
                    out.append(env | {s.name: ((total + 2**63) % 2**64 - 2**63, None)})
                else:
                    a = self.value(s.left, env)
                    b = (s.right.text, None) if isinstance(s.right, Prefix) else self.value(s.right, env)
                    if a is None or b is None:
                        continue
                    a, b = a[0], b[0]
                    tests = {
                        "=": lambda: a == b, "fits": lambda: a.startswith(b) if isinstance(s.right, Prefix) else a == b,
                        "differs": lambda: not (a.startswith(b) if isinstance(s.right, Prefix) else a == b),
                        "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
                    }
                    if tests[s.op]():
                        out.append(env)
            rows = out
        return [v[0] for v in (self.value(self.plan.head, env) for env in rows) if v is not None]
