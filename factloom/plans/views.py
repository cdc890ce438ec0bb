"""JSON views of a query on its way: tokens, tree, plan, and the rows behind each step as it runs."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from factloom.lang.syntax import parse, to_text, tokens
from factloom.plans.analysis import Absent, Derive, Level, Plan


def token_view(text: str) -> list[dict]:
    return [{"kind": kind, "text": word} for kind, word in tokens(text)]


def node_view(node) -> object:
    """A syntax node as an object: its class, and its parts by name."""
    if is_dataclass(node):
        return {"node": type(node).__name__.lower()} | {f.name: node_view(getattr(node, f.name)) for f in fields(node)}
    return [node_view(x) for x in node] if isinstance(node, tuple | list) else node


def tree_view(text: str) -> object:
    return node_view(parse(text))


def plan_view(plan: Plan) -> dict:
    """The steps in order, what stands for constants and for places elsewhere, and the head with its type."""
    steps = []
    for s in plan.steps:
        if isinstance(s, Level):
            steps.append({"step": "level", "row": s.row, "alternatives": [{"predicate": f.predicate, "pattern": to_text(f)} for f in s.facts]})
        elif isinstance(s, Derive):
            steps.append({"step": "derive", "name": s.name, "sum": to_text(s.sum)})
        elif isinstance(s, Absent):
            steps.append({"step": "absent", "alternatives": [{"predicate": f.predicate, "pattern": to_text(f)} for f in s.facts]})
        else:
            steps.append({"step": "test", "left": to_text(s.left), "op": s.op, "right": to_text(s.right)})
    names = lambda given: {n: to_text(e) for n, e in sorted(given.items())}
    return {"steps": steps, "constants": names(plan.constants), "places": names(plan.places), "head": to_text(plan.head), "type": str(plan.head_type), "fingerprint": f"{plan.fingerprint():016x}"}


def view(session, what: str, text: str) -> object:
    """``what``: tokens, tree, plan or trace."""
    if what == "trace":
        return session.profile(text)
    return token_view(text) if what == "tokens" else tree_view(text) if what == "tree" else plan_view(session.plan(text))
