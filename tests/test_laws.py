"""Random queries: against nested loops, and against each other."""

import random

import pytest

from factloom.lang.syntax import QueryError, Rec
from factloom.schema.parser import SchemaError, SchemaSyntaxError, parse_schema, schema_text
from factloom.session import Session
from tests.fixture import SCHEMA, tables
from tests.model import Model

SCALARS = {"test.Foo": [("id", 0), ("name", 1)], "test.Bar": [("id", 0)], "test.Edge": [("from", 0), ("to", 0)], "test.Node": [("id", 0)], "test.Link": [("at", 0)], "test.Named": [("name", 1)], "test.Label": [("id", 0)]}
VALUES = (["1", "2", "3", "10"], ['"ann"', '"a"..', '"bob"'])
NAMES = (["X", "Y", "Z"], ["M", "N"])


def pattern(r: random.Random, used: set) -> str:
    name = r.choice(list(SCALARS))
    fields, here = [], set()
    for f, kind in SCALARS[name]:
        what = r.random()
        v = r.choice(NAMES[kind])
        if what < 0.65 and v not in here:
            here.add(v)
            fields.append(f"{f} = {v}")
        elif what < 0.8:
            fields.append(f"{f} = {r.choice(VALUES[kind])}")
    used |= here
    return f"{name} {{{', '.join(fields)}}}" if fields else f"{name} _"


def draw(seed: int) -> tuple[list[str], str]:
    """(statements, head)."""
    r, used = random.Random(seed), set()
    out = [pattern(r, used) for _ in range(r.randint(1, 3))]
    ints, texts = sorted(used & set(NAMES[0])), sorted(used & set(NAMES[1]))
    if ints and r.random() < 0.5:
        out.append(f"{r.choice(ints)} {r.choice(['<', '<=', '>', '>=', '!='])} {r.choice(['1', '2', '3'])}")
    if len(ints) > 1 and r.random() < 0.4:
        out.append(f"{ints[0]} {r.choice(['<', '>='])} {ints[1]}")
    if texts and r.random() < 0.4:
        out.append(f"{texts[0]} {r.choice(['=', '!='])} {r.choice(VALUES[1][1:2])}")
    if ints and r.random() < 0.4:
        out.append(f"D = {ints[0]} + 1 - {ints[-1]}")
        ints.append("D")
    if used and r.random() < 0.5:
        out.append("!" + (f"test.Bar {{id = {ints[0]}}}" if ints[:1] and ints[0] != "D" else 'test.Name "zz"'))
    return out, "{" + ", ".join(f"{v.lower()} = {v}" for v in ints + texts) + "}" if ints + texts else "{k = 1}"


@pytest.fixture(scope="module")
def session(spark):
    return Session(spark, SCHEMA, tables(spark))


def ask(session, head, statements) -> list:
    return sorted(map(repr, (tuple(r) for r in session.query(f"{head} where {'; '.join(statements)}").collect())))


@pytest.mark.parametrize("seed", range(24))
def test_against_nested_loops_and_permuted(session, seed):
    statements, head = draw(seed)
    plan = session.plan(f"{head} where {'; '.join(statements)}")
    assert isinstance(plan.head, Rec)
    got = ask(session, head, statements)
    assert got == sorted(map(repr, Model(plan).run()))
    turned = statements[::-1]
    assert ask(session, head, turned) == got


@pytest.mark.parametrize("test", ["test.Bar {id = X}", "test.Edge {from = X, to = _}"])
def test_negation_splits_and_de_morgan(session, test):
    base, head = ["test.Foo {id = X, name = N}"], "{x = X, n = N}"
    whole = ask(session, head, base)
    without = ask(session, head, [*base, f"!{test}"])
    kept = set(whole) - set(without)
    assert set(ask(session, head, [*base, test])) == kept
    assert ask(session, head, [*base, f"!({test} | test.Node {{id = X}})"]) == ask(session, head, [*base, f"!{test}", "!test.Node {id = X}"])


def test_disjunction_is_concatenation(session):
    a, b = "test.Edge {from = X, to = Y}", "test.Edge {from = X, to = 3}"
    head = "{x = X}"
    for rest in ([], ["test.Node {id = X}"], ["test.Bar {id = Z}", "Z < X"]):
        assert ask(session, head, [f"{a} | {b}", *rest]) == sorted(ask(session, head, [a, *rest]) + ask(session, head, [b, *rest])) == ask(session, head, [f"{b} | {a}", *rest])


def test_select_is_injection(session):
    assert ask(session, "{x = X}", ["test.Label {what = {num = X}}"]) == ask(session, "{x = X}", ["test.Label K", "X = K.what.num?"])


# The schema language's acceptance table.
SCHEMAS = [
    ("schema src { predicate File : string }", None),
    ("schema src { predicate Module : string predicate Decl : { module : Module, name : string } -> string }", None),
    ("schema src { predicate Decl : string } schema a { predicate P : { d : src.Decl } }", None),
    ("schema src { type Position = { line : int, col : int } predicate At : { where : Position } }", None),
    ("schema a { import lang.rust }", None),
    ("# what this is\nschema src { type Unit = {} }", None),
    ("schema src { type T = { a : int = 0 | b : string = 1 } predicate P : T }", None),
    ("schema src { predicate P : { only : string = 0 | } }", None),
    ("schema src { type Colour = { red = 0 | green = 1 } predicate P : Colour }", None),
    ("schema src { predicate E : { base : string, type : int, } }", None),
    ("schema src { type T = { a : int | b : string = 1 } predicate P : T }", "reject/missing-discriminant"),
    ("schema src { type T = { a : int = 1 | b : string = 1 } predicate P : T }", "reject/duplicate-discriminant"),
    ("schema src { type T = { a : int = 0 | a : string = 1 } predicate P : T }", "reject/duplicate-alternative"),
    ("schema src { predicate P : [string] }", "nyi/array"),
    ("schema src { predicate P : set string }", "nyi/set"),
    ("schema src { predicate P : maybe string }", "nyi/maybe"),
    ("schema src { type Colour = enum { red | green } }", "nyi/enum"),
    ("schema a evolves b", "nyi/evolves"),
    ("schema src { predicate P : string -> string stored }", "nyi/derivation"),
    ("schema src { derive P stored }", "nyi/derivation"),
    ("schema src { type R = { a : int = 0, b : string } }", "reject/discriminant-on-record-field"),
    ("schema src { predicate P : string predicate P : int }", "reject/redeclaration"),
    ("schema src { type A = B type B = A predicate P : A }", "reject/type-cycle"),
    ("schema src { predicate P : Nowhere }", "reject/unknown-name"),
    ("predicate P : string", "syntax"),
    ("schema src.1 { predicate P : string }", "syntax"),
    ('schema a { import "lang/rust" }', "syntax"),
    ("schema src { predicate file : string }", "syntax"),
]


@pytest.mark.parametrize("text,code", SCHEMAS)
def test_schemas(text, code):
    if code == "syntax":
        with pytest.raises(SchemaSyntaxError):
            parse_schema(text)
    elif code:
        with pytest.raises(SchemaError) as e:
            parse_schema(text)
        assert e.value.codes == [code]
    else:
        s = parse_schema(text)
        assert parse_schema(schema_text(s)).predicates == s.predicates


def test_fingerprints():
    from factloom.schema.fingerprint import canonical, compare, fingerprints

    s = parse_schema("schema base { predicate File : string } schema app { predicate Marker : { file : base.File, at : { line : int, col : int } } }")
    assert canonical(s.get("app.Marker"), fingerprints(s)) == "app.Marker:{file:@base.File#0beb86474c616b93,at:{line:int,col:int}}"
    a = parse_schema("schema c { predicate A : { x = 0 | b : B = 1 } predicate B : { a : A } }")
    b = parse_schema("schema c { predicate B : { a : A } predicate A : { b : B = 1 | x = 0 } }")
    assert compare(a, b) == ("identical", []) and len(set(fingerprints(a).values())) == 2


@pytest.mark.parametrize("text,code", [("X where X = (Y where test.Foo {id = Y}); test.Bar {id = Y}", "nyi/subquery"), ("X where test.Foo {id = 1 | 2}; test.Bar {id = X}", "nyi/disjunction"), ("X where test.Bar {id = never}; test.Bar {id = X}", "nyi/never"), ("X where test.Bar X; test.Nested {outer = X}", "reject/type-mismatch"), ("{a = A} where test.Edge {from = A, to = B}; A = B", "nyi/repeated-variable"), ("X where test.Foo {id = X} | test.Edge {to = X}", "nyi/disjunction")])
def test_more_refusals(session, text, code):
    with pytest.raises(QueryError) as e:
        session.plan(text)
    assert e.value.code == code
