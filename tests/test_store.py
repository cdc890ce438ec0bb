import threading

import pytest

from factloom.cli import read_schema

from factloom.schema.parser import parse_schema
from factloom.sources.store import Catalog, Database, StoreError, rows

SCHEMA = """
schema code {
  type What = { data : string = 5 | func : int = 2 }
  predicate File : string
  predicate Decl : { file : File, name : string, line : int } -> string
  predicate Use  : { from : Decl, to : Decl }
  predicate Kind : { decl : Decl, what : What }
}
"""


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "root"))


def decl(file, name, line, kind):
    return (((file,), name, line), kind)


DECLS = [decl("a.rs", "main", 1, "fn main"), decl("a.rs", "run", 12, "fn run"), decl("b.rs", "load", 20, "fn load"), decl("a.rs", "main", 1, "fn main")]


def filled(catalog, order):
    db = catalog.create("code", SCHEMA)
    for part in order:
        db.write({"code.Decl": rows(catalog.spark, db.schema, "code.Decl", part, 1)})
    return db


def test_nested_facts_are_interned_once(catalog):
    db = catalog.create("code", SCHEMA)
    got = db.write({"code.Decl": rows(catalog.spark, db.schema, "code.Decl", DECLS, 1)})
    assert (got.created, got.deduped) == (5, 3)  # two files and three declarations; the rest are there already
    assert sorted(db.session().rendered("F where code.File F")) == ["a.rs", "b.rs"]
    assert db.session().rendered("{f = D.file, n = D.name} where D = code.Decl {line = 12}") == ["{f = code.File#1, n = run}"]
    again = db.write({"code.Decl": rows(catalog.spark, db.schema, "code.Decl", DECLS, 1)})
    assert again.created == 0
    use = [((((("a.rs",), "main", 1), "fn main"), ((("b.rs",), "load", 20), "fn load")),)]
    assert db.write({"code.Use": rows(catalog.spark, db.schema, "code.Use", use, 2)}).created == 1
    assert db.session().rendered("{a = U.from.name, b = U.to.file} where U = code.Use _") == ["{a = main, b = code.File#2}"]
    kinds = [((decl("a.rs", "run", 12, "fn run"), (2, None, 7)),), ((decl("b.rs", "load", 20, "fn load"), (5, "x", None)),)]
    db.write({"code.Kind": rows(catalog.spark, db.schema, "code.Kind", kinds, 2)})
    assert db.session().rendered("N where K = code.Kind {what = {func = N}}") == ["7"]


def test_conflicts_and_bad_facts_are_refused(catalog):
    db = filled(catalog, [DECLS])
    for bad in ([decl("a.rs", "main", 1, "other")], [decl("c.rs", "x", 1, "a"), decl("c.rs", "x", 1, "b")]):
        with pytest.raises(StoreError) as e:
            db.write({"code.Decl": rows(catalog.spark, db.schema, "code.Decl", bad, 1)})
        assert e.value.code == "conflict"
    with pytest.raises(StoreError) as e:
        db.write({"code.Decl": rows(catalog.spark, db.schema, "code.Decl", [decl("d.rs", None, 1, "a")], 1)})
    assert e.value.code == "bad-value"
    with pytest.raises(StoreError) as e:
        db.write({"code.Use": catalog.spark.sql("select struct(1L as from, 2L as to) as key")})
    assert e.value.code == "bad-reference"
    assert len(db.session().rendered("F where code.File F")) == 2


def test_content_does_not_depend_on_the_writers_order(catalog):
    a = filled(catalog, [DECLS[:2], DECLS[2:]])
    b = filled(catalog, [DECLS[2:], DECLS[:2]])
    assert a.finish() == b.finish() == a.finish()
    with pytest.raises(StoreError) as e:
        a.write({"code.Decl": rows(catalog.spark, a.schema, "code.Decl", DECLS, 1)})
    assert e.value.code == "not-writable"


def test_catalog(catalog):
    with pytest.raises(StoreError):
        catalog.create("empty", SCHEMA).finish()
    db = filled(catalog, [DECLS])
    assert catalog.find("code", writing=True).meta["instance"] == db.meta["instance"]
    db.finish()
    assert catalog.find("code").meta["status"] == "complete"
    with pytest.raises(StoreError):
        catalog.find("code", writing=True)
    s = catalog.session(db)
    assert s.rendered('{f = F, s = S} where system.db.List {name = "code", facts = F, status = S}') == ["{f = 5, s = complete}"]
    assert s.rendered("{h = H, m = M} where system.db.List {instance = I, name = N}; system.db.Interning {instance = I, hits = H, misses = M}; code.File \"a.rs\"; N != \"empty\"") == ["{h = 3, m = 5}"]
    db.check(claims=parse_schema("schema code { predicate File : string }"))
    with pytest.raises(StoreError):
        db.check(claims=parse_schema("schema code { predicate File : int }"))
    catalog.remove("code")
    with pytest.raises(StoreError):
        catalog.find("code")


class Killed(Exception):
    pass


def killed(*_):
    raise Killed


def test_a_writer_that_dies_leaves_the_database_as_it_was(catalog, monkeypatch):
    db = filled(catalog, [DECLS[:2]])
    before = sorted(db.session().rendered("{f = D.file, n = D.name} where D = code.Decl _"))
    with monkeypatch.context() as m:
        m.setattr(Database, "save", killed)  # the facts are in place, the sidecar isn't
        with pytest.raises(Killed):
            db.write({"code.Decl": rows(catalog.spark, db.schema, "code.Decl", DECLS[2:], 1)})
    assert sorted(db.session().rendered("{f = D.file, n = D.name} where D = code.Decl _")) == before
    got = db.write({"code.Decl": rows(catalog.spark, db.schema, "code.Decl", DECLS[2:], 1)})
    assert (got.created, got.deduped) == (2, 2)
    assert sorted(r.fact_id & 0xFF for r in db.facts("code.Decl").collect()) == [1, 2, 3]


@pytest.mark.parametrize("step", ["save", "sweep"])
def test_a_seal_that_dies_loses_nothing(catalog, monkeypatch, step):
    db, whole = filled(catalog, [DECLS]), filled(catalog, [DECLS[2:], DECLS[:2]]).finish()
    calls = []
    original = getattr(Database, step)
    with monkeypatch.context() as m:
        # sweep runs when a seal begins, and behind the flip
        m.setattr(Database, step, lambda *a: killed() if calls or step == "save" else calls.append(original(*a)))
        with pytest.raises(Killed):
            db.finish()
    assert db.facts("code.Decl").count() == 3 and db.facts("code.File").count() == 2
    assert db.finish() == whole and db.meta["status"] == "complete" and db.meta["facts"] == 5
    assert db.facts("code.Decl").count() == 3
    assert all(len(list(p.iterdir())) == 1 for p in (db.folder / "facts").iterdir())
    part = db.folder / db.meta["parts"]["code.Decl"][0]
    part.rename(part.with_name("gone"))
    with pytest.raises(StoreError) as e:
        db.facts("code.Decl")
    assert e.value.code == "broken"


def test_writers_at_once(catalog):
    db, errors = catalog.create("code", SCHEMA), []

    def write(k):
        try:
            facts = [decl(f"{x}.rs", "f", x, "v") for x in range(k, k + 4)]
            Database(catalog.spark, db.folder, db.schema).write({"code.Decl": rows(catalog.spark, db.schema, "code.Decl", facts, 1)})
        except Exception as e:  # shown by the assertion below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = db.facts("code.Decl").collect()
    assert not errors and sorted(r.line for r in got) == list(range(6)) and len({r.fact_id for r in got}) == 6
    assert db.meta["batches"] == 3 and db.meta["misses"] == 12


def test_the_instance_to_seal_and_selectors(catalog):
    old = filled(catalog, [DECLS])
    sealed = old.finish()
    assert catalog.find("code", sealing=True).meta["instance"] == old.meta["instance"]
    new = filled(catalog, [DECLS[:1]])
    assert catalog.find("code").meta["instance"] == old.meta["instance"]
    assert catalog.find("code", sealing=True).meta["instance"] == new.meta["instance"]
    assert catalog.find("code", sealing=True).finish() != sealed
    for wrong in ("code@", "a@b@c", "@x", ""):
        with pytest.raises(StoreError) as e:
            catalog.find(wrong)
        assert e.value.code == "selector"


def test_references_in_unions_have_no_part_in_the_hash(catalog):
    schema = "schema u { predicate A : string predicate B : { what : { a : A = 1 | n : int = 2 }, k : int } }"
    hashes = []
    for order in (["x", "y"], ["y", "x"]):
        db = catalog.create("u", schema)
        db.write({"u.A": rows(catalog.spark, db.schema, "u.A", [(order[0],)])})
        for k in order:
            db.write({"u.B": rows(catalog.spark, db.schema, "u.B", [(((1, (k,), None), ord(k)),), (((2, None, 5), ord(k)),)], 1)})
        got = db.session().expand("B where u.B B").collect()
        assert sorted((r.what.a, r.k) for r in got if r.what.disc == 1) == [("x", 120), ("y", 121)]
        assert {r.what.n for r in got if r.what.disc == 2} == {5}
        hashes.append(db.finish())
    assert hashes[0] == hashes[1]


def test_a_reference_to_no_fact_is_an_error(catalog):
    db = filled(catalog, [DECLS])
    number = db.schema.get("code.File").number << 40
    db.write({"code.Decl": catalog.spark.sql(f"select struct({number + 99}L as file, 'lost' as name, 1L as line) as key, 'v' as value")})
    assert "lost" in db.session().rendered("N where code.Decl {name = N}")
    number = db.schema.get("code.Decl").number << 40
    db.write({"code.Use": catalog.spark.sql(f"select struct({number + 1}L as from, {number + 77}L as to) as key")})
    with pytest.raises(Exception, match="a reference to no fact"):
        db.session().rendered("{a = U.from.name, b = U.to.name} where U = code.Use _")


def test_imported_schema_files(tmp_path):
    (tmp_path / "base.txt").write_text("schema base { predicate File : string }")
    (tmp_path / "top.txt").write_text("schema top { import base predicate Use : { f : base.File, n : int } }")
    assert set(read_schema(str(tmp_path / "top.txt")).predicates) >= {"base.File", "top.Use"}
