import io
import json

import pytest

from factloom.cli import Shell, main
from factloom.plans.views import view
from factloom.session import Session, TokenError
from factloom.sources.files import read_facts
from factloom.sources import parquet
from factloom.sources.store import Catalog
from factloom.streaming.ingest import ingest
from tests.corpus import CORPUS
from tests.fixture import SCHEMA, tables


@pytest.fixture(scope="module")
def session(spark):
    return Session(spark, SCHEMA, tables(spark))


PAGED = [t for t, k, _ in CORPUS if k == "rows"][1::16] + ["{a = X, b = T} where test.Label {id = X, what = T}; test.Edge _"]


@pytest.mark.parametrize("text", PAGED)
@pytest.mark.parametrize("size", [1, 2, 5])
def test_pages_are_the_whole(session, text, size):
    assert [r for p in session.pages(text, size) for r in p.rows] == list(session.objects(text))


def test_tokens_are_checked(session, spark):
    token = session.page("X where test.Node {id = X}", 1).token
    for other, text in ((session, "X where test.Bar {id = X}"), (Session(spark, SCHEMA, tables(spark), "other"), "X where test.Node {id = X}")):
        with pytest.raises(TokenError):
            other.page(text, 1, token)
    with pytest.raises(TokenError):
        session.page("X where test.Node {id = X}", 1, "junk")


def test_expand_count_profile(session):
    got = session.expand("X where X = test.Deep _").collect()
    assert sorted(r.value.via.of.name for r in got) == ["ann", "bob"]
    assert session.count("X where test.Edge {from = X}") == 3
    assert [s["rows"] for s in session.profile("X where test.Edge {from = X, to = Y}; test.Node {id = Y}")] == [3, 3]


def test_shell_and_commands(session, tmp_path, capsys):
    out = io.StringIO()
    shell = Shell(session, out=out)
    for line in (":limit 2", "X where test.Foo {name = X}", ":more", ":format jsonl", "{a = X} where test.Bar {id = X}", ":plan X where test.Bar {id = X}", ":type X where test.Bar {id = X}", "X where", ":facts", ":nonsense"):
        assert shell.line(line)
    shell.connect = lambda name: session
    shell.listing = list
    for line in (":clear", ":more", ":connect other", ":interning", ":list", ":view tokens X where X = 1", ":timeout 60", "X where test.Bar {id = X}"):
        assert shell.line(line)
    assert shell.timeout == 60 and shell.last[1] is None
    assert not shell.line(":quit")
    text = out.getvalue()
    assert text.count("(no rows)") == 2 and '{"kind": "where", "text": "where"}' in text
    assert "... :more" in text and '{"a": 1}' in text and "level test.Bar {id = X}" in text and "error:" in text and "test.Foo: 3" in text
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("schema s { predicate P : string }")
    b.write_text("schema s { predicate P : string predicate Q : int }")
    assert main(["schema", "diff", str(a), str(b)]) == 0
    assert main(["schema", "diff", str(b), str(a)]) == 1
    assert "compatible s.Q\nbreaking s.Q" in capsys.readouterr().out


def test_a_stream_of_fact_files(spark, tmp_path):
    db = Catalog(spark, str(tmp_path / "root")).create("s", "schema s { predicate F : string predicate D : { f : F, n : int } -> string }")
    (tmp_path / "in").mkdir()
    lines = [{"key": {"f": {"key": "a"}, "n": 1}, "value": "x"}, {"key": {"f": {"key": "a"}, "n": 2}, "value": "y"}]
    for k, part in enumerate((lines, lines[:1])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        ingest(read_facts(spark, db.schema, "s.D", str(tmp_path / "in"), 1, streaming=True), db, "s.D", str(tmp_path / "state"), available_now=True).awaitTermination()
    assert db.session().rendered("N where s.D {n = N}") == ["1", "2"]


def test_a_query_is_stopped_after_its_time(spark):
    session = Session(spark, SCHEMA, tables(spark))
    with pytest.raises(TimeoutError), session.limited(1.0):
        spark.range(10**13).selectExpr("max(id * 7 % 11) as m").collect()
    with session.limited(60):
        assert session.count("X where test.Edge {from = X}") == 3


def test_limits_and_the_next_page_reach_the_plan(spark):
    session = parquet.session(spark, "/root/testdata/sf0.001")
    assert [r["k"] for r in session.objects("{k = K} where tpch.Customer {custkey = K}", 3)] == [0, 1, 2]
    plan = session.query("{i = I} where feed.Typed {what = {kind = _}, id = I}")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Not(EqualNullSafe(event_type,purchase))]" in plan
    plan = session.query("{i = I, u = U} where feed.Typed {what = {user = U}, id = I}")._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(event_type,purchase)" in plan.split("PushedFilters:")[1]
    plan = session.query("{n = N} where tpch.Part {partkey = A, size = B}; tpch.Customer {custkey = A, name = N} | tpch.Supplier {suppkey = B, name = N}")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_views(session):
    text = '{a = X, b = Y} where test.Edge {from = X, to = Z}; Y = Z + 1; !test.Bar {id = Z}; X < 3; K = 7'
    assert view(session, "tokens", 'X where test.Foo {id = X}')[:3] == [{"kind": "uid", "text": "X"}, {"kind": "where", "text": "where"}, {"kind": "qid", "text": "test.Foo"}]
    tree = view(session, "tree", text)
    assert tree["node"] == "query" and len(tree["body"]) == 5 and json.loads(json.dumps(tree)) == tree
    plan = view(session, "plan", text)
    assert sorted(s["step"] for s in plan["steps"]) == ["absent", "derive", "level", "test"] and plan["constants"] == {"K": "7"}
    assert plan["steps"][0]["alternatives"][0]["predicate"] == "test.Edge"
    assert [set(s) for s in view(session, "trace", "X where test.Edge {from = X}")] == [{"step", "rows"}]
