"""The command line: ``python -m factloom --root DIR COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
import time
from contextlib import nullcontext
from pathlib import Path

from factloom.lang.syntax import QueryError, QuerySyntaxError
from factloom.plans.views import view
from factloom.schema.fingerprint import canonical, compare, fingerprints, schema_fingerprint
from factloom.schema.model import Schema
from factloom.schema.parser import SchemaError, SchemaSyntaxError, parse_schema
from factloom.session import Session

VIEWS = ("tokens", "tree", "plan", "trace")
FORMATS = ("table", "json", "jsonl", "raw", "count")


def spark_session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("factloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(rows: list) -> str:
    """Rows as aligned columns; a row that isn't an object has one column."""
    rows = [r if isinstance(r, dict) else {"value": r} for r in rows]
    if not rows:
        return "(no rows)"
    text = [[str(json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else v) for v in r.values()] for r in rows]
    names = list(rows[0])
    width = [max(len(n), *(len(t[k]) for t in text)) for k, n in enumerate(names)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in width]), *map(line, text)])


def raw(row) -> str:
    values = row.values() if isinstance(row, dict) else [row]
    return "\t".join(json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else str(v) for v in values)


def show(session: Session, text: str, kind: str, limit: int | None, expand: int | None = None, out=None) -> None:
    write = lambda s: print(s, file=out or sys.stdout)
    if kind == "count":
        write(session.count(text))
        return
    if expand is None and kind in ("jsonl", "raw"):
        for r in session.objects(text, limit):
            write(json.dumps(r, ensure_ascii=False) if kind == "jsonl" else raw(r))
        return
    if expand is not None:
        rows = [json.loads(x) for x in (session.expand(text, expand) if limit is None else session.expand(text, expand).limit(limit)).toJSON().collect()]
    else:
        rows = list(session.objects(text, limit))
    if kind == "table":
        write(table(rows))
    elif kind == "json":
        write(json.dumps(rows, ensure_ascii=False))
    else:
        for r in rows:
            write(json.dumps(r, ensure_ascii=False) if kind == "jsonl" else raw(r))


HELP = ":type Q, :plan Q, :facts, :schema, :limit N, :format F, :expand N, :timing, :profile Q, :more, :clear, :timeout N, :view WHAT Q, :list, :interning, :connect DB, :help, :quit"


class Shell:
    """Lines are queries, or commands after a colon."""

    def __init__(self, session: Session, listing=None, out=None, connect=None):
        self.session, self.listing, self.out, self.connect = session, listing, out or sys.stdout, connect
        self.limit, self.format, self.expand, self.timing, self.timeout = 20, "table", None, False, None
        self.last: tuple[str, str | None] | None = None

    def write(self, text) -> None:
        print(text, file=self.out)

    def line(self, text: str) -> bool:
        """Runs a line; false ends the shell."""
        text = text.strip()
        if not text:
            return True
        began = time.time()
        try:
            if not text.startswith(":"):
                with self.session.limited(self.timeout) if self.timeout else nullcontext():
                    self.run(text)
            else:
                name, _, rest = text[1:].partition(" ")
                if name == "quit":
                    return False
                self.command(name, rest.strip())
        except (QueryError, QuerySyntaxError, ValueError, TimeoutError) as e:
            self.write(f"error: {e}")
        if self.timing:
            self.write(f"({time.time() - began:.2f} s)")
        return True

    def run(self, text: str, token: str | None = None) -> None:
        if self.expand is not None or self.format == "count":
            show(self.session, text, self.format, self.limit, self.expand, self.out)
            return
        page = self.session.page(text, self.limit, token)
        self.last = (text, page.token)
        self.write(table(page.rows) if self.format == "table" else json.dumps(page.rows, ensure_ascii=False) if self.format == "json" else "\n".join(json.dumps(r, ensure_ascii=False) if self.format == "jsonl" else raw(r) for r in page.rows))
        if page.token:
            self.write("... :more")

    def command(self, name: str, rest: str) -> None:
        s = self.session
        if name == "type":
            self.write(s.plan(rest).head_type)
        elif name == "plan":
            self.write(s.plan(rest).text())
        elif name == "facts":
            self.write("\n".join(f"{n}: {s.facts(n).count()}" for n in s.schema.predicates))
        elif name == "schema":
            self.write("\n".join(canonical(p, fingerprints(s.schema)) for p in s.schema.predicates.values()))
        elif name == "limit":
            self.limit = int(rest)
        elif name == "format" and rest in FORMATS:
            self.format = rest
        elif name == "expand":
            self.expand = int(rest) if rest else None
        elif name == "timing":
            self.timing = not self.timing
        elif name == "profile":
            self.write(table(s.profile(rest)))
        elif name == "more" and self.last and self.last[1]:
            self.run(*self.last)
        elif name == "clear":
            self.last = None
        elif name == "timeout":
            self.timeout = float(rest) if rest else None
        elif name == "view" and rest.partition(" ")[0] in VIEWS:
            what, _, text = rest.partition(" ")
            self.write(json.dumps(view(s, what, text), ensure_ascii=False))
        elif name == "list" and self.listing:
            self.write(table([{k: d.meta[k] for k in ("name", "instance", "status", "facts", "created")} for d in self.listing()]))
        elif name == "interning" and self.listing:
            self.write(table([{k: d.meta[k] for k in ("name", "instance", "hits", "misses")} for d in self.listing()]))
        elif name == "connect" and self.connect:
            self.session, self.last = self.connect(rest), None
        else:
            self.write(HELP)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom")
    parser.add_argument("--root", default="databases", help="folder of the databases")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, *extra in (("create", "name", "schema"), ("finish", "db"), ("list",), ("describe", "db"), ("rm", "db"), ("write", "db", "predicate", "path"), ("shell", "db")):
        c = commands.add_parser(name)
        for x in extra:
            c.add_argument(x)
        if name == "write":
            c.add_argument("--depth", type=int, default=3)
        if name == "finish":
            c.add_argument("--allow-empty", action="store_true")
    q = commands.add_parser("query")
    q.add_argument("db", help="name, name@instance, or parquet:FOLDER")
    q.add_argument("text")
    q.add_argument("--format", choices=FORMATS, default="table")
    q.add_argument("--count", action="store_true")
    q.add_argument("--limit", type=int)
    q.add_argument("--timeout", type=float, help="seconds")
    q.add_argument("--expand", type=int, nargs="?", const=16)
    q.add_argument("--profile", action="store_true")
    q.add_argument("--plan", action="store_true")
    q.add_argument("--view", choices=VIEWS, help="print a JSON view instead of rows")
    s = commands.add_parser("schema").add_subparsers(dest="what", required=True)
    for name, *extra in (("check", "file"), ("fingerprint", "file"), ("diff", "old", "new")):
        c = s.add_parser(name)
        for x in extra:
            c.add_argument(x)
        if name == "fingerprint":
            c.add_argument("--canonical", action="store_true")
    o = parser.parse_args(args)
    try:
        return _schema(o) if o.command == "schema" else _run(o)
    except (QueryError, QuerySyntaxError, SchemaError, SchemaSyntaxError, ValueError, TimeoutError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def read_schema(path: str) -> Schema:
    """The schema of a file; a namespace that it imports is the file of that name beside it."""

    def imported(name: str) -> str | None:
        beside = Path(path).with_name(name + Path(path).suffix)
        return beside.read_text() if beside.is_file() else None

    return parse_schema(Path(path).read_text(), imported)


def _schema(o) -> int:
    read = read_schema
    if o.what == "check":
        print(f"{len(read(o.file).predicates)} predicates")
    elif o.what == "fingerprint":
        schema = read(o.file)
        known = fingerprints(schema)
        for n, p in sorted(schema.predicates.items()):
            print(canonical(p, known) if o.canonical else f"{known[n]:016x} {n}")
        print(f"{schema_fingerprint(schema):016x}")
    else:
        verdict, names = compare(read(o.old), read(o.new))
        print(" ".join([verdict, *names]))
        return int(verdict == "breaking")
    return 0


def _run(o) -> int:
    from factloom.sources import parquet
    from factloom.sources.files import ingest_json
    from factloom.sources.store import Catalog

    spark = spark_session()
    catalog = None if o.command in ("query", "shell") and o.db.startswith("parquet:") else Catalog(spark, o.root)

    def connect(db: str) -> Session:
        return parquet.session(spark, db.split(":", 1)[1]) if db.startswith("parquet:") else (c := catalog or Catalog(spark, o.root)).session(c.find(db))

    session = connect(o.db) if o.command in ("query", "shell") else None
    if o.command == "create":
        print(catalog.create(o.name, read_schema(o.schema)).meta["instance"])
    elif o.command == "write":
        got = ingest_json(catalog.find(o.db, writing=True), o.predicate, o.path, o.depth)
        print(f"created {got.created}, deduplicated {got.deduped}")
    elif o.command == "finish":
        print(catalog.find(o.db, sealing=True).finish(o.allow_empty))
    elif o.command == "list":
        print(table([{k: d.meta[k] for k in ("name", "instance", "status", "facts", "created")} for d in catalog.instances()]))
    elif o.command == "describe":
        print(json.dumps(catalog.find(o.db).describe(), indent=1))
    elif o.command == "rm":
        catalog.remove(o.db)
    elif o.command == "query" and o.view:
        print(json.dumps(view(session, o.view, o.text), ensure_ascii=False, indent=1))
    elif o.command == "query":
        if o.plan:
            print(session.plan(o.text).text())
        if o.profile:
            print(table(session.profile(o.text)))
        with session.limited(o.timeout) if o.timeout else nullcontext():
            show(session, o.text, "count" if o.count else o.format, o.limit, o.expand)
    else:
        shell = Shell(session, catalog.instances if catalog else None, connect=connect)
        for line in sys.stdin:
            if not shell.line(line):
                break
    return 0
