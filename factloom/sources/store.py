"""Databases of facts: folders of Parquet with a sidecar, created against a schema, written in batches, then sealed.

    <root>/<name>/<instance>/   schema.txt, meta.json, facts/<predicate>/<folder>/*.parquet

The sidecar (``meta.json``) lists the folders that are the database; it is replaced in one step behind all other work of
a write or a ``finish``, and what it doesn't list is never read, so a writer that dies at any point leaves the database as
it was. One process at a time writes to a database or finishes it; others wait.

A fact's key is its identity. ``write`` interns batches of facts: nested facts are resolved to ids, bottom-up; a fact that
is stored already is deduplicated; the same key with another value is a conflict, whatever the order, and nothing of the
batch is kept. ``finish`` compacts each predicate in key order, hashes the content and flips the sidecar, after which
the database only reads. All steps over facts are joins and aggregates; only counts come to the driver.

The root is a path that the driver sees as a folder, and that the executors see too.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.schema.fingerprint import compare, fingerprints, schema_fingerprint
from factloom.schema.model import SEQUENCE_BITS, UNIT, Predicate, Record, Ref, Schema, Type, Union, spark_schema, spark_type
from factloom.schema.parser import parse_schema, schema_text
from factloom.session import Session
from factloom.sources.ids import numbered

FORMAT = {"storage": 2, "ids": 1}
WRITABLE, COMPLETE, BROKEN = "writable", "complete", "broken"
DEPTH = 64


class StoreError(ValueError):
    """``code``: not-found, ambiguous, not-writable, broken, format, empty, conflict, bad-reference, bad-value, exists, claim, selector."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass
class Written:
    created: int = 0
    deduped: int = 0
    #: Facts found in each predicate of the batch, nested ones too.
    by_predicate: dict[str, int] = field(default_factory=dict)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    @contextmanager
    def locked(self) -> Iterator[None]:
        """One process at a time changes what is under the root."""
        with open(self.root / ".lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def create(self, name: str, schema: Schema | str) -> Database:
        """A new, writable instance. The schema is frozen with it."""
        schema = parse_schema(schema) if isinstance(schema, str) else schema
        with self.locked():
            instance = f"{int(time.time() * 1000):012x}{uuid.uuid4().hex[:10]}"
            folder = self.root / name / instance
            (folder / "facts").mkdir(parents=True)
            (folder / "schema.txt").write_text(schema_text(schema))
            db = Database(self.spark, folder, schema)
            db.save({"name": name, "instance": instance, "status": WRITABLE, "format": FORMAT, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "facts": -1, "batches": 0, "parts": {}, "next": {}, "hits": 0, "misses": 0})
        return db

    def instances(self) -> list[Database]:
        out = []
        for meta in sorted(self.root.glob("*/*/meta.json")):
            out.append(Database(self.spark, meta.parent, parse_schema((meta.parent / "schema.txt").read_text())))
        return out

    def selected(self, selector: str) -> list[Database]:
        """The instances that ``name`` or ``name@start-of-instance`` names."""
        name, at, start = selector.partition("@")
        if not name or (at and not start) or "@" in start:
            raise StoreError("selector", selector)
        return [d for d in self.instances() if d.meta["name"] == name and d.meta["instance"].startswith(start)]

    def find(self, selector: str, writing: bool = False, sealing: bool = False) -> Database:
        """The instance to read: the newest complete one, else the newest; to write: the only writable one; to seal: that,
        or if none is writable, the one to read, as sealing again does nothing."""
        found = self.selected(selector)
        if writing or sealing:
            open_ = [d for d in found if d.meta["status"] == WRITABLE]
            if len(open_) > 1:
                raise StoreError("ambiguous", selector)
            found = open_ if open_ or writing else found
        if not found:
            raise StoreError("not-found", selector)
        best = max(found, key=lambda d: (d.meta["status"] == COMPLETE, d.meta["status"] == WRITABLE, d.meta["instance"]))
        best.check()
        return best

    def remove(self, selector: str) -> None:
        found = self.selected(selector)
        if len(found) != 1:
            raise StoreError("ambiguous" if found else "not-found", selector)
        with self.locked():
            shutil.rmtree(found[0].folder)

    # ---- virtual predicates

    def listing(self) -> DataFrame:
        """The databases, as ``system.db.List``."""
        rows = [(k + 1, d.meta["name"], d.meta["instance"], d.meta["status"], d.meta["facts"], d.bytes(), d.meta["created"]) for k, d in enumerate(self.instances())]
        return self.virtual("system.db.List", rows)

    def interning(self) -> DataFrame:
        """The write path's counters, as ``system.db.Interning``: facts found stored, and new; keys and facts kept."""
        rows = [(k + 1, d.meta["name"], d.meta["instance"], d.meta["hits"], d.meta["misses"], d.meta["misses"], d.meta["misses"]) for k, d in enumerate(self.instances())]
        return self.virtual("system.db.Interning", rows)

    def virtual(self, name: str, rows: list[tuple]) -> DataFrame:
        p = VIRTUAL.get(name)
        return self.spark.createDataFrame([((p.number << SEQUENCE_BITS) + r[0], *r[1:]) for r in rows], spark_schema(p))

    def session(self, db: Database) -> Session:
        """A session over ``db`` in which the virtual predicates can be asked too; they are read only if a query names them."""
        schema = Schema(dict(db.schema.predicates) | {n: Predicate(p.name, p.number, p.key, p.value) for n, p in VIRTUAL.predicates.items()})
        virtual = {"system.db.List": self.listing, "system.db.Interning": self.interning}
        return Session(self.spark, schema, lambda n: virtual[n]() if n in virtual else db.facts(n), db.identity(), strict=True)


def _virtual() -> Schema:
    s = parse_schema("""
    schema system.db {
      predicate List : { name : string, instance : string, status : string, facts : int, bytes : int, created : string }
      predicate Interning : { name : string, instance : string, hits : int, misses : int, keys : int, entities : int }
    }""")
    return Schema({n: Predicate(p.name, (1 << 22) + k, p.key, p.value) for k, (n, p) in enumerate(s.predicates.items())})


#: Predicates of the catalog; their numbers are beyond those of any schema, and they have no part in its identity.
VIRTUAL = _virtual()


def nested_type(schema: Schema, t: Type, depth: int) -> T.DataType:
    """The Spark type of a value in which references are whole facts: structs of ``key`` and ``value``."""
    if isinstance(t, Ref):
        p = schema.get(t.predicate)
        if depth == 0:
            return T.LongType()
        inner = [T.StructField("key", nested_type(schema, p.key, depth - 1))]
        return T.StructType(inner + ([T.StructField("value", nested_type(schema, p.value, depth - 1))] if p.value is not None else []))
    if isinstance(t, Record):
        return T.StructType([T.StructField(n, nested_type(schema, x, depth)) for n, x in t.fields]) if t.fields else T.BooleanType()
    if isinstance(t, Union):
        return T.StructType([T.StructField("disc", T.IntegerType()), *(T.StructField(a.name, nested_type(schema, a.type, depth)) for a in t.alternatives)])
    return spark_type(t)


def _valid(c: Column, t: Type) -> Column:
    """Whether a value has all its parts, and a union just the alternative that its tag names."""
    ok = c.isNotNull()
    if isinstance(t, Record):
        for n, x in t.fields:
            ok = ok & _valid(c.getField(n), x)
    elif isinstance(t, Union):
        cases = [(c.getField("disc") == a.tag) & (F.lit(True) if a.type == UNIT else _valid(c.getField(a.name), a.type)) for a in t.alternatives]
        out = F.lit(False)
        for x in cases:
            out = out | F.coalesce(x, F.lit(False))
        for a in t.alternatives:
            out = out & (c.getField(a.name).isNull() | (c.getField("disc") == a.tag))
        ok = ok & out
    return F.coalesce(ok, F.lit(False))


def _references(c: Column, t: Type) -> list[tuple[Column, str]]:
    """The references in a value (null in alternatives that aren't taken), with their predicates."""
    if isinstance(t, Ref):
        return [(c, t.predicate)]
    if isinstance(t, Record):
        return [r for n, x in t.fields for r in _references(c.getField(n), x)]
    if isinstance(t, Union):
        return [r for a in t.alternatives for r in _references(c.getField(a.name), a.type)]
    return []


class Database:
    def __init__(self, spark: SparkSession, folder: Path, schema: Schema):
        self.spark, self.folder, self.schema = spark, folder, schema

    @property
    def meta(self) -> dict:
        return json.loads((self.folder / "meta.json").read_text())

    def save(self, meta: dict) -> None:
        new = self.folder / "meta.json.new"
        new.write_text(json.dumps(meta, indent=1))
        with open(new) as f:
            os.fsync(f.fileno())
        os.replace(new, self.folder / "meta.json")

    def check(self, writing: bool = False, claims: Schema | None = None) -> None:
        meta = self.meta
        if meta["format"] != FORMAT:
            raise StoreError("format", str(meta["format"]))
        if meta["status"] == BROKEN:
            raise StoreError("broken")
        if writing and meta["status"] != WRITABLE:
            raise StoreError("not-writable")
        if claims is not None and compare(claims, self.schema)[0] == "breaking":
            raise StoreError("claim", ", ".join(compare(claims, self.schema)[1]))

    def bytes(self) -> int:
        return sum(f.stat().st_size for f in self.folder.rglob("*") if f.is_file())

    def identity(self) -> str:
        return self.meta.get("content") or f"{self.meta['instance']}.{self.meta['batches']}"

    def path(self, predicate: str) -> Path:
        return self.folder / "facts" / predicate

    def facts(self, predicate: str) -> DataFrame:
        kind, parts = spark_schema(self.schema.get(predicate)), self.meta["parts"].get(predicate, [])
        if not parts:
            return self.spark.createDataFrame([], kind)
        if missing := [x for x in parts if not (self.folder / x).is_dir()]:
            raise StoreError("broken", ", ".join(missing))
        return self.spark.read.schema(kind).parquet(*(str(self.folder / x) for x in parts))

    def session(self, claims: Schema | None = None) -> Session:
        self.check(claims=claims)
        return Session(self.spark, self.schema, self.facts, self.identity(), strict=True)

    # ---- writing

    @contextmanager
    def locked(self) -> Iterator[None]:
        """One process at a time changes the database."""
        with open(self.folder / ".lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def sweep(self) -> None:
        """Deletes what a writer that died has left, and what a sealed database no longer needs."""
        kept = {x for parts in self.meta["parts"].values() for x in parts}
        shutil.rmtree(self.folder / "staging", ignore_errors=True)
        for part in self.folder.glob("facts/*/*"):
            if str(part.relative_to(self.folder)) not in kept:
                shutil.rmtree(part, ignore_errors=True)

    def write(self, batch: dict[str, DataFrame]) -> Written:
        """Interns facts: each DataFrame has ``key`` and, if declared, ``value``; a reference in them is an id or a whole fact.

        Facts nested in others are interned first, by their depth in the types given. The batch is one commit.
        """
        with self.locked():
            return self._write(batch)

    def _write(self, batch: dict[str, DataFrame]) -> Written:
        self.check(writing=True)
        self.sweep()
        meta = self.meta
        out, staged = Written(), {}
        order = self._depths(batch)
        frames = {n: self._flat(n, df) for n, df in batch.items()}
        for name, sources in order:
            p = self.schema.get(name)
            found = None
            for top, path, kind in sources:
                part = self._taken(frames[top], path, kind, p)
                found = part if found is None else found.unionByName(part)
            resolved = self._resolved(found, p, staged)
            created, deduped = self._intern(p, resolved, staged, meta)
            out.created += created
            out.deduped += deduped
            out.by_predicate[name] = out.by_predicate.get(name, 0) + created + deduped
        listed = {n: list(parts) for n, parts in meta["parts"].items()}
        for name, parts in staged.items():
            for df in parts:
                target = self.path(name) / uuid.uuid4().hex
                target.parent.mkdir(parents=True, exist_ok=True)
                os.replace(df, target)
                listed.setdefault(name, []).append(str(target.relative_to(self.folder)))
        self.save(meta | {"batches": meta["batches"] + 1, "parts": listed, "hits": meta["hits"] + out.deduped, "misses": meta["misses"] + out.created})
        return out

    @staticmethod
    def _flat(name: str, df: DataFrame) -> DataFrame:
        return df.select("key", *(["value"] if "value" in df.columns else []))

    def _depths(self, batch: dict[str, DataFrame]) -> list[tuple[str, list]]:
        """Where facts of each predicate are nested, deepest first: (predicate, [(batch entry, path, type)])."""
        by_depth: dict[int, dict[str, list]] = {}

        def walk(top: str, path: tuple, t: Type, kind: T.DataType, depth: int) -> int:
            """The height of what is nested under a value."""
            if isinstance(t, Ref):
                if isinstance(kind, T.LongType):
                    return 0
                return fact(top, path, self.schema.get(t.predicate), kind, depth)
            if isinstance(t, Record) and t.fields:
                return max(walk(top, (*path, n), x, kind[n].dataType, depth) for n, x in t.fields)
            if isinstance(t, Union):
                return max(walk(top, (*path, a.name), a.type, kind[a.name].dataType, depth) for a in t.alternatives)
            return 0

        def fact(top: str, path: tuple, p: Predicate, kind: T.StructType, depth: int) -> int:
            if depth > DEPTH:
                raise StoreError("bad-value", "nested too deep")
            if (p.value is not None) != ("value" in kind.names):
                raise StoreError("bad-value", f"{p.name} has {'a' if p.value is not None else 'no'} value side")
            height = walk(top, (*path, "key"), p.key, kind["key"].dataType, depth + 1)
            if p.value is not None:
                height = max(height, walk(top, (*path, "value"), p.value, kind["value"].dataType, depth + 1))
            by_depth.setdefault(height, {}).setdefault(p.name, []).append((top, path, kind))
            return height + 1

        for name, df in batch.items():
            p = self.schema.get(name)
            if p is None:
                raise StoreError("bad-reference", name)
            try:
                fact(name, (), p, self._flat(name, df).schema, 0)
            except KeyError as e:
                raise StoreError("bad-value", str(e)) from e
        return [(n, s) for h in sorted(by_depth) for n, s in by_depth[h].items()]

    @staticmethod
    def _taken(df: DataFrame, path: tuple, kind: T.StructType, p: Predicate) -> DataFrame:
        """The facts at ``path`` in the rows of ``df``."""
        if not path:
            return df
        c = F.col(path[0])
        for n in path[1:]:
            c = c.getField(n)
        return df.where(c.isNotNull()).select(c.getField("key").alias("key"), *([c.getField("value").alias("value")] if p.value is not None else []))

    def _resolved(self, df: DataFrame, p: Predicate, staged: dict) -> DataFrame:
        """Facts whose nested facts are replaced by their ids, checked."""
        key, df = self._ids(df, F.col("key"), p.key, df.schema["key"].dataType, staged)
        df = df.withColumn("key", key)
        if p.value is not None:
            value, df = self._ids(df, F.col("value"), p.value, df.schema["value"].dataType, staged)
            df = df.withColumn("value", value)
        df = df.select(F.col("key").cast(spark_type(p.key)).alias("key"), *([F.col("value").cast(spark_type(p.value)).alias("value")] if p.value is not None else []))
        ok = _valid(F.col("key"), p.key) & (F.lit(True) if p.value is None else _valid(F.col("value"), p.value))
        wrong = F.lit(False)
        for c, target in _references(F.col("key"), p.key) + ([] if p.value is None else _references(F.col("value"), p.value)):
            number = self.schema.get(target).number
            wrong = wrong | (c.isNotNull() & ((F.shiftright(c, SEQUENCE_BITS) != number) | (c.bitwiseAND(F.lit((1 << SEQUENCE_BITS) - 1)) == 0)))
        return df.withColumn("#bad", F.when(~ok, "bad-value").when(wrong, "bad-reference"))

    def _ids(self, df: DataFrame, c: Column, t: Type, kind: T.DataType, staged: dict) -> tuple[Column, DataFrame]:
        if isinstance(t, Ref) and isinstance(kind, T.StructType):
            target = self.schema.get(t.predicate)
            inner, df = self._ids(df, c.getField("key"), target.key, kind["key"].dataType, staged)
            k = f"#k{len(df.columns)}"
            df = df.withColumn(k, F.to_json(inner.cast(spark_type(target.key))) if isinstance(spark_type(target.key), T.StructType) else inner.cast("string"))
            known = self._known(target, staged).select(self._spelt(target).alias(f"{k}.s"), F.col("fact_id").alias(f"{k}.id"))
            df = df.join(known, F.col(f"`{k}`") == F.col(f"`{k}.s`"), "left")
            return F.col(f"`{k}.id`"), df
        if isinstance(t, Record) and t.fields:
            parts = []
            for n, x in t.fields:
                part, df = self._ids(df, c.getField(n), x, kind[n].dataType, staged)
                parts.append(part.alias(n))
            return F.when(c.isNotNull(), F.struct(*parts)), df
        if isinstance(t, Union):
            parts = [c.getField("disc").alias("disc")]
            for a in t.alternatives:
                part, df = self._ids(df, c.getField(a.name), a.type, kind[a.name].dataType, staged)
                parts.append(part.alias(a.name))
            return F.when(c.isNotNull(), F.struct(*parts)), df
        return c, df

    @staticmethod
    def _key(p: Predicate) -> Column:
        return F.col("key") if p.scalar else F.struct(*(F.col(f"`{n}`").alias(n) for n, _ in p.fields))

    def _spelt(self, p: Predicate) -> Column:
        """A key as one string, by which it is joined."""
        return self._key(p).cast("string") if p.scalar and not isinstance(spark_type(p.key), T.StructType) else F.to_json(self._key(p))

    def _known(self, p: Predicate, staged: dict) -> DataFrame:
        out = self.facts(p.name)
        for path in staged.get(p.name, []):
            out = out.unionByName(self.spark.read.schema(spark_schema(p)).parquet(path))
        return out

    def _intern(self, p: Predicate, found: DataFrame, staged: dict, meta: dict) -> tuple[int, int]:
        has = p.value is not None
        spelt = F.to_json("key") if isinstance(spark_type(p.key), T.StructType) else F.col("key").cast("string")
        value = F.to_json(F.struct("value")) if has else F.lit("")
        rows = found.select("key", *(["value"] if has else []), "#bad", F.coalesce(spelt, F.lit("")).alias("#s"), F.coalesce(value, F.lit("")).alias("#v"))
        known = self._known(p, staged).select(self._spelt(p).alias("#s"), (F.to_json(F.struct(F.col("__value").alias("value"))) if has else F.lit("")).alias("#stored"))
        grouped = rows.groupBy("#s").agg(F.first("key").alias("key"), *([F.first("value").alias("value")] if has else []), F.min("#v").alias("#v"), F.max("#v").alias("#w"), F.max("#bad").alias("#bad"), F.count("*").alias("#n"))
        stage = str(self.folder / "staging" / uuid.uuid4().hex)
        joined = grouped.join(known, "#s", "left")
        joined.write.parquet(f"{stage}.all")
        joined = self.spark.read.schema(joined.schema).parquet(f"{stage}.all")
        conflict = (F.col("#v") != F.col("#w")) | (F.col("#stored").isNotNull() & (F.col("#stored") != F.col("#v")))
        facts = joined.agg(F.max("#bad").alias("bad"), F.max(conflict.cast("int")).alias("conflict"), F.sum("#n").alias("n"), F.count_if(F.col("#stored").isNull()).alias("new")).first()
        if facts.bad or facts.conflict:
            shutil.rmtree(self.folder / "staging", ignore_errors=True)
            raise StoreError(facts.bad or "conflict", p.name)
        if facts.new:
            fresh = joined.where(F.col("#stored").isNull())
            start = meta["next"].get(p.name, 1)
            order = [f"#o{k}" for k, _ in enumerate(p.fields)]
            fields = [F.col("key")] if p.scalar else [F.col("key").getField(n) for n, _ in p.fields]
            keyed = fresh.select(*(c.alias(o) for c, o in zip(fields, order, strict=True)), *(["value"] if has else []))
            ids = numbered(keyed, order, start)
            columns = [(F.lit(p.number << SEQUENCE_BITS).cast("long") + F.col("seq")).alias("fact_id"), *(F.col(o).alias(n) for o, (n, _) in zip(order, p.fields, strict=True)), *([F.col("value").alias("__value")] if has else [])]
            ids.select(*columns).write.parquet(stage)
            meta["next"][p.name] = start + facts.new
            staged.setdefault(p.name, []).append(stage)
        shutil.rmtree(f"{stage}.all", ignore_errors=True)
        return facts.new, (facts.n or 0) - facts.new

    # ---- sealing

    def finish(self, allow_empty: bool = False) -> str:
        """Compacts, hashes and seals; again on a sealed database, does nothing. The content's hash.

        The compacted facts are written beside the others; the sidecar then lists them instead, and the others go last.
        """
        with self.locked():
            return self._finish(allow_empty)

    def _finish(self, allow_empty: bool) -> str:
        self.check()
        self.sweep()
        meta = self.meta
        if meta["status"] == COMPLETE:
            return meta["content"]
        total, content, parts = 0, 0, {}
        used = [n for n in self.schema.predicates if meta["parts"].get(n)]
        if not used and not allow_empty:
            raise StoreError("empty")
        for name in used:
            sealed = self.path(name) / f"sealed-{uuid.uuid4().hex}"
            parts[name] = [str(sealed.relative_to(self.folder))]
            p = self.schema.get(name)
            df = self.facts(name)
            keys = [n for n, _ in p.fields]
            df.repartitionByRange(*(F.col(f"`{k}`") for k in keys)).sortWithinPartitions(*(F.col(f"`{k}`") for k in keys)).write.parquet(str(sealed))
            own = self.logical(name).agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.lit(name), "key", "value").cast("decimal(38,0)")).alias("h")).first()
            total += own.n
            content = (content + int(own.h or 0)) % (1 << 64)
        content = f"{schema_fingerprint(self.schema):016x}{content:016x}"
        self.save(meta | {"status": COMPLETE, "facts": total, "content": content, "parts": parts})
        self.sweep()
        return content

    def logical(self, name: str, depth: int = 16) -> DataFrame:
        """Facts without ids: ``key`` and ``value`` as text in which references are spelt out, so writers' order doesn't show."""
        p = self.schema.get(name)
        df = self.facts(name)
        df = df.select(self._key(p).alias("key"), (F.col("__value") if p.value is not None else F.lit(None).cast("string")).alias("value"))
        session = Session(self.spark, self.schema, self.facts)
        df = session._expanded(df, "key", p.key, depth)
        if p.value is not None:
            df = session._expanded(df, "value", p.value, depth)
        spell = lambda c: F.coalesce(F.to_json(F.struct(c)), F.lit(""))
        return df.select(spell("key").alias("key"), spell("value").alias("value"))

    def describe(self) -> dict:
        """The sidecar, with facts and fingerprint of each predicate."""
        known = fingerprints(self.schema)
        return self.meta | {"predicates": {n: {"facts": self.facts(n).count(), "fingerprint": f"{known[n]:016x}"} for n in self.schema.predicates}}


def rows(spark: SparkSession, schema: Schema, predicate: str, facts: list, depth: int = 3) -> DataFrame:
    """A batch entry from Python values: (key,) or (key, value), references as such tuples, down to ``depth``, then ids."""
    p = schema.get(predicate)
    kind = nested_type(schema, Ref(predicate), depth + 1)
    assert isinstance(kind, T.StructType) and len(kind) == 1 + (p.value is not None)
    return spark.createDataFrame(facts, kind)


