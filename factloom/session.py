"""Queries over a database: rows, ordered rows, pages, counts, profiles, expansion."""

from __future__ import annotations

import base64
import json
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.lang.syntax import Rec, parse
from factloom.operators.builder import Builder, result
from factloom.operators.rendering import plain, render
from factloom.plans.analysis import Plan, analyse
from factloom.schema.fingerprint import schema_fingerprint
from factloom.schema.model import Record, Ref, Schema, Type, Union

TOKEN_VERSION = 1


class TokenError(ValueError):
    """A resume token that isn't one, or is of another version, query or database."""


@dataclass
class Page:
    rows: list
    token: str | None


class Session:
    """``facts`` gives a predicate's DataFrame: ``fact_id``, a column for each key field (``key`` if scalar), ``__value``.

    ``unique``: a predicate's key fields that no two of its facts share. Without it joins on them are right, and dearer.
    """

    def __init__(self, spark: SparkSession, schema: Schema, facts: Mapping[str, DataFrame] | Callable[[str], DataFrame], identity: str = "", strict: bool = False, unique: Callable[[str], frozenset[str]] = lambda _: frozenset()):
        self.spark, self.schema, self.strict, self.unique = spark, schema, strict, unique
        self.facts = facts if callable(facts) else facts.__getitem__
        self.identity = identity or f"{schema_fingerprint(schema):016x}"

    def plan(self, text: str) -> Plan:
        return analyse(self.schema, parse(text))

    def _built(self, text: str, observe=None, ordered: bool = True) -> tuple[DataFrame, Type, Builder, Plan]:
        plan = self.plan(text)
        builder = Builder(self.spark, self.schema, self.facts, plan, self.strict, observe, ordered, self.unique)
        df, t = builder.build()
        return df, t, builder, plan

    def query(self, text: str) -> DataFrame:
        """The rows, in no order; a record head's fields are the columns, any other head is the column ``value``."""
        df, _, builder, _ = self._built(text, ordered=False)
        return result(df, builder)

    def ordered(self, text: str) -> DataFrame:
        """The rows in key order, the first level's first."""
        df, _, builder, _ = self._built(text)
        return result(self._sorted(df, builder), builder)

    @staticmethod
    def _sorted(df: DataFrame, builder: Builder) -> DataFrame:
        return df.orderBy(*(F.col(f"`{c}`") for c in builder.order)) if builder.order else df

    def count(self, text: str) -> int:
        return self.query(text).count()

    def _value(self, row, t: Type, plan: Plan, width: int):
        """A row's head as one value."""
        if isinstance(t, Record) and (isinstance(plan.head, Rec) or row.__fields__[:width] == [n for n, _ in t.fields]):
            return {n: row[k] for k, (n, _) in enumerate(t.fields)}
        return row[0]

    def rendered(self, text: str) -> list[str]:
        """The ordered rows as text."""
        df, t, builder, plan = self._built(text)
        return [render(self._value(r, t, plan, builder.width), t, self.schema) for r in self._sorted(df, builder).toLocalIterator()]

    def objects(self, text: str, limit: int | None = None) -> Iterator:
        """The ordered rows as JSON values; with ``limit``, the first ones, of which each task keeps no more."""
        df, t, builder, plan = self._built(text)
        rows = self._sorted(df, builder)
        return (plain(self._value(r, t, plan, builder.width), t) for r in (rows.toLocalIterator() if limit is None else rows.limit(limit).collect()))

    @contextmanager
    def limited(self, seconds: float) -> Iterator[None]:
        """What this thread asks of Spark within is cancelled after ``seconds``: ``TimeoutError``."""
        context, tag = self.spark.sparkContext, f"factloom-{uuid.uuid4().hex}"
        late, done = threading.Event(), threading.Event()

        def watch() -> None:
            if not done.wait(seconds):
                late.set()
                while not done.wait(0.5):  # again and again, as another job may begin meanwhile
                    self.cancel(tag)

        watcher = threading.Thread(target=watch, daemon=True)
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        watcher.start()
        try:
            yield
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"stopped after {seconds:g} s") from e
            raise
        finally:
            done.set()
            watcher.join()
            context.removeJobTag(tag)
            context.setInterruptOnCancel(False)

    def cancel(self, tag: str) -> None:
        """Stops the jobs of any thread that has added this job tag."""
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def page(self, text: str, limit: int, token: str | None = None) -> Page:
        """At most ``limit`` ordered rows behind those of ``token``, and a token if there are more.

        A token holds the place in the order of the last row, so a page reads on from there whatever came before.
        """
        if limit < 1:
            raise ValueError("a page has at least one row")
        df, t, builder, plan = self._built(text)
        mark = {"v": TOKEN_VERSION, "plan": f"{plan.fingerprint():016x}", "db": self.identity}
        if token is not None:
            try:
                got = json.loads(base64.urlsafe_b64decode(token.encode()))
                at = got.pop("at")
            except Exception as e:
                raise TokenError("not a token") from e
            for k, what in (("v", "version"), ("plan", "query"), ("db", "database")):
                if got.get(k) != mark[k]:
                    raise TokenError(f"of another {what}")
            if len(at) != len(builder.order):
                raise TokenError("not of this query")
            after = []
            for k in range(len(at)):
                same = [F.col(f"`{builder.order[j]}`") == F.lit(at[j]) for j in range(k)]
                after.append(reduce(lambda a, b: a & b, [*same, F.col(f"`{builder.order[k]}`") > F.lit(at[k])]))
            df = df.where(reduce(lambda a, b: a | b, after) if after else F.lit(False))
            if at:  # follows from the other, and can be taken by a scan
                df = df.where(F.col(f"`{builder.order[0]}`") >= F.lit(at[0]))
        rows = self._sorted(df, builder).limit(limit + 1).collect()
        values = [plain(self._value(r, t, plan, builder.width), t) for r in rows[:limit]]
        if len(rows) <= limit:
            return Page(values, None)
        last = [rows[limit - 1][k] for k in range(builder.width, builder.width + len(builder.order))]
        return Page(values, base64.urlsafe_b64encode(json.dumps(mark | {"at": last}).encode()).decode())

    def pages(self, text: str, limit: int) -> Iterator[Page]:
        token = None
        while True:
            page = self.page(text, limit, token)
            yield page
            token = page.token
            if token is None:
                return

    def profile(self, text: str) -> list[dict]:
        """The rows behind each step, counted while the query runs once; Catalyst may have moved work between steps."""
        from pyspark.sql import Observation

        seen: list[tuple[str, Observation]] = []

        def observe(k: int, step, rows: DataFrame) -> DataFrame:
            o = Observation(f"step{k}")
            seen.append((str(type(step).__name__).lower(), o))
            return rows.observe(o, F.count(F.lit(1)).alias("rows"))

        df, _, builder, plan = self._built(text, observe)
        df.write.format("noop").mode("overwrite").save()
        lines = [x for x in plan.text().split("\n") if x.split(" ")[0] in ("level", "derive", "absent", "test")]
        return [{"step": line, "rows": o.get["rows"]} for line, (_, o) in zip(lines, seen, strict=True)]

    def expand(self, text: str, depth: int = 16) -> DataFrame:
        """The rows with each reference replaced by its fact's key, as deep as ``depth`` references; one join for each place."""
        df, t, builder, _ = self._built(text)
        out = result(df, builder)
        types = dict(t.fields) if isinstance(t, Record) and out.columns == [n for n, _ in t.fields] else {out.columns[0]: t}
        for name in out.columns:
            out = self._expanded(out, name, types[name], depth)
        return out

    def _expanded(self, df: DataFrame, name: str, t: Type, depth: int) -> DataFrame:
        if depth <= 0:
            return df
        if isinstance(t, Record | Union):
            for n, x in t.fields if isinstance(t, Record) else [(a.name, a.type) for a in t.alternatives]:
                if _refers(x):
                    df = df.withColumn(f"{name}.{n}", F.col(f"`{name}`").getField(n))
                    df = self._expanded(df, f"{name}.{n}", x, depth)
                    df = df.withColumn(name, F.col(f"`{name}`").withField(n, F.col(f"`{name}.{n}`"))).drop(f"{name}.{n}")
            return df
        if not isinstance(t, Ref):
            return df
        p = self.schema.get(t.predicate)
        target = self.facts(p.name).select(F.col("fact_id").alias("#id"), (F.col("key") if p.scalar else F.struct(*(F.col(f"`{f}`") for f, _ in p.fields))).alias("#key"))
        columns = df.columns
        df = df.join(target, F.col(f"`{name}`") == F.col("#id"), "left")
        df = df.select(*(F.col("#key").alias(name) if c == name else F.col(f"`{c}`") for c in columns))
        return self._expanded(df, name, p.key, depth - 1)


def _refers(t: Type) -> bool:
    if isinstance(t, Union):
        return any(_refers(a.type) for a in t.alternatives)
    return isinstance(t, Ref) or isinstance(t, Record) and any(_refers(x) for _, x in t.fields)
