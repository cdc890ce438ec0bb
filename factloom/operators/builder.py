"""From a plan to a DataFrame.

The rows so far are one DataFrame. A level is joined to it on all equalities between its key and values already there
(a cross join if there is none); reading a field through a reference joins the target once per place; an absence is an
anti join. Nothing chooses a physical join: Catalyst and adaptive execution do. Alternatives of a level are united first
and joined once, whatever they read from outside, so a plan grows with the text of the query and no faster.

A join of many rows with many has as many rows as pairs, and the rows of one value would all be made by one task. Such
joins are dealt into cells (``spread``): a value with more than ``CELL`` squared pairs is cut into pieces of about ``CELL``
rows on either side, and each two pieces meet in a cell of their own. That takes a count of both sides' values; it is left
out where one side has each value once (ids, ``unique``) or Catalyst's sizes are ``SMALL``.

Columns of level ``n`` are ``l<n>_<field>``, its facts' ids ``l<n>#id``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import wrapping_sum
from factloom.lang.syntax import Access, Const, Expr, Fact, Prefix, Rec, Var, Wild
from factloom.plans.analysis import Absent, Derive, Level, Plan, Test
from factloom.schema.model import UNIT, Int, Predicate, Record, Ref, Schema, Str, Type, Union


#: Rows on either side of a cell.
CELL = 4096
#: The product of two sides' sizes in bytes, as Catalyst estimates them, under which their join is left as it is.
SMALL = 1 << 36


@dataclass(frozen=True)
class Place:
    """A value in a column. ``level``: of which fact it is the row, or the whole key."""

    column: Column
    type: Type
    level: int | None = None


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def constant(e: Expr) -> Column:
    if isinstance(e, Const):
        return F.lit(e.value).cast("long" if isinstance(e.value, int) else "string")
    return F.struct(*(constant(x).alias(n) for n, x in e.fields))


def leaves(c: Column, t: Type, name: str) -> list[tuple[str, Column]]:
    """Columns without nulls whose order, one after another, is the order of the type."""
    if isinstance(t, Record):
        return [x for n, u in t.fields for x in leaves(c.getField(n), u, f"{name}.{n}")]
    if isinstance(t, Union):
        tag = [(f"{name}.disc", F.coalesce(c.getField("disc").cast("long"), F.lit(-1)))]
        return tag + [x for a in t.alternatives for x in leaves(c.getField(a.name), a.type, f"{name}.{a.name}") if a.type != UNIT]
    return [(name, F.coalesce(c, F.lit("")) if isinstance(t, Str) else F.coalesce(c.cast("long"), F.lit(-(2**63)).cast("long")))]


class Builder:
    def __init__(self, spark: SparkSession, schema: Schema, facts: Callable[[str], DataFrame], plan: Plan, strict: bool = False, observe: Callable | None = None, ordered: bool = True, unique: Callable[[str], frozenset[str]] = lambda _: frozenset()):
        self.spark, self.schema, self.facts, self.plan, self.strict, self.observe, self.ordered, self.unique = spark, schema, facts, plan, strict, observe, ordered, unique
        self.rows: DataFrame | None = None
        self.env: dict[str, Place] = {}
        self.predicates: dict[int, Predicate] = {}
        self.fetched: dict[str, int] = {}
        self.levels = 0
        #: Columns of the rows so far of which no two rows have the same value.
        self.once: set[str] = set()
        #: Columns that put the rows in order, all long or string and never null.
        self.order: list[str] = []

    # ---- levels

    def source(self, p: Predicate, n: int) -> DataFrame:
        df = self.facts(p.name)
        named = [f"`{f}` as `l{n}_{f}`" for f, _ in p.fields]
        value = [f"__value as `l{n}#value`"] if p.value is not None else []
        return df.selectExpr(f"fact_id as `l{n}#id`", *named, *value)

    def key_place(self, p: Predicate, n: int) -> Place:
        if p.scalar:
            return Place(_c(f"l{n}_key"), p.key)
        return Place(F.struct(*(_c(f"l{n}_{f}").alias(f) for f, _ in p.fields)), p.key, n)

    def fields(self, p: Predicate, n: int, key: Expr) -> list[tuple[Expr, Column, Type]]:
        """The key pattern's parts, each with its column."""
        if isinstance(key, Rec) and not p.scalar:
            given = dict(key.fields)
            return [(given[f], _c(f"l{n}_{f}"), t) for f, t in p.fields if f in given]
        place = self.key_place(p, n)
        return [(key, place.column, p.key)]

    def match(self, e: Expr, c: Column, t: Type, own: list, outer: list, new: dict[str, tuple[Column, Type]]) -> None:
        """Conditions for ``c`` to fit ``e``: on the level alone, and (value elsewhere, column) pairs; and what it captures."""
        if isinstance(e, Wild):
            return
        if isinstance(e, Rec) and isinstance(t, Union):
            n, x = e.fields[0]
            alt = t.get(n)
            own.append(c.getField("disc") == alt.tag)
            self.match(x, c.getField(n), alt.type, own, outer, new)
        elif isinstance(e, Rec):
            for n, x in e.fields:
                self.match(x, c.getField(n), t.get(n), own, outer, new)
        elif isinstance(e, Prefix):
            own.append(c.startswith(e.text))
        elif isinstance(e, Const):
            own.append(c == constant(e))
        elif (value := self.folded(e)) is not None:
            self.match(value, c, t, own, outer, new)
        elif isinstance(e, Var) and e.name not in self.env and e.name not in self.plan.places:
            new[e.name] = (c, t)
        else:
            outer.append((self.place(e).column, c))

    def folded(self, e: Expr) -> Expr | None:
        if isinstance(e, Const):
            return e
        if isinstance(e, Var):
            return self.plan.constants.get(e.name)
        if isinstance(e, Access) and not e.select:
            base = self.folded(e.base)
            return dict(base.fields).get(e.field) if isinstance(base, Rec) else None
        return None

    def level(self, s: Level) -> None:
        if len(s.facts) == 1:
            self.single(s.facts[0], s.row)
        else:
            self.several(s)

    def order_by(self, p: Predicate, n: int) -> list[tuple[str, Column]]:
        if not self.ordered:
            return []
        out = [x for f, t in p.fields for x in leaves(_c(f"l{n}_{f}"), t, f"o{n}_{f}")]
        return [*out, (f"o{n}#id", _c(f"l{n}#id"))]

    def single(self, f: Fact, row: str | None) -> None:
        p, n = self.schema.get(f.predicate), self.levels
        self.levels += 1
        self.predicates[n] = p
        own, outer, new = [], [], {}
        for e, c, t in self.fields(p, n, f.key):
            self.match(e, c, t, own, outer, new)
        df = self.source(p, n)
        for o in own:
            df = df.where(o)
        extra = self.order_by(p, n)
        if extra:
            df = df.select("*", *(c.alias(name) for name, c in extra))
        self.order += [name for name, _ in extra]
        if row is not None and row in self.env:
            outer.append((self.env[row].column, _c(f"l{n}#id")))
        self.join(df, outer, "inner", {f"l{n}#id", *(f"l{n}_{x}" for x in self.unique(p.name))})
        for name, (c, t) in new.items():
            whole = not p.scalar and isinstance(f.key, Var)
            self.env[name] = Place(c, t, n if whole else None)
        if row is not None:
            self.env[row] = Place(_c(f"l{n}#id"), Ref(p.name), n)

    def several(self, s: Level) -> None:
        """Alternatives, united: their captures under common names, what they read from outside one column a value."""
        n = self.levels
        self.levels += 1
        if not s.facts:
            self.join(self.spark.range(0).select(F.lit(0).cast("long").alias(f"l{n}#id")), [], "inner")
            if s.row is not None:
                self.env[s.row] = Place(_c(f"l{n}#id"), Int())
            return
        outside: list[Column] = []
        parts: list[tuple[DataFrame, dict[str, tuple[Column, Type]], dict[int, Column], list]] = []
        few: list[set[int]] = []  # by alternative: the values read from outside that at most one of its rows has
        for f in s.facts:
            p = self.schema.get(f.predicate)
            own, outer, new = [], [], {}
            for e, c, t in self.fields(p, n, f.key):
                self.match(e, c, t, own, outer, new)
            df = self.source(p, n)
            for o in own:
                df = df.where(o)
            reads = {}
            for value, c in outer:
                at = next((k for k, x in enumerate(outside) if str(x) == str(value)), None)
                if at is None:
                    at = len(outside)
                    outside.append(value)
                reads[at] = reads[at] & (reads[at] == c) if at in reads else c
            parts.append((df, new, reads, self.order_by(p, n)))
            alone = {str(_c(f"l{n}#id")), *(str(_c(f"l{n}_{x}")) for x in self.unique(p.name))}
            few.append({at for at, c in reads.items() if str(c) in alone})
        common = [name for name in parts[0][1] if all(name in x[1] for x in parts)]
        names: dict[str, list[str]] = {}
        frames = []
        for k, (df, new, reads, order) in enumerate(parts):
            own_order = [(f"o{n}.{k}.{name}", c) for name, c in order]
            names[str(k)] = [name for name, _ in own_order]
            columns = [F.lit(k).cast("long").alias(f"o{n}"), _c(f"l{n}#id"), *(new[v][0].alias(f"l{n}_{v}") for v in common)]
            columns += [c.alias(f"l{n}?{at}") for at, c in reads.items()]
            frames.append(df.select(*columns, *(c.alias(name) for name, c in own_order)))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        filled = {name for own in names.values() for name in own}
        kinds = dict(df.dtypes)
        df = df.select(*(F.coalesce(_c(c), F.lit("") if kinds[c] == "string" else F.lit(-(2**63)).cast("long")).alias(c) if c in filled else _c(c) for c in df.columns))
        self.order += [f"o{n}", *(name for own in names.values() for name in own)]
        together: dict[tuple, list[int]] = {}  # alternatives by the outer values that they read
        for k, x in enumerate(parts):
            together.setdefault(tuple(sorted(x[2])), []).append(k)
        before, once, joined = self.rows, self.once, []
        for reads, which in together.items():  # each by its own equalities, which no join over all of them could use
            self.rows, self.once = before, once
            rarely = {f"l{n}?{at}" for at in reads if all(at in few[k] for k in which)}  # a row of each alternative
            self.join(df if len(together) == 1 else df.where(_c(f"o{n}").isin(which)), [(outside[at], _c(f"l{n}?{at}")) for at in reads], "inner", rarely)
            joined.append(self.rows.select(*joined[0].columns) if joined else self.rows)
        self.rows, self.once = reduce(lambda a, b: a.unionByName(b), joined), set()
        for v in common:
            self.env[v] = Place(_c(f"l{n}_{v}"), parts[0][1][v][1])
        if s.row is not None:
            predicate = self.schema.get(s.facts[0].predicate)
            self.env[s.row] = Place(_c(f"l{n}#id"), Ref(predicate.name))

    def join(self, df: DataFrame, pairs: list[tuple[Column, Column]], how: str, once: set[str] = frozenset()) -> None:
        """``pairs``: what is equal, here and in ``df``. ``once``: columns of ``df`` of which no two rows have the same value."""
        if self.rows is None:
            if how == "inner" and not pairs:
                self.rows, self.once = df, set(once)
                return
            self.rows = self.spark.range(1).select()
        on = [a == b for a, b in pairs]
        if how == "inner":
            left = any(str(a) in {str(_c(x)) for x in self.once} for a, _ in pairs)
            right = any(str(b) in {str(_c(x)) for x in once} for _, b in pairs)
            self.once = (self.once if right else set()) | (set(once) if left else set())
            if pairs and not left and not right and self.observe is None and _size(self.rows) * _size(df) > SMALL:  # an observation may stand in a plan once
                df, cells = self.spread(df, pairs)
                on += cells
        if on:
            self.rows = self.rows.join(df, reduce(lambda a, b: a & b, on), how)
        else:
            self.rows = self.rows.crossJoin(df) if how == "inner" else self.rows.join(df, F.lit(True), how)

    def spread(self, df: DataFrame, pairs: list[tuple[Column, Column]]) -> tuple[DataFrame, list[Column]]:
        """``self.rows`` and ``df`` dealt to tasks by value and cell; ``df`` so dealt, and the cells' equalities.

        A row is in one piece of its side by a hash of its facts' ids, and in as many cells as the other side has pieces.
        A value with few pairs has one cell. Values with more are in a table of their own, which has at most a row for
        each ``CELL`` squared rows of the result.
        """
        keys, n = [f"k{k}" for k in range(len(pairs))], self.levels

        def counted(rows: DataFrame, columns: list[Column], name: str) -> DataFrame:
            return rows.groupBy(*(c.alias(k) for c, k in zip(columns, keys, strict=True))).agg(F.count(F.lit(1)).alias(name))

        left, right = [a for a, _ in pairs], [b for _, b in pairs]
        both = counted(self.rows, left, "left").join(counted(df, right, "right"), keys)
        pieces = {x: F.ceil(F.col(x) / CELL).cast("int").alias(f"#{x}") for x in ("left", "right")}
        hot = F.broadcast(both.where(F.col("left").cast("double") * F.col("right") > float(CELL) ** 2).select(*keys, *pieces.values()))
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # as a number, or small inputs would be put together again, whatever comes of them

        def dealt(rows: DataFrame, columns: list[Column], own: str, other: str) -> DataFrame:
            ids = [c for c in rows.columns if c.endswith("#id")] or rows.columns
            cut = {x: F.coalesce(_c(f"#{x}"), F.lit(1)) for x in (own, other)}
            at = {own: F.pmod(F.xxhash64(*map(_c, ids)), cut[own]).cast("int"), other: F.explode(F.sequence(F.lit(0), cut[other] - 1))}
            rows = rows.join(hot, reduce(lambda a, b: a & b, (c == _c(k) for c, k in zip(columns, keys, strict=True))), "left")
            rows = rows.select(*(_c(c) for c in rows.columns if c not in (*keys, "#left", "#right")), *(c.alias(f"c{n}{own[0]}.{x}") for x, c in at.items()))
            return rows.repartition(partitions, *columns, *(_c(f"c{n}{own[0]}.{x}") for x in ("left", "right")))

        self.rows, df = dealt(self.rows, left, "left", "right"), dealt(df, right, "right", "left")
        return df, [_c(f"c{n}l.{x}") == _c(f"c{n}r.{x}") for x in ("left", "right")]

    # ---- values

    def place(self, e: Expr) -> Place:
        value = self.folded(e)
        if value is not None:
            t = self.plan.types.final(self.plan.types.infer(e))
            return Place(constant(value), t)
        if isinstance(e, Var):
            return self.env[e.name] if e.name in self.env else self.place(self.plan.places[e.name])
        base = self.place(e.base)
        if isinstance(base.type, Ref):
            n = base.level if base.level is not None else self.fetch(base)
            p = self.predicates[n]
            if e.field == "value" and not (isinstance(p.key, Record) and p.key.get("value")):
                return Place(_c(f"l{n}#value"), p.value)
            return Place(_c(f"l{n}_{e.field}"), p.key.get(e.field))
        if e.select:
            alt = base.type.get(e.field)
            self.rows = self.rows.where(base.column.getField("disc") == alt.tag)
            return Place(base.column.getField(e.field), alt.type)
        if base.level is not None:
            return Place(_c(f"l{base.level}_{e.field}"), base.type.get(e.field))
        return Place(base.column.getField(e.field), base.type.get(e.field))

    def fetch(self, base: Place) -> int:
        """The level of the fact that a reference names; one for each place."""
        name = str(base.column)
        if name not in self.fetched:
            n = self.fetched[name] = self.levels
            self.levels += 1
            p = self.predicates[n] = self.schema.get(base.type.predicate)
            df = self.source(p, n)
            self.join(df, [(base.column, _c(f"l{n}#id"))], "left" if self.strict else "inner", {f"l{n}#id"})
            if self.strict:  # a reference to nothing is an error
                self.rows = self.rows.where(F.when(_c(f"l{n}#id").isNull(), F.raise_error(F.lit(f"a reference to no fact of {p.name}")).cast("boolean")).otherwise(True))
        return self.fetched[name]

    # ---- the other steps

    def absent(self, s: Absent) -> None:
        for f in s.facts:
            p, n = self.schema.get(f.predicate), self.levels
            self.levels += 1
            own, outer, new = [], [], {}
            for e, c, t in self.fields(p, n, f.key):
                self.match(e, c, t, own, outer, new)
            df = self.source(p, n)
            for o in own:
                df = df.where(o)
            self.join(df, outer, "left_anti")

    def test(self, s: Test) -> None:
        left = self.place(s.left).column
        if isinstance(s.right, Prefix):
            fits = left.startswith(s.right.text)
            condition = fits if s.op == "fits" else ~fits
        else:
            right = self.place(s.right).column if not isinstance(s.right, Rec) else constant(s.right)
            condition = {"=": left == right, "fits": left == right, "differs": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[s.op]
        self.filter(condition)

    def filter(self, condition: Column) -> None:
        if self.rows is None:
            self.rows = self.spark.range(1).select()
        self.rows = self.rows.where(condition)

    def derive(self, s: Derive) -> None:
        total = wrapping_sum([(sign, self.place(e).column) for sign, e in s.sum.terms])
        if self.rows is None:
            self.rows = self.spark.range(1).select()
        self.rows = self.rows.withColumn(f"d_{s.name}", total)
        self.env[s.name] = Place(_c(f"d_{s.name}"), Int())

    def value(self, e: Expr) -> Place:
        if isinstance(e, Rec):
            parts = [(n, self.value(x)) for n, x in e.fields]
            return Place(F.struct(*(p.column.alias(n) for n, p in parts)), Record(tuple((n, p.type) for n, p in parts)))
        return self.place(e)

    def build(self) -> tuple[DataFrame, Type]:
        """(the head's columns, those of ``order`` behind them; the head's type)."""
        run = {Level: self.level, Derive: self.derive, Absent: self.absent, Test: self.test}
        for k, s in enumerate(self.plan.steps):
            run[type(s)](s)
            if self.observe is not None and self.rows is not None:
                self.rows = self.observe(k, s, self.rows)
        out = self.value(self.plan.head)
        if self.rows is None:
            self.rows = self.spark.range(1).select()
        head = self.plan.head
        if isinstance(head, Rec):
            columns = [self.value(x).column.alias(n) for n, x in head.fields]
        elif isinstance(out.type, Record) and out.level is not None:
            columns = [_c(f"l{out.level}_{n}").alias(n) for n, _ in out.type.fields]
        else:
            columns = [out.column.alias("value")]
        self.width = len(columns)
        return self.rows.select(*columns, *map(_c, self.order)), out.type


def _size(df: DataFrame) -> int:
    """Bytes, as Catalyst estimates them without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def result(df: DataFrame, builder: Builder) -> DataFrame:
    """The head's columns alone, whatever their names."""
    names = df.columns[: builder.width]
    inner = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return inner.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)))
