"""Composable stream programs that lower to one DataFrame plan.

A program is data: ``Id``, ``Map``, ``Filter``, ``FlatMap``, ``Fold``, ``Embed`` (any DataFrame function), composed with ``>>``
(sequence), :func:`par` (fan-out in one of three modes), :func:`product` (two halves), :func:`choice` (left or right) and ``label``.
``run`` lowers it; Catalyst then fuses neighbouring maps and filters. :func:`fuse` does the same on the program itself, which shows in
``describe``.

Rows carry ``step`` (which input they come from) and ``idx`` (which output of that step), so that every fan-out rule is an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP, IDX = "step", "idx"


@dataclass(frozen=True)
class Context:
    """The columns that name a stream and order its rows."""

    part: tuple[str, ...]
    order: tuple[str, ...]


class Program:
    def __rshift__(self, other: Program) -> Program:
        return Seq(self, other)

    def label(self, **names: str) -> Program:
        """Rename outputs: new=old."""
        return Seq(self, Embed(lambda d, c: d.withColumnsRenamed({o: n for n, o in names.items()}), "label " + ", ".join(names)))

    def lower(self, df: DataFrame, ctx: Context) -> DataFrame:
        raise NotImplementedError

    def run(self, df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
        """The outputs with ``step`` and ``idx``; the order columns stay."""
        w = Window.partitionBy(*part).orderBy(*order)
        d = df.withColumn(STEP, F.row_number().over(w).cast("bigint") - 1).withColumn(IDX, F.lit(0).cast("bigint"))
        return fuse(self).lower(d, Context(tuple(part), tuple(order)))

    def summarize(self, df: DataFrame, part: Sequence[str], order: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
        """(part..., aggregates) over the outputs."""
        return self.run(df, part, order).groupBy(*part).agg(*[a.alias(n) for n, a in aggs.items()])

    def describe(self) -> str:
        return type(self).__name__


@dataclass(frozen=True)
class Id(Program):
    def lower(self, df, ctx):
        return df


@dataclass(frozen=True)
class Map(Program):
    """New values of columns from the old ones."""

    columns: dict[str, Column]

    def lower(self, df, ctx):
        return df.withColumns(self.columns)

    def describe(self):
        return f"Map({', '.join(self.columns)})"


@dataclass(frozen=True)
class Filter(Program):
    conditions: tuple[Column, ...]

    def lower(self, df, ctx):
        for c in self.conditions:
            df = df.where(c)
        return _renumber(df, ctx)

    def describe(self):
        return f"Filter({len(self.conditions)})"


@dataclass(frozen=True)
class FlatMap(Program):
    """One output per element of an array."""

    name: str
    array: Column

    def lower(self, df, ctx):
        d = df.select("*", F.posexplode(self.array).alias("__pos", "__val"))
        w = Window.partitionBy(*ctx.part, STEP).orderBy(IDX, "__pos")
        d = d.withColumn(IDX, F.row_number().over(w).cast("bigint") - 1)
        return d.withColumn(self.name, F.col("__val")).drop("__pos", "__val")


@dataclass(frozen=True)
class Fold(Program):
    """Running aggregates, one output per input: name -> aggregate column, evaluated over the rows so far."""

    aggs: dict[str, Column]

    def lower(self, df, ctx):
        w = Window.partitionBy(*ctx.part).orderBy(STEP, IDX).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: a.over(w) for n, a in self.aggs.items()})

    def describe(self):
        return f"Fold({', '.join(self.aggs)})"


@dataclass(frozen=True)
class Embed(Program):
    fn: Callable[[DataFrame, Context], DataFrame]
    name: str = "embedded"

    def lower(self, df, ctx):
        return self.fn(df, ctx)

    def describe(self):
        return f"Embed({self.name})"


@dataclass(frozen=True)
class Seq(Program):
    left: Program
    right: Program

    def lower(self, df, ctx):
        return self.right.lower(self.left.lower(df, ctx), ctx)

    def describe(self):
        return f"{self.left.describe()} >> {self.right.describe()}"


@dataclass(frozen=True)
class Par(Program):
    """Both sides on the same input.

    mode ``step``: outputs pair within each step, the longer side's rest is dropped. ``buffered``: the n-th output of one side meets
    the n-th of the other across steps; surplus is dropped at the end. ``one``: each side gives exactly one output per step.
    The outputs named are kept from either side; a name in both is an error.
    """

    left: Program
    right: Program
    left_out: tuple[str, ...]
    right_out: tuple[str, ...]
    mode: str = "step"

    def __post_init__(self):
        clash = set(self.left_out) & set(self.right_out)
        if clash:
            raise ValueError(f"both sides give {sorted(clash)}")
        if self.mode not in ("step", "buffered", "one"):
            raise ValueError(self.mode)

    def lower(self, df, ctx):
        l, r = self.left.lower(df, ctx), self.right.lower(df, ctx)  # noqa: E741
        if self.mode == "buffered":
            w = Window.partitionBy(*ctx.part).orderBy(STEP, IDX)
            l, r = (d.withColumn("__n", F.row_number().over(w)) for d in (l, r))  # noqa: E741
            keys, keep = [*ctx.part, "__n"], [STEP, IDX]
        else:
            keys, keep = [*ctx.part, STEP, *([] if self.mode == "one" else [IDX])], [] if self.mode == "step" else [IDX]
        carry = [c for c in ctx.order if c not in keys]
        out = l.select(*keys, *keep, *carry, *self.left_out).join(r.select(*keys, *self.right_out), keys)
        return out.drop("__n")

    def describe(self):
        return f"({self.left.describe()} & {self.right.describe()})"


@dataclass(frozen=True)
class Choice(Program):
    """Rows routed by a condition to a program of their own state; ``branch`` tells which. Outputs keep their step."""

    is_right: Column
    left: Program
    right: Program

    def lower(self, df, ctx):
        d = df.withColumn("branch", F.when(self.is_right, "right").otherwise("left"))
        inner = replace(ctx, part=(*ctx.part, "branch"))
        l = self.left.lower(d.where("branch = 'left'"), inner)  # noqa: E741
        r = self.right.lower(d.where("branch = 'right'"), inner)
        return l.unionByName(r, allowMissingColumns=True)

    def describe(self):
        return f"({self.left.describe()} | {self.right.describe()})"


@dataclass(frozen=True)
class Zero(Program):
    """No output."""

    def lower(self, df, ctx):
        return df.where(F.lit(False))


@dataclass(frozen=True)
class Scan:
    """A program with outputs at the end of each stream: ``tail`` gives (part..., columns) rows from the same input."""

    program: Program
    tail: Callable[[DataFrame, Context], DataFrame] | None = None
    columns: tuple[str, ...] = field(default=())

    def run(self, df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
        ctx = Context(tuple(part), tuple(order))
        steps = self.program.run(df, part, order).select(*part, STEP, IDX, *self.columns, F.lit(False).alias("is_tail"))
        if self.tail is None:
            return steps
        null = F.lit(None).cast("bigint")
        return steps.unionByName(self.tail(df, ctx).select(*part, null.alias(STEP), null.alias(IDX), *self.columns, F.lit(True).alias("is_tail")))


def _renumber(df: DataFrame, ctx: Context) -> DataFrame:
    return df.withColumn(IDX, F.row_number().over(Window.partitionBy(*ctx.part, STEP).orderBy(IDX)).cast("bigint") - 1)


def par(left: Program, right: Program, left_out: Sequence[str], right_out: Sequence[str], mode: str = "step") -> Program:
    return Par(left, right, tuple(left_out), tuple(right_out), mode)


def choice(is_right: Column, left: Program, right: Program) -> Program:
    return Choice(is_right, left, right)


def product(first: Program, second: Program) -> Program:
    """Two halves of a row, each transformed by its own columns: a sequence, as neither reads what the other writes."""
    return first >> second


def fuse(p: Program) -> Program:
    """Neighbouring filters become one, Id vanishes, sequences lean to the right (maps are fused by Catalyst, which sees the columns)."""
    if isinstance(p, Seq):
        flat: list[Program] = []

        def walk(q: Program) -> None:
            if isinstance(q, Seq):
                walk(q.left)
                walk(q.right)
            elif not isinstance(q, Id):
                flat.append(fuse(q))

        walk(p)
        out: list[Program] = []
        for q in flat:
            if out and isinstance(q, Filter) and isinstance(out[-1], Filter):
                out[-1] = Filter(out[-1].conditions + q.conditions)
            else:
                out.append(q)
        if not out:
            return Id()
        res = out[-1]
        for q in reversed(out[:-1]):
            res = Seq(q, res)
        return res
    if isinstance(p, Par):
        return replace(p, left=fuse(p.left), right=fuse(p.right))
    if isinstance(p, Choice):
        return replace(p, left=fuse(p.left), right=fuse(p.right))
    return p


def where(*conditions: Column) -> Program:
    return Filter(tuple(conditions))


def counter(name: str = "count") -> Program:
    return Fold({name: F.count(F.lit(1))})


def byte_counter(data: str, name: str = "bytes") -> Program:
    return Fold({name: F.coalesce(F.sum(F.octet_length(data).cast("bigint")), F.lit(0))})


#: stages that pipelines are described with: name, what it reads, what it gives
STAGES = (
    ("count_bytes", "chunk", "chunk"),
    ("hash_bytes", "chunk", "chunk"),
    ("rechunk", "chunk", "block"),
    ("derive_keys", "block", "keyed block"),
    ("dedup", "keyed block", "keyed block"),
    ("bomb_guard", "chunk", "chunk"),
    ("throughput", "chunk", "chunk"),
    ("verify", "block", "verdict"),
)
#: pipelines of stages
PIPELINES = {
    "ingest": ("count_bytes", "hash_bytes", "rechunk", "derive_keys"),
    "dedup_ingest": ("count_bytes", "hash_bytes", "rechunk", "derive_keys", "dedup"),
    "verify": ("rechunk", "verify"),
    "safe_ingest": ("bomb_guard", "count_bytes", "hash_bytes", "rechunk"),
}
