"""Governance: capabilities, audit chains, quotas, rate limits, breakers, metrics, metadata envelopes and imports.

Latching folds (quota, token bucket, breaker) aren't running sums: a refused item leaves the state as it was. They fold one key's
items in order. Keys are independent; a key whose items don't fit a task is folded by :mod:`blockloom.streaming` with kept state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: capability tokens, bit 0 upwards
CAPABILITIES = (
    "blob.read",
    "blob.write",
    "blob.delete",
    "doc.read",
    "doc.write",
    "doc.delete",
    "ns.admin",
    "acl.admin",
    "observability.read",
    "audit.read",
    "legal_hold.write",
)
ZERO_HASH = "00" * 32


def scope_mask(scopes: Column) -> Column:
    """The mask of a scope string: tokens between white space, unknown ones ignored, null or empty is 0."""
    tokens = F.split(F.coalesce(scopes, F.lit("")), r"\s+")
    out = F.lit(0).cast("bigint")
    for bit, name in enumerate(CAPABILITIES):
        out = out.bitwiseOR(F.when(F.array_contains(tokens, name), F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


def acl_masks(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., allow, deny) of entries with effect allow or deny and a capability mask; combines on the map side."""
    side = lambda e: F.coalesce(F.bit_or(F.when(F.col("effect") == e, F.col("capabilities"))), F.lit(0).cast("bigint"))
    return entries.groupBy(*keys).agg(side("allow").alias("allow"), side("deny").alias("deny"))


def effective_mask(token: Column, allow: Column, deny: Column) -> Column:
    """(token or allow) without deny; missing masks are 0."""
    z = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return z(token).bitwiseOR(z(allow)).bitwiseAND(F.bitwise_not(z(deny)))


def has_capability(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(1 << CAPABILITIES.index(name))) != 0


def row_hash(prev: Column, fields: Sequence[Column]) -> Column:
    """SHA-256 of the previous hash (hex) and the fields joined by ``|``, missing ones empty."""
    body = F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.sha2(F.concat(F.unhex(prev), F.encode(body, "UTF-8")), 256)


def hash_chain(df: DataFrame, part: Sequence[str], order: Sequence[str], payload: Column) -> DataFrame:
    """(part..., head, rows): the chained digest of each stream's payloads in order, from 32 zero bytes."""
    g = df.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(payload, F.lit("")).alias("__p")))).alias("__s"))
    head = F.aggregate("__s", F.lit(ZERO_HASH), lambda acc, x: F.sha2(F.concat(F.unhex(acc), F.encode(x["__p"], "UTF-8")), 256))
    return g.select(*part, head.alias("head"), F.size("__s").cast("bigint").alias("rows"))


def chain_breaks(df: DataFrame, part: Sequence[str], seq: str, prev_hash: str, own_hash: str, segment: int | None = None) -> DataFrame:
    """(part..., ok, broken_at, total): the first sequence number whose previous hash isn't that of the row before (32 zero bytes at
    the start). ``total`` counts up to and with the break. Rows sent twice count once.

    With ``segment`` rows are compared inside ranges of sequence numbers by many tasks; the last row of each range is compared with the
    first of the next one in a second step, so an organisation with a third of all rows is no single sort.
    """
    d = df.where(F.col(seq).isNotNull()).groupBy(*part, seq).agg(F.min(F.struct(F.col(prev_hash).alias("p"), F.col(own_hash).alias("h"))).alias("r"))
    d = d.withColumn("__seg", F.floor(F.col(seq) / segment) if segment else F.lit(0).cast("bigint"))
    w = Window.partitionBy(*part, "__seg").orderBy(seq)
    d = d.withColumn("__before", F.lag("r.h").over(w)).withColumn("__i", F.row_number().over(w))
    inner = (F.col("__i") > 1) & ~F.col("r.p").eqNullSafe(F.col("__before"))
    seg = d.groupBy(*part, "__seg").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(inner, F.col(seq))).alias("bad"), F.min(F.when(inner, F.col("__i"))).alias("bad_i"), F.min(F.struct(seq, "r.p")).alias("first"), F.max(F.struct(seq, "r.h")).alias("last")
    )
    s = Window.partitionBy(*part).orderBy("__seg")
    want = F.coalesce(F.lag("last.h").over(s), F.unhex(F.lit(ZERO_HASH)))
    seg = seg.withColumn("__start_ok", F.col("first.p").eqNullSafe(want)).withColumn("__sofar", F.coalesce(F.sum("n").over(s.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.when(~F.col("__start_ok"), F.struct(F.col(f"first.{seq}").alias("at"), (F.col("__sofar") + 1).alias("n"))).when(F.col("bad").isNotNull(), F.struct(F.col("bad").alias("at"), (F.col("__sofar") + F.col("bad_i")).alias("n")))
    g = seg.groupBy(*part).agg(F.min(at).alias("b"), F.sum("n").alias("all"))
    return g.select(*part, F.col("b").isNull().alias("ok"), F.col("b.at").alias("broken_at"), F.coalesce("b.n", "all").alias("total"))


def quota(df: DataFrame, part: Sequence[str], order: Sequence[str], amount: str, limit: int) -> DataFrame:
    """(part..., used, accepted, refused): an amount is taken while used + amount <= limit, else nothing is charged."""
    g = df.where(F.col(amount).isNotNull()).groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(amount).cast("bigint").alias("__a")))).alias("__s"))
    zero = F.struct(F.lit(0).cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("n"))
    st = F.aggregate("__s", zero, lambda s, x: F.when(s["u"] + x["__a"] <= limit, F.struct((s["u"] + x["__a"]).alias("u"), (s["n"] + 1).alias("n"))).otherwise(s))
    return g.select(*part, st["u"].alias("used"), st["n"].alias("accepted"), (F.size("__s") - st["n"]).alias("refused"))


def take_tokens(state: tuple[int, int], now: int, tokens: int, rate: int) -> tuple[tuple[int, int], bool]:
    """One take from a bucket of (available, last tick in ms) that holds ``rate`` tokens and refills elapsed * rate / 1000.
    A refused take keeps the refill but not the tick, so the same time refills again."""
    available, last = state
    have = min(rate, available + int((now - last) * rate / 1000))
    return ((have - tokens, now), True) if tokens <= have else ((have, last), False)


def step_breaker(state: tuple[str, int], now: int, ok: bool, max_failures: int, open_ms: int) -> tuple[tuple[str, int], bool]:
    """One call through a breaker: ((state, failures or time it opens again), whether the call was let through). Open rejects until
    its time; then one state of trial follows, in which success closes and failure opens again."""
    kind, x = state
    if kind == "open" and now < x:
        return state, False
    if kind == "open":
        kind = "half_open"
    if ok:
        return ("closed", 0), True
    if kind == "half_open" or x + 1 >= max_failures:
        return ("open", now + open_ms), True
    return ("closed", x + 1), True


def _fold(df: DataFrame, part: Sequence[str], order: Sequence[str], cols: Sequence[str], schema: str, fn) -> DataFrame:
    keys = list(part)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(list(order), kind="stable"))

    return df.select(*dict.fromkeys([*keys, *order, *cols])).groupBy(*keys).applyInPandas(run, schema)


def rate_limit(df: DataFrame, part: Sequence[str], order: Sequence[str], at_ms: str, tokens: str, rate: int) -> DataFrame:
    """Rows (part..., order..., allowed) through one token bucket per key; a bucket starts full, its first tick is the first row's."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = list(dict.fromkeys([*part, *order]))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = (rate, int(pdf[at_ms].iloc[0])), []
        for now, n in zip(pdf[at_ms], pdf[tokens]):
            state, ok = take_tokens(state, int(now), int(n), rate)
            out.append(ok)
        return pdf[cols].assign(allowed=out)

    return _fold(df.where(F.col(at_ms).isNotNull() & F.col(tokens).isNotNull()), part, order, [at_ms, tokens], ", ".join(f"`{c}` {types[c]}" for c in cols) + ", allowed boolean", fn)


def circuit_breaker(df: DataFrame, part: Sequence[str], order: Sequence[str], at_ms: str, success: str, max_failures: int, open_ms: int) -> DataFrame:
    """Rows (part..., order..., passed, state): the state after each call."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = list(dict.fromkeys([*part, *order]))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        state, passed, after = ("closed", 0), [], []
        for now, ok in zip(pdf[at_ms], pdf[success]):
            state, went = step_breaker(state, int(now), bool(ok), max_failures, open_ms)
            passed.append(went)
            after.append(state[0])
        return pdf[cols].assign(passed=passed, state=after)

    return _fold(df.where(F.col(at_ms).isNotNull()), part, order, [at_ms, success], ", ".join(f"`{c}` {types[c]}" for c in cols) + ", passed boolean, state string", fn)


def disk_low(free: Column, total: Column, min_bytes: int, min_ratio: float) -> Column:
    return F.coalesce((free < min_bytes) | (F.try_divide(free, total) < min_ratio), F.lit(False))


def metric_values(events: DataFrame, name: str, tags: str, value: str, order: Sequence[str]) -> DataFrame:
    """(name, tags, count, last): counters add one per event, gauges keep the last value."""
    return events.groupBy(name, tags).agg(F.count(F.lit(1)).alias("count"), F.max_by(F.col(value), F.struct(*order)).alias("last"))


def histogram(df: DataFrame, value: str, width: int = 1024) -> DataFrame:
    """(bucket, n): values divided by ``width``, cut towards zero; nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(F.expr(f"cast(`{value}` as bigint) div {int(width)}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def prometheus_lines(metrics: DataFrame, name: str = "name", tags: str = "tags", value: str = "value") -> DataFrame:
    """(line): ``name{k="v",...} value`` with tags in the order of their names, escaped. ``tags`` is a map."""
    esc = lambda s: F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit('="'), esc(e["value"]), F.lit('"')))
    body = F.when(F.size(tags) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return metrics.select(F.concat(F.col(name), body, F.lit(" "), F.col(value).cast("string")).alias("line"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node of each node's component.

    Large-star and small-star rounds: every edge set is written to the shared folder, so nothing but counts reaches the driver, and the
    number of rounds grows with the logarithm of the longest path. Edges of a node with a large share of them stay where they are
    (:func:`skew_safe_join`).
    """
    from blockloom.operators.membership import skew_safe_join
    from blockloom.workspace import written

    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    nodes = written(e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    e = written(e.where("u <> v"), "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours point to the smallest one
        large = skew_safe_join(both, low, "u", 2 * e.count()).where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.select(F.col("v").alias("n"), F.col("u").alias("x"))
        lows = down.groupBy("n").agg(F.min("x").alias("m"))
        # small star: smaller neighbours and the node itself point to the smallest one
        small = skew_safe_join(down, lows, "n", 2 * e.count()).select(F.col("m").alias("u"), F.col("x").alias("v")).unionByName(lows.select(F.col("m").alias("u"), F.col("n").alias("v"))).where("u <> v").distinct()
        nxt = written(small, "edges")
        same = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = nxt
        if same:
            break
    else:
        raise RuntimeError("components didn't settle")
    root = e.groupBy("v").agg(F.min("u").alias("root"))
    return nodes.join(root, F.col("node") == F.col("v"), "left").select("node", F.coalesce("root", "node").alias("root"))


def envelope(df: DataFrame, status: str, data: str, schema: str) -> DataFrame:
    """``decoded`` and ``error``: JSON data decoded with ``schema`` only where the status is valid."""
    s = F.col(status)
    parsed = F.from_json(data, schema, {"mode": "PERMISSIVE"})
    err = F.when(s == "valid", F.when(F.col(data).isNull() | F.try_parse_json(data).isNull(), "data isn't JSON")).when(s.isin("quarantined", "unverified"), F.concat(F.lit("status is "), s)).otherwise("unknown status")
    return df.withColumn("error", err).withColumn("decoded", F.when(err.isNull(), parsed))


def import_plan(requests: DataFrame, documents: DataFrame, binaries: DataFrame) -> DataFrame:
    """(repo, doc, binary_hash, action, blob_key): skip what is imported, reuse a known binary of the repo, else ingest.

    ``requests``: (repo, doc, binary_hash); ``documents``: (repo, doc, status); ``binaries``: (repo, binary_hash, blob_key).
    """
    done = documents.where("status = 'imported'").select("repo", "doc").distinct().withColumn("__done", F.lit(True))
    known = binaries.groupBy("repo", "binary_hash").agg(F.min("blob_key").alias("blob_key"))
    j = requests.dropDuplicates(["repo", "doc"]).join(done, ["repo", "doc"], "left").join(known, ["repo", "binary_hash"], "left")
    act = F.when(F.col("__done"), "skip").when(F.col("blob_key").isNotNull(), "reuse").otherwise("ingest")
    return j.select("repo", "doc", "binary_hash", act.alias("action"), F.when(act != "skip", F.col("blob_key")).alias("blob_key"))


def selection_snapshot(df: DataFrame, part: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(part..., n, snapshot): the digest of the ordered list of values as JSON, which freezes a selection."""
    g = df.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))).alias("__s"))
    return g.select(*part, F.size("__s").cast("bigint").alias("n"), F.sha2(F.to_json(F.transform("__s", lambda x: x["__v"])), 256).alias("snapshot"))


def frame_acks(df: DataFrame, session: str, order: Sequence[str], kind: str, ack: str) -> DataFrame:
    """(session, ok, problems) of upload sessions: a start acknowledgement first, strictly rising offsets, a completion last."""
    w = Window.partitionBy(session).orderBy(*order)
    d = df.withColumn("__p", F.lag(ack).over(w)).withColumn("__i", F.row_number().over(w)).withColumn("__last", F.lead(kind).over(w).isNull())
    bad = F.array_compact(
        F.array(
            F.when((F.col("__i") == 1) & (F.col(kind) != "start"), F.lit("no start")),
            F.when(F.col(ack) <= F.col("__p"), F.lit("offset doesn't rise")),
            F.when(F.col("__last") & (F.col(kind) != "complete"), F.lit("no completion")),
        )
    )
    g = d.groupBy(session).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(bad)))).alias("problems"))
    return g.select(session, (F.size("problems") == 0).alias("ok"), "problems")
