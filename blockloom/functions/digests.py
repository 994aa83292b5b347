"""Digests, typed keys, locators and value refinements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions import identity as I

# fixed values: order of preference, the first is the default
ALGORITHMS = ("sha-256", "sha-1", "blake3")
# fixed values: hex digits of a digest
DIGEST_HEX = {"sha-256": 64, "sha-1": 40, "md5": 32, "blake3": 64}
# fixed values: arguments that would make a view depend on when or where it is computed
NON_DETERMINISTIC = ("timestamp", "time", "now", "seed", "random", "nonce", "machine", "host", "hostname", "pid", "current_version", "currentversion")
# fixed values: bounds of refined types, inclusive
BOUNDS = {
    "block_size": (1, 16777216),
    "upload_chunk_size": (1, 16777216),
    "file_size": (1, 1 << 40),
    "block_index": (0, None),
    "offset": (0, None),
    "chunk_count": (1, None),
    "compression_level": (-1, 22),
    "nonce_length": (1, 32),
}
# fixed values: patterns of refined strings
PATTERNS = {
    "hex_lower": "^[0-9a-f]{1,64}$",
    "hex_upper": "^[0-9A-F]{1,64}$",
    "identifier": "^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$",
    "locator_scheme": "^[a-z][a-z0-9+.-]{0,63}$",
}


def hashed(data: Column, algo: str) -> Column:
    """The lower-case hex digest. BLAKE3 isn't available here; asking for it is an error, never another digest."""
    if algo == "sha-256":
        return F.sha2(data, 256)
    if algo == "sha-1":
        return F.sha1(data)
    if algo == "md5":
        return F.md5(data)
    raise NotImplementedError(f"no digest {algo}")


def multi_hash(data: Column, algos: tuple[str, ...] = ("sha-256", "sha-1")) -> Column:
    """A struct with one digest per algorithm; all must be available."""
    return F.struct(*[hashed(data, a).alias(a.replace("-", "")) for a in algos])


def hex_or_text(value: Column, algo: str = "sha-256") -> Column:
    """struct(digest, size): a text that is a digest of the algorithm is taken as one, any other is hashed; size is its characters."""
    is_hex = value.rlike(f"^[0-9a-fA-F]{{{DIGEST_HEX[algo]}}}$")
    return F.struct(F.when(is_hex, F.lower(value)).otherwise(hashed(F.encode(value, "UTF-8"), algo)).alias("digest"), F.length(value).cast("bigint").alias("size"))


def parse_key(value: Column) -> Column:
    """``algorithm:digest:size`` as a struct, null if a part is missing or the digest's length isn't the algorithm's."""
    k = F.split(I.valid_key_text(value), ":")
    return F.when(F.size(k) == 3, F.struct(k[0].alias("algo"), k[1].alias("digest"), k[2].cast("bigint").alias("size")))


def key_kind_ok(kind: Column, size: Column) -> Column:
    """Blobs and blocks hold at least a byte; chunks and manifests may be empty; sizes of views aren't known."""
    return F.when(kind.isin("blob", "block"), size > 0).when(kind.isin("chunk", "manifest"), size >= 0).when(kind == "view", size >= 0).otherwise(False)


def block_key_of(data: Column, algo: str = "sha-256") -> Column:
    return F.concat_ws(":", F.lit(algo), hashed(data, algo), F.octet_length(data).cast("string"))


def locator(digest: Column, prefix: str = "cas", shards: tuple[int, ...] = (2, 4)) -> Column:
    """prefix/ab/cd/abcd...: shards are cut from the hex digits."""
    parts, at = [F.lit(prefix)], 1
    for end in shards:
        parts.append(F.substring(digest, at, end - at + 1))
        at = end + 1
    return F.concat_ws("/", *parts, digest)


def block_path(algo: Column, digest: Column, size: Column) -> Column:
    return F.concat(F.lit("cas/blocks/"), algo, F.lit("/"), digest, F.lit("-"), size.cast("string"))


def render_locator(scheme: Column, bucket: Column, path: Column) -> Column:
    return F.concat(scheme, F.lit("://"), F.concat_ws("/", F.nullif(bucket, F.lit("")), path))


def deterministic_args(args: Column) -> Column:
    """Whether a map of view arguments has no name that depends on time, chance or place (letter case ignored)."""
    names = F.transform(F.map_keys(args), lambda k: F.lower(F.trim(k)))
    return ~F.arrays_overlap(names, F.array(*[F.lit(x) for x in NON_DETERMINISTIC]))


def in_bounds(value: Column, rule: str) -> Column:
    lo, hi = BOUNDS[rule]
    ok = value >= lo
    return F.coalesce(ok & (value <= hi) if hi is not None else ok, F.lit(False))


def refined(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): rows that meet all rules, and the others with ``violations``, the names of the rules they break; null breaks."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    d = df.withColumn("violations", broken)
    return d.where(F.size("violations") == 0).drop("violations"), d.where(F.size("violations") > 0)


def checked(op: str, a: Column, b: Column, rule: str) -> Column:
    """a op b within the rule's bounds, else null (also on overflow)."""
    r = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op](a, b)
    return F.when(in_bounds(r, rule), r)


def saturating(op: str, a: Column, b: Column, rule: str) -> Column:
    """a op b, or ``a`` unchanged where the result would leave the bounds."""
    return F.coalesce(checked(op, a, b, rule), a)


def parse_hex_size(line: Column) -> Column:
    """A chunk-size line: hex digits up to an optional ``;``, null if unreadable."""
    h = F.trim(F.regexp_extract(line, r"^([^;]*)", 1))
    return F.when(h.rlike("^[0-9a-fA-F]{1,7}$"), F.conv(h, 16, 10).cast("bigint"))


def parse_int(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))


def view_payload(algo: Column, digest: Column, size: Column, name: Column, args: Column, scope: Column, prefix: str) -> Column:
    """Canonical bytes of a view: prefix, then version 1 of the base key and of the transform, lengths as big-endian 32 bits."""
    u32 = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    sized = lambda b: F.concat(u32(F.octet_length(b)), b)
    text = lambda s: sized(F.encode(F.coalesce(s, F.lit("")), "UTF-8"))
    one, zero = F.unhex(F.lit("01")), F.unhex(F.lit("00"))
    key = F.concat(one, text(algo), sized(F.unhex(digest)), F.unhex(F.lpad(F.hex(size), 16, "0")))
    pairs = F.array_sort(F.map_entries(args))
    body = F.aggregate(pairs, F.encode(F.lit(""), "UTF-8"), lambda acc, e: F.concat(acc, text(e["key"]), text(e["value"])))
    where = F.when(scope.isNull(), zero).otherwise(F.concat(one, text(scope)))
    return F.concat(F.encode(F.lit(prefix), "UTF-8"), key, one, text(name), where, u32(F.size(pairs)), body)


def view_key(algo: Column, digest: Column, size: Column, name: Column, args: Column, scope: Column, prefix: str = "blockloom:view:v1") -> Column:
    """``sha-256:<digest>:0`` of the canonical bytes. Pass another store's prefix to reproduce its view keys."""
    return F.concat(F.lit("sha-256:"), F.sha2(view_payload(algo, digest, size, name, args, scope, prefix), 256), F.lit(":0"))
