"""Canonical forms of digests, algorithms, block keys and organisation ids, as column expressions.

Null stays null. A value that can't be read in any accepted spelling keeps its trimmed lower-case form, so that two rows that
write the same unreadable value still meet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted spellings (any letter case; white space around every part is ignored)
ALGO = r"(?:sha-?256|sha-?1|blake3)"
DIGEST_RE = rf"^\s*(?:{ALGO}\s*[:=]\s*|0x)*([0-9a-f]+)\s*(?::\s*[0-9]+)?\s*$"
KEY_RE = rf"^\s*({ALGO})\s*:\s*(?:{ALGO}\s*:\s*|0x)*([0-9a-f]+)\s*(?::\s*[0-9]+\s*)?:\s*0*([0-9]+)\s*$"
ORG_JUNK_RE = r"^\s*[{(]?\s*(?:urn:)?(?:uuid:)?(?:0x)?|[^0-9a-z]"
BLANK_RE = r"^\s+|\s+$"
VALID_RE = "^(?:sha-1:[0-9a-f]{40}|(?:sha-256|blake3):[0-9a-f]{64}):[0-9]+$"


# Each form is a chain in which every pattern is matched once per row: a Column that is named twice in an expression is computed twice.
def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), BLANK_RE, "")


def digest(c: Column) -> Column:
    """The hexadecimal digits of a digest, lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), DIGEST_RE, "$1"), BLANK_RE, "")


def algorithm(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trimmed(c), "-", ""), "^sha(256|1)$", "sha-$1")


def block_key(c: Column) -> Column:
    """``algorithm:digest:size`` in canonical form."""
    parts = F.regexp_replace(F.lower(c), KEY_RE, "$1:$2:$3")
    return F.regexp_replace(F.regexp_replace(parts, "^sha-?(256|1):", "sha-$1:"), BLANK_RE, "")


def _whole_key(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, VALID_RE, 0), F.lit(""))


def valid_block_key(algo: Column, hex_digits: Column, size: Column) -> Column:
    """The canonical key of (algorithm, digest, size), null unless the digest has the algorithm's number of hex digits."""
    return _whole_key(F.concat(algorithm(algo), F.lit(":"), digest(hex_digits), F.lit(":"), size.cast("string")))


def valid_key_text(c: Column) -> Column:
    """:func:`block_key`, null unless its digest has the algorithm's number of hex digits."""
    return _whole_key(block_key(c))


def org(c: Column) -> Column:
    """A UUID as 8-4-4-4-12, lower case; blank text is null."""
    bare = F.regexp_replace(F.lower(c), ORG_JUNK_RE, "")
    uuid = F.nullif(F.regexp_extract(bare, "^[0-9a-f]{32}$", 0), F.lit(""))
    cut = F.regexp_replace(uuid, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.coalesce(cut, F.nullif(trimmed(c), F.lit("")))


def hex_lower(c: Column) -> Column:
    return F.lower(F.hex(c))


# The same forms for SQL checks (DuckDB dialect).
def sql_digest(c: str) -> str:
    return f"coalesce(nullif(regexp_extract(lower({c}), '{DIGEST_RE}', 1), ''), regexp_replace(lower({c}), '{BLANK_RE}', '', 'g'))"


def sql_algorithm(c: str) -> str:
    bare = f"replace(regexp_replace(lower({c}), '{BLANK_RE}', '', 'g'), '-', '')"
    return f"(case {bare} when 'sha256' then 'sha-256' when 'sha1' then 'sha-1' else {bare} end)"


def sql_block_key(c: str) -> str:
    part = [f"regexp_extract(lower({c}), '{KEY_RE}', {i})" for i in (1, 2, 3)]
    return (
        f"(case when {c} is null then null when {part[1]} = '' then regexp_replace(lower({c}), '{BLANK_RE}', '', 'g') "
        f"else {sql_algorithm(part[0])} || ':' || {part[1]} || ':' || {part[2]} end)"
    )


def sql_org(c: str) -> str:
    bare = f"regexp_replace(lower({c}), '{ORG_JUNK_RE}', '', 'g')"
    cut = " || '-' || ".join(f"substr({bare}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"(case when regexp_full_match({bare}, '[0-9a-f]{{32}}') then {cut} else nullif(regexp_replace(lower({c}), '{BLANK_RE}', '', 'g'), '') end)"
