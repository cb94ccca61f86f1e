"""Identifiers: ULIDs that a retried batch makes again the same, and their reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import ULID

# Fixed value: Crockford's base 32.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _digit(number: Column) -> Column:
    return F.substr(F.lit(ALPHABET), number.cast("int") + 1, F.lit(1))


def make_ulid(at: Column, *identity: Column) -> Column:
    """A ULID of an instant and the hash of an identity: the same input gives the same id."""
    millis = F.unix_millis(at)
    time_part = [_digit(F.shiftrightunsigned(millis, 5 * i).bitwiseAND(31)) for i in range(9, -1, -1)]
    digest = F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(identity)]), {"ignoreNullFields": "false"}), 256)
    random_part = [_digit(F.conv(F.substr(digest, F.lit(1 + 2 * i), F.lit(2)), 16, 10).cast("int").bitwiseAND(31)) for i in range(16)]
    return F.concat(*time_part, *random_part)


def parse_ulid(text: Column) -> Column:
    """The id in a text, white space around it ignored; null if it is none."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(bare.rlike(ULID), bare)


def ulid_millis(ident: Column) -> Column:
    """The milliseconds since 1970 that a ULID begins with."""
    total = F.lit(0).cast("long")
    for i in range(10):
        total = total * 32 + (F.instr(F.lit(ALPHABET), F.substr(ident, F.lit(i + 1), F.lit(1))) - 1)
    return F.when(ident.rlike(ULID), total)
