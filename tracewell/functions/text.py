"""Text predicates and spellings as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ULID = r"^[0-7][0-9A-HJKMNP-TV-Z]{25}$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$"


def is_blank(column: Column) -> Column:
    """True if nothing but Unicode white space is in it; null for null."""
    return ~column.rlike(r"(?U)[^\p{IsWhite_Space}]")


def normalize_text(column: Column) -> Column:
    """Lower case, with every run of Unicode white space as one space and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(column, r"(?U)\p{IsWhite_Space}+", " ")))


def rfc3339(column: Column) -> Column:
    """The instant that an RFC 3339 text names, to the microsecond (more digits are cut); null if it is none.

    Offsets go up to 23:59, further than Spark's own zones do; only those are taken off by hand.
    """
    usual = F.regexp_replace(F.upper(column), r"(\.\d{6})\d+", "$1").try_cast("timestamp")
    local = F.regexp_replace(F.upper(column), r"^(.{10})[T ](\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?).*$", "$1 $2Z").try_cast("timestamp")
    part = lambda i: F.regexp_extract(column, r"([+-])(\d{2}):?(\d{2})$", i).try_cast("int")
    sign = F.when(F.regexp_extract(column, r"([+-])(\d{2}):?(\d{2})$", 1) == "-", -1).otherwise(1)
    by_hand = F.timestamp_micros(F.unix_micros(local) - sign * (part(2) * 60 + part(3)).cast("long") * 60_000_000)
    return F.when(column.rlike(RFC3339), F.coalesce(usual, F.when((part(2) < 24) & (part(3) < 60), by_hand)))


def is_ulid(column: Column) -> Column:
    return column.rlike(ULID)


def is_digest(column: Column) -> Column:
    """64 lower-case hex digits."""
    return column.rlike("^[0-9a-f]{64}$")


def snake_case(column: Column) -> Column:
    return column.rlike("^[a-z0-9]([a-z0-9_]*[a-z0-9])?$")


#: What a terminal may not be shown: controls, formats, unassigned, private and separators other than a space.
_UNSEEN = r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"
_MARK = r"^[\p{Mn}\p{Me}]"


def escape_debug(column: Column) -> Column:
    """``column`` safe for one line of a table: backslash, quotes and whatever isn't printable as escapes.

    Tab, return, line feed and NUL have short escapes; others come out as ``\\u{...}`` in hex. So does a
    combining mark at the start, which would join what stands before it.
    """
    out = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n"), ('"', '\\"'), ("'", "\\'"), ("\0", "\\0")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    code = lambda c: F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))
    each = F.transform(F.regexp_extract_all(out, F.lit("(?s)(.)"), F.lit(1)), lambda c, i: F.when(c.rlike(_UNSEEN) | ((i == 0) & c.rlike(_MARK)), code(c)).otherwise(c))
    return F.when(out.rlike(_UNSEEN) | out.rlike(_MARK), F.array_join(each, "")).otherwise(out)


_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_LONE = r"(?<!\\)(?:\\\\)*\\u[dD][89a-fA-F]"


def is_strict_json(column: Column) -> Column:
    """True for JSON without duplicate keys, lone surrogates or anything after the value, null for null.

    The same as ``strict_json.loads`` in JVM code, up to the depth that Spark's own reader goes to (1,000 levels);
    what is deeper is false.
    """
    # As the first of two elements of an array, so that whatever follows the value is an error, ends the array early or makes a third.
    wrapped = F.try_parse_json(F.concat(F.lit("["), column, F.lit(",0]")))
    one = F.try_variant_get(wrapped, "$[1]", "variant").isNotNull() & F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    return F.when(column.isNotNull(), F.coalesce(one, F.lit(False)) & ~F.regexp_replace(column, _PAIR, "").rlike(_LONE))


def target_key(kind: Column, ident: Column) -> Column:
    return F.concat(kind, F.lit(":"), ident)


def path_depth(path: Column) -> Column:
    """Components of a path, empty ones not counted; null for null."""
    return F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("long")


def path_area(path: Column) -> Column:
    """The folder that a path's file lies in, or null if it lies in none."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.get(parts, F.size(parts) - 2)
