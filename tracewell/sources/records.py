"""Raw inbox files as bounded physical records: whether each is strict JSON, and its text.

Only what needs the bytes or a strict reader is done here, in Arrow batches; fields are taken from the text
by Columns (see ``operators.quarantine``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.fixed import MAX_BLANK_BYTES, MAX_RECORD_BYTES
from tracewell.functions.strict_json import loads, loads_but_keys

#: What isn't white space in ASCII.
_SOLID = re.compile(rb"[^ \t\n\x0c\r]")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_MINUS_ZERO = re.compile(r"[:\[,][ \t\r\n]*-0(?![.0-9eE])")
#: Within these, Spark's reader takes every text that is JSON: characters (of a name, too), brackets that open, and digits in a row.
_USUAL_CHARS, _USUAL_DEPTH, _USUAL_DIGITS = 50_000, 500, 500

RECORD = T.StructType(
    [
        T.StructField("line", T.IntegerType()),
        T.StructField("problem", T.StringType()),
        T.StructField("is_json", T.BooleanType()),
        T.StructField("is_object", T.BooleanType()),
        T.StructField("schema", T.StringType()),
        T.StructField("has_minus_zero", T.BooleanType()),
        T.StructField("keys_unread", T.BooleanType()),
        T.StructField("text", T.StringType()),
    ]
)


def physical_records(body: str, limit: int | None = 2) -> list[tuple[int, str | None, str | None]]:
    """Up to ``limit`` records of ``body``, or all, as (line, problem, text); a problem ends the file.

    Lines end in LF. Lines of ASCII white space are skipped, within a budget of skipped bytes that starts
    anew after each record. A record of more bytes than allowed, and a blank stretch beyond the budget, are
    problems; exactly the limit is fine.
    """
    data = body.encode("utf-8", "surrogatepass")
    found: list[tuple[int, str | None, str | None]] = []
    at = line = 0
    while at < len(data) and (limit is None or len(found) < limit):
        solid = _SOLID.search(data, at)
        begin = solid.start() if solid else len(data)
        start = (data.rfind(b"\n", at, begin) + 1 or at) if solid else len(data)  # of the next record's line
        skipped = start - at
        if skipped > MAX_BLANK_BYTES or (skipped == MAX_BLANK_BYTES and solid):
            if data.find(b"\n", at, at + MAX_RECORD_BYTES + 1) < 0:  # one blank line that is too long by itself
                return [*found, (line + 1, "record-too-large", None)]
            return [*found, (line + data.count(b"\n", at, at + MAX_BLANK_BYTES) + 1, "blank-input-limit", None)]
        line += data.count(b"\n", at, start) + 1
        if not solid:
            break
        if skipped and skipped + begin - start > MAX_BLANK_BYTES:
            return [*found, (line, "blank-input-limit", None)]
        end = data.find(b"\n", begin)
        content = data[start : end if end >= 0 else len(data)]
        if len(content) > MAX_RECORD_BYTES:
            return [*found, (line, "record-too-large", None)]
        found.append((line, None, content.decode("utf-8", "surrogatepass")))
        at = end + 1 if end >= 0 else len(data)
    return found


def read(text: str) -> tuple[bool, bool | None, str | None, bool | None, bool]:
    """(is_json, is_object, schema, has_minus_zero, keys_unread) of one record.

    ``schema`` is that field where it is text. The integer -0, which other readers take for 0 but the format doesn't
    know, is told by its spelling. With ``keys_unread`` the text is JSON unless a key comes twice, which Spark's own
    reader tells when it takes the text; only texts beyond what that reads are read for keys here.
    """
    half = _USUAL_DIGITS // 2  # a longer row of digits fills one such piece at least
    usual = len(text) <= _USUAL_CHARS and text.count("{") + text.count("[") <= _USUAL_DEPTH and not any(text[i : i + half].isdigit() for i in range(0, len(text) - half + 1, half))
    try:
        value = loads_but_keys(text) if usual else loads(text)
    except ValueError:
        return False, None, None, None, False
    tag = value.get("schema") if isinstance(value, dict) else None
    return True, isinstance(value, dict), tag if isinstance(tag, str) else None, _MINUS_ZERO.search(text) is not None and _MINUS_ZERO.search(_STRING.sub('""', text)) is not None, usual


def read_records(files: DataFrame, key: str = "raw_id", body: str = "body", limit: int | None = 2) -> DataFrame:
    """(key, records): the first ``limit`` records of each file as RECORD, or all; two are all that decides its fate.

    A null body is read as an empty file. Files are kept whole in one row, as they come from the inbox;
    this is a narrow step.
    """
    kinds = (pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.string())

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, offsets = [], [0]
            for text in batch.column(1).to_pylist():
                for line, problem, record in physical_records(text or "", limit):
                    rows.append((line, problem, *(read(record) if record is not None else [None] * 5), record))
                offsets.append(len(rows))
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            held = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.name for f in RECORD.fields])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held)], names=["key", "records"])

    kind = files.schema[key].dataType
    out = files.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInArrow(take, T.StructType([T.StructField("key", kind), T.StructField("records", T.ArrayType(RECORD))]))
    return out.withColumnRenamed("key", key)
