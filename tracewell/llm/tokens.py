"""Sizes of texts in tokens of a public tokenizer.

The tokenizer's file is a parameter; tokenizers are used as they are, never trained. Each Python worker
loads it once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the tokenizers' files lie, unless the caller names another place.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that byte-level BPE vocabularies of this family split texts with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are counted in stretches of about so many characters, which end where the pattern splits whatever follows: before a space or line's end, or between a letter and a digit.
_STRETCH = 200_000
_SPLIT = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def _stretches(text: str) -> Iterator[str]:
    """``text`` in pieces that have the same tokens as the whole; one that can't be split there stays whole."""
    at = 0
    while len(text) - at > _STRETCH and (m := _SPLIT.search(text, at + _STRETCH)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(maxsize=4)
def _counter(path: str):
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    kind = Path(path).suffix
    if kind == ".tiktoken":
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: sum(len(encoding.encode_ordinary(x)) for x in _stretches(text))
    if kind == ".model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False))


def count_tokens(text: str | None, path: str = DEFAULT_TOKENIZER) -> int:
    """Tokens of ``text``; 0 for null. Special tokens' spellings count as ordinary text."""
    if not text:
        return 0
    return _counter(path)(text)


def with_tokens(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; a narrow step that reads no other columns. Null texts have 0 tokens."""
    fields = [df.schema[c] for c in keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(t, path) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, F.col(text).alias("counted text")).mapInArrow(count, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))
