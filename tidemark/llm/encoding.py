"""Encoding of a corpus with a vocabulary of public tokenizers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import encoder

TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
#: Bytes of text that are encoded at once; a longer text is encoded alone, whole.
BYTES_AT_ONCE = 4 << 20


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The path of a vocabulary file of byte tokens and ranks."""
    return f"{folder or TOKENIZERS}/{name}.tiktoken"


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > BYTES_AT_ONCE:
            yield start, i
            start, held = i, 0
        held += size
    yield start, len(sizes)


def encode_texts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, ids: str | None = "ids", count: str | None = None) -> DataFrame:
    """The columns `keep` with the token ids of `text` and/or their number.

    Ordinary encoding: strings that look like special tokens are text. Null
    and empty texts give an empty list and the number 0. Texts are encoded
    whole, whatever their length. No shuffle; only the columns named are read.
    Column names may repeat those of the result only if they are not kept.
    """
    path = path or vocabulary()
    clash = {ids, count} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with the result: {sorted(clash)}")
    held = "__text"
    while held in keep:
        held += "_"
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(held))
    schema = T.StructType([source.schema[c] for c in keep])
    if ids:
        schema.add(ids, T.ArrayType(T.IntegerType(), False), False)
    if count:
        schema.add(count, T.LongType(), False)

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in _slices(texts):
                flat, counts = coder.encode(texts.slice(a, b - a))
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                if count:
                    arrays.append(pa.array(counts))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def decode_ids(df: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` with the text of each list of ids; a null list gives null, bytes that are no UTF-8 the replacement sign."""
    path = path or vocabulary()
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids}`").alias("__ids"))
    schema = T.StructType([source.schema[c] for c in keep]).add(text, T.StringType())

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            lists = batch.column(len(keep)).to_pylist()
            texts = [None if x is None else coder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
