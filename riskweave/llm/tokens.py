"""Encoding a corpus and counting its tokens (problem 6, and the sizes of problems 7 and 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import DEFAULT_VOCAB, codec, ship


def _slices(batch: pa.RecordBatch, text: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no slice holds much more text than max_bytes (one row at least)."""
    column = batch.column(text)
    if batch.num_rows == 0 or column.nbytes <= max_bytes:
        yield batch
        return
    rows = max(1, int(batch.num_rows * max_bytes / column.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(key, ids) of every row: the ids of `text` in the vocabulary, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are
    ordinary text; repeated rows give repeated results; an empty table an empty result;
    other columns are not read. Nothing is shuffled: each partition is encoded where it is read.
    """

    ship(df.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(vocab).encode
        for whole in batches:
            for batch in _slices(whole, "text"):
                ids = [encode(t) for t in batch.column("text").to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                values = np.concatenate([np.frombuffer(x, np.int32) for x in ids if x]) if offsets[-1] else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], names=["key", "ids"]
                )

    source = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """The `keep` columns of every row and n_tokens, the length of its encoding (0 for null and empty texts)."""

    ship(df.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = codec(vocab).count
        for whole in batches:
            for batch in _slices(whole, "__text"):
                sizes = pa.array([count(t) for t in batch.column("__text").to_pylist()], pa.int64())
                kept = [batch.column(name) for name in batch.schema.names if name != "__text"]
                yield pa.RecordBatch.from_arrays([*kept, sizes], names=[*(n for n in batch.schema.names if n != "__text"), "n_tokens"])

    source = df.select(*keep, df[text].alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")
    return source.mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode_ids(df: DataFrame, keep: list[str], ids: str = "ids", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """The `keep` columns of every row and decoded, the text of its ids (null ids give an empty text)."""

    ship(df.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(vocab).decode
        for batch in batches:
            texts = pa.array([decode(x or ()).decode("utf-8", "replace") for x in batch.column("__ids").to_pylist()], pa.string())
            kept = [n for n in batch.schema.names if n != "__ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), texts], names=[*kept, "decoded"])

    source = df.select(*keep, df[ids].alias("__ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__ids")
    return source.mapInArrow(run, f"{kinds}, decoded string")
