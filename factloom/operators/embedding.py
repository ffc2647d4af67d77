"""Text to vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import embedding_input, words


def hash_embedding(df: DataFrame, text: F.Column, dims: int = 64, out: str = "embedding") -> DataFrame:
    """Deterministic bag-of-words vectors of unit length; no model and no network.

    A token's slot is the first 16 bits of its MD5 modulo ``dims``. Tokens and slots are
    column expressions; only the slot numbers reach Python, a whole batch at a time.
    Texts without tokens get the zero vector.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def count(slots: pd.Series) -> pd.Series:
        sizes = slots.map(len).to_numpy()
        flat = np.concatenate(slots.to_numpy()) if sizes.sum() else np.empty(0, dtype=np.int64)
        cell = np.repeat(np.arange(len(slots)), sizes) * dims + flat.astype(np.int64)
        counts = np.bincount(cell, minlength=len(slots) * dims).reshape(-1, dims).astype(np.float64)
        lengths = np.linalg.norm(counts, axis=1, keepdims=True)
        return pd.Series(list((counts / np.where(lengths == 0, 1.0, lengths)).astype(np.float32)))

    tokens = words(F.lower(F.coalesce(text, F.lit(""))))
    slots = F.transform(
        tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"), F.lit(dims))
    )
    return df.withColumn(out, count(slots))


def encode_texts(
    df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "embedding"
) -> DataFrame:
    """Vectors from any model: ``encoder`` turns a list of texts into a matrix, per batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(encoder(batch.column(text).to_pylist()), dtype=np.float32)
            column = pa.array(list(vectors), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def embed_queries(queries: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None, dims: int = 64) -> DataFrame:
    """Add ``vec`` for the text in ``query``, with the model that the facts were embedded with."""
    return embed_text(queries, text="query", encoder=encoder, dims=dims).withColumnRenamed("embedding", "vec")


def embed_text(
    df: DataFrame,
    text: str = "text",
    title: str | None = None,
    encoder: Callable[[list[str]], np.ndarray] | None = None,
    dims: int = 64,
) -> DataFrame:
    """Add ``embedding`` computed from ``title: text`` (or the text alone)."""
    source = embedding_input(title, text) if title else F.col(text)
    if encoder is None:
        return hash_embedding(df, source, dims)
    return encode_texts(df.withColumn("_input", source), "_input", encoder).drop("_input")
