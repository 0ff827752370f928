"""The embedder hook: any function from texts to vectors, run on Arrow batches inside the tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

#: A row of numbers for each text.
Embedder = Callable[[list[str]], np.ndarray]
_WORD = re.compile(r"[^\W_]+")


def hashed_words(texts: list[str]) -> np.ndarray:
    """Counts of words by the first byte of their md5: deterministic, for tests and where no model is given."""
    found = np.zeros((len(texts), 256))
    for row, t in zip(found, texts, strict=True):
        np.add.at(row, [hashlib.md5(w.encode()).digest()[0] for w in _WORD.findall(t.lower())], 1.0)
    return found


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of the rows of a and b, rounded to 9 places; 0 for zero vectors."""
    size = np.sqrt(np.outer((a * a).sum(axis=1), (b * b).sum(axis=1)))
    return np.round(np.divide(a @ b.T, size, out=np.zeros(size.shape), where=size > 0), 9)


def _extended(df: DataFrame, name: str, kind, add: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.append_column(name, add(part))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, kind)]))


def embed(df: DataFrame, text: str, embedder: Embedder, name: str = "vector") -> DataFrame:
    """Add each row's vector; a null text is empty."""
    return _extended(df, name, ArrayType(DoubleType()), lambda part: pa.array([[float(x) for x in v] for v in embedder([t or "" for t in part.column(text).to_pylist()])], pa.list_(pa.float64())))


def closest(df: DataFrame, left: str, right: str, embedder: Embedder, name: str = "sims") -> DataFrame:
    """Add, for two columns of sentence lists, the highest cosine of each left sentence with any right one: one product of matrices for each row. Null where there is nothing on the right."""

    def add(part: pa.RecordBatch) -> pa.Array:
        out = []
        for a, b in zip(part.column(left).to_pylist(), part.column(right).to_pylist(), strict=True):
            out.append(cosines(embedder(a), embedder(b)).max(axis=1).tolist() if a and b else None)
        return pa.array(out, pa.list_(pa.float64()))

    return _extended(df, name, ArrayType(DoubleType()), add)


#: A sentence with its end, from the last end on.
_SENTENCE = re.compile(r"[^.!?]+[.!?]?")
ANCHOR = ArrayType(StructType([StructField("text", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("sim", DoubleType())]))


def anchors(df: DataFrame, text: str, context: str, embedder: Embedder, top: int = 3, least: int = 8, name: str = "anchors") -> DataFrame:
    """Add the `top` sentences of a text (of `least` characters or more) closest to the row's context, with their places (end exclusive), closest first, then in order."""

    def add(part: pa.RecordBatch) -> pa.Array:
        out = []
        for t, c in zip(part.column(text).to_pylist(), part.column(context).to_pylist(), strict=True):
            spans = [(m.group().strip(), m.start(), m.end()) for m in _SENTENCE.finditer(t or "")]
            spans = [s for s in spans if len(s[0]) >= least]
            sims = cosines(embedder([s for s, _, _ in spans]), embedder([c]))[:, 0] if spans and c else np.zeros(0)
            order = np.argsort(-sims, kind="stable")[:top].tolist()
            out.append([{"text": spans[k][0], "start": spans[k][1], "end": spans[k][2], "sim": float(sims[k])} for k in order])
        inner = pa.struct([("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sim", pa.float64())])
        return pa.array(out, pa.list_(inner))

    return _extended(df, name, ANCHOR, add)
