"""Packing by power-of-two decomposition.

Each document's ids, an end id after them, are cut into pieces whose lengths are the powers of two in the binary form of
the document's length, none above ``limit``, longest first.  Pieces of one length form one bucket; each piece is a
sequence by itself, so no sequence crosses documents and none needs padding (Pouransari et al., Dataset Decomposition,
2024).

Defined results: a null or empty text is the end id alone, one piece of length 1; repeated rows are packed each on their
own; other columns of the input are not carried, so clashing names do no harm; an empty table gives no pieces.  A piece's
``sequence_id`` is unique in the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk

#: Longest piece, the id that ends each document, and the pieces after which a batch of results is handed on.
LIMIT, END, FLUSH = 1024, 0, 1 << 20


def lengths(n: int, limit: int = LIMIT) -> list[int]:
    """The piece lengths of ``n`` ids, longest first."""
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 2, -1, -1) if (n % limit) >> b & 1]


def pack(documents: DataFrame, limit: int = LIMIT, end: int = END, vocabulary: str | None = None, with_ids: bool = True, text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket`` and ``ids``.

    ``bucket`` is log2 of the length; write the result partitioned by it to train on sequences of one length at a time.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    shared = tk.share(documents.sparkSession, vocabulary)
    source = documents.select(F.col("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tk.encoder(shared, added=True)
        for batch in batches:
            out: list[tuple] = []
            row, at, held = [], [], 0

            def flush(names=("start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"), batch=batch):
                cols = list(zip(*out))
                arrays = [batch.column(0).take(pa.array(row, pa.int64()))]
                arrays += [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.int32())]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(cols[1]))).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(at).view(np.int32))))
                return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names[: 5 + with_ids]])

            for i, text_ in enumerate(batch.column(1)):
                got = np.append(tk.ids(encode, text_.as_py()), np.uint32(end)).astype("<u4")
                body, start = memoryview(got).cast("B"), 0
                for n in lengths(len(got), limit):
                    out.append((start, n, zlib.crc32(body[4 * start : 4 * (start + n)]), len(got), n.bit_length() - 1))
                    row.append(i)
                    start += n
                if with_ids:
                    at.append(got)
                held += len(got)
                if held >= FLUSH:
                    yield flush()
                    out, row, at, held = [], [], [], 0
            if out:
                yield flush()

    pieces = source.mapInArrow(cut, schema)
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *["ids"] * with_ids,
    )
