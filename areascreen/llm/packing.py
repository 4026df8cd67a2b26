"""Packing of token ids into sequences by power-of-two decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from areascreen.llm.bytetext import utf8
from areascreen.llm.common import text_batches
from areascreen.llm.tokens import held_tokenizer

#: Longest sequence in tokens; a power of two.
SEQUENCE = 2048
#: Low bits of a sequence id, which number the sequences of a bucket: 2**25 tasks of 2**33 pieces.
BUCKET_BITS = 58
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the binary digits of the rest, large first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = SEQUENCE) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, bucket, sequence_id, offset.

    A document's ids are its tokens and then ``end_id``. It is cut into pieces whose lengths are powers of two, so each
    piece fills a sequence of that length: no padding, and no sequence holds two documents. ``bucket`` is the binary
    logarithm of the length; a batch takes sequences of one bucket. The cut needs nothing but the document itself, so
    there is no shuffle: sequences are numbered within each bucket of each task, and the ids of one bucket are the range
    from ``bucket * 2**BUCKET_BITS`` up to the next. :func:`write_buckets` gathers equal lengths in files of their own.

    A null or empty text holds the end id alone. Null ids stay null; repeated rows are packed as often as they come.
    Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest sequence must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = held_tokenizer(tokenizer_path)
        for batch in text_batches(batches):
            ids, bounds = tokenizer.encode(*utf8(batch.column("text")))
            pieces: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for doc_id, first, last in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                own = np.append(ids[first:last], np.uint32(end_id)).astype("<u4").tobytes()
                tokens, start = last - first + 1, 0
                for length in piece_lengths(tokens, longest):
                    for column, value in zip(pieces, (doc_id, start, length, own[4 * start : 4 * (start + length)], tokens)):
                        column.append(value)
                    start += length
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(pieces, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, SCHEMA)
    bucket = F.length(F.bin("length")) - 1
    return rows.withColumns({
        "bucket": bucket, "sequence_id": F.shiftleft(bucket.cast("long"), BUCKET_BITS) + F.monotonically_increasing_id(),
        "offset": F.lit(0).cast("long"),
    })


def write_buckets(pieces: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``pieces`` (of :func:`pack`) as Parquet with one folder per bucket: sequences of one length, ready to batch.

    Every task writes a file per bucket that it meets, without a shuffle. A reader of one length filters on ``bucket``
    and reads that folder alone.
    """
    pieces.write.partitionBy("bucket").mode(mode).parquet(path)
