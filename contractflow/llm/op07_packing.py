"""Packing by power-of-two decomposition: no sequence crosses a document, and none is padded.

A document of n ids is cut into as many full sequences as it has room for, and what is left into pieces
whose lengths are the powers of two in its binary form, longest first.  Every piece is a sequence of its
own.  Sequences of equal length form a bucket and are numbered without gaps within it and, bucket after
bucket from the longest, over all; a training step takes its batch from one bucket.

A document's ids are those of its text, without added special tokens, and then ``end_id``.  Null text is
empty: a single piece that holds ``end_id``.  Rows with equal ids are packed row by row.  An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import number_within, text_of
from contractflow.llm.encoding import WordIds, give_back, held, packed, slices
from contractflow.storage import cut_lineage, ship_package

LENGTH = 2048
END_ID = 1
# Bytes of text that one step works on; the more, the fewer words are looked up twice.
SLICE_BYTES = 2 << 20


def binary_lengths(n: int, longest: int) -> list[int]:
    """Full sequences, then the powers of two of the rest, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]


def split_documents(docs: DataFrame, path: str, longest: int, end_id: int, with_ids: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), ids_crc32, doc_tokens, and the columns ``carry``."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the length of a sequence must be a power of two")
    ship_package(docs.sparkSession)
    types = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    names = [n for n, _ in types] + ["ids"] * with_ids

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(("packed words", path), lambda: WordIds(path))
        end = pa.array([packed([end_id])], pa.large_binary())
        for batch in batches:
            for first, stop in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, stop - first)
                # ASCII white space parts words for this tokenizer, which drops it
                texts = pc.ascii_split_whitespace(part.column("text"))
                own = texts.flatten().dictionary_encode()
                ends = np.cumsum(texts.value_lengths().to_numpy())
                # the end's id stands behind the words of each text
                order = np.insert(own.indices.to_numpy(), ends, len(own.dictionary))
                ids = pa.concat_arrays([words.ids(own.dictionary), end]).take(pa.array(order))
                _, bounds, data = ids.buffers()
                bounds = np.frombuffer(bounds, np.int64)[ids.offset :][ends + np.arange(1, len(ends) + 1)]
                view, begin, pieces, out = memoryview(data), 0, [], []
                for doc_id, bound in zip(part.column("doc_id").to_pylist(), bounds.tolist()):
                    n, at = (bound - begin) // 4, 0
                    for length in binary_lengths(n, longest):
                        out.append((doc_id, at, length, zlib.crc32(view[begin + 4 * at : begin + 4 * (at + length)]), n))
                        at += length
                    begin = bound
                    pieces.append(len(out))
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out), types)]
                if with_ids:
                    # the pieces lie one behind the other; an array made of views of them would never give up what they show
                    cuts = pa.array(np.cumsum([0, *(4 * p[2] for p in out)])).cast(pa.int32())
                    columns.append(pa.Array.from_buffers(pa.binary(), len(out), [None, cuts.buffers()[1], data]))
                of = pa.array(np.repeat(np.arange(len(part)), np.diff(pieces, prepend=0)))
                columns += [part.column(2 + i).take(of) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays(columns, [*names, *carry])
        give_back()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *carry)
    schema = ", ".join(f"{n} long" for n, _ in types) + ", ids binary" * with_ids
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema[2:])
    return source.mapInArrow(split, schema)


def pack(
    docs: DataFrame, path: str, longest: int = LENGTH, end_id: int = END_ID, with_ids: bool = True, carry: tuple[str, ...] = ()
) -> DataFrame:
    """The pieces with sequence_id, and offset in it (always 0); sequence_id has no gaps.

    ``carry`` names columns of the documents that their pieces keep; they must not be called like one of a piece.

    The pieces are stored before they are numbered, so every text is encoded once.
    """
    pieces = cut_lineage(split_documents(docs, path, longest, end_id, with_ids, carry).withColumn("row", F.monotonically_increasing_id()))
    buckets = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    numbered = number_within(pieces, "length", "in_bucket", F.col("row"), sum(buckets.values()), 5_000 if with_ids else 100_000)
    first, cases = 0, []
    for length in sorted(buckets, reverse=True):
        cases.append(f"when {length} then {first}L")
        first += buckets[length]
    start = f"case length {' '.join(cases)} end" if cases else "0L"
    return numbered.withColumn("sequence_id", F.expr(f"{start} + in_bucket")).withColumn("offset", F.lit(0).cast("long")).drop(
        "row", "in_bucket"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
