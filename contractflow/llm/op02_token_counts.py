"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A document of up to ``limit`` characters is encoded by one task.  A longer one is cut into chunks that
overlap, the chunks are spread over the tasks and encoded with offsets, and neighbours are spliced:

* The tokenizer cuts a text from left to right and never looks back, so from the start of a cut on, its
  behaviour depends on nothing before it.  A position that starts a cut in both neighbours is therefore a
  proven common boundary, if the left chunk saw enough text behind it (MARGIN characters: what can still
  change a cut is one character of lookahead, or a special string that the chunk's end has broken).
* Tokens of the left chunk count up to the first such position, those of the right chunk from there on.
* Documents in which two neighbours have no such position are cut again with a wider overlap, and again,
  until the overlap covers the document; then it is encoded as a whole, which is the only right way for
  a text without any inner boundary.

Null text is empty and has no tokens.  Special strings inside a text are handled as the tokenizer does.
Rows with equal ids are counted row by row.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import text_of
from contractflow.llm.encoding import SpacedCounts, held, load, slices
from contractflow.storage import cut_lineage, ship_package

LIMIT = 65_536
OVERLAP = 256
WIDEN = 16
MARGIN = 32
MAX_TOKENS = 1024

def whole_counts(docs: DataFrame, path: str) -> DataFrame:
    """row, doc_id, n_bytes, n_tokens for documents that one task encodes as a whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("spaced counts", path), lambda: SpacedCounts(path))
        for batch in batches:
            for start, end in slices(batch.column("text")):
                part = batch.slice(start, end - start)
                n = pa.array(counter.counts(part.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "n_bytes", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def cut_chunks(docs: DataFrame, step: int, overlap: int) -> DataFrame:
    """row, chunk, last, start, text: every chunk begins ``step`` characters after the one before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                text = text.as_py()
                last = max(0, -(-(len(text) - overlap) // step) - 1)
                for k in range(last + 1):
                    begin = k * step
                    piece = text[begin : begin + step + overlap] if k < last else text[begin:]
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row, "chunk": k, "last": k == last, "start": begin, "text": piece}],
                        schema=pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("start", pa.int64()), ("text", pa.string())]),
                    )

    return docs.select("row", "text").mapInArrow(cut, "row long, chunk int, last boolean, start long, text string")


def encode_chunks(chunks: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """row, chunk, last, n and, for both overlaps, the starts of cuts with the tokens before each."""
    schema = "row long, chunk int, last boolean, n long, head map<bigint,bigint>, tail map<bigint,bigint>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        types = pa.schema(
            [("row", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("n", pa.int64())]
            + [(x, pa.map_(pa.int64(), pa.int64())) for x in ("head", "tail")]
        )
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                found = tokenizer.encode(r["text"], add_special_tokens=False)
                words, offsets = found.word_ids, found.offsets
                head, tail, seen_to = [], [], len(r["text"]) - MARGIN
                for t, (begin, _) in enumerate(offsets):
                    if step > begin >= overlap:
                        continue
                    if t and words[t] is not None and words[t] == words[t - 1]:
                        continue
                    if begin < overlap and r["chunk"]:
                        head.append((r["start"] + begin, t))
                    elif begin >= step and begin <= seen_to and not r["last"]:
                        tail.append((r["start"] + begin, t))
                out = {k: r[k] for k in ("row", "chunk", "last")} | {"n": len(words), "head": head, "tail": tail}
                yield pa.RecordBatch.from_pylist([out], schema=types)

    return chunks.mapInArrow(encode, schema)


def spliced_counts(encoded: DataFrame) -> DataFrame:
    """row, n_tokens; null where two neighbours have no common boundary."""
    left = encoded.where("not last").select("row", "chunk", "tail")
    right = encoded.where("chunk > 0").select("row", (F.col("chunk") - 1).alias("chunk"), "head")
    common = F.array_min(F.array_intersect(F.map_keys("tail"), F.map_keys("head")))
    seams = left.join(right, ["row", "chunk"]).withColumn("at", common).select(
        "row", F.expr("tail[at] - head[at]").alias("n"), F.col("at").isNull().cast("int").alias("failed")
    )
    ends = encoded.where("last").select("row", "n", F.lit(0).alias("failed"))
    # sums only: a document of many chunks is added up before the shuffle
    return seams.unionByName(ends).groupBy("row").agg(F.sum("n").alias("n"), F.max("failed").alias("failed")).select(
        "row", F.when(F.col("failed") == 0, F.col("n")).alias("n_tokens")
    )


def huge_counts(huge: DataFrame, path: str, limit: int, overlap: int) -> DataFrame:
    """row, n_tokens of a stored table of documents (row, text), encoded in overlapping chunks."""
    done = None
    pending = huge
    while True:
        step = max(limit // 2, 2 * overlap)
        chunks = cut_chunks(pending, step, overlap).repartition("row", "chunk")
        counted = cut_lineage(spliced_counts(encode_chunks(chunks, path, step, overlap)))
        found = counted.where("n_tokens is not null")
        done = found if done is None else done.unionByName(found)
        failed = counted.where("n_tokens is null").select("row")
        if failed.isEmpty():
            return done
        pending = cut_lineage(pending.join(failed, "row", "left_semi"))
        overlap *= WIDEN


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens.  ``path`` is a byte-level BPE tokenizer's file."""
    ship_package(docs.sparkSession)
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text")
    )
    short = whole_counts(read.where(F.length("text") <= limit), path)
    huge = cut_lineage(read.where(F.length("text") > limit).withColumn("row", F.monotonically_increasing_id()))
    counts = huge_counts(huge.select("row", "text"), path, limit, overlap)
    return short.unionByName(huge.select("row", "doc_id", "n_bytes").join(counts, "row").drop("row"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)
