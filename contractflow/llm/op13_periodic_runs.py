"""Periodic run detection with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q that cannot be extended keeping q, of at least
TIMES periods and LEAST words.

Dictionary.  The factors of length 1, 2, 4, ... of a document get names, equal factors equal ones; a name of
twice the length is the pair of the names of its halves, so names are exact and nothing is compared by hash.
Factors that occur once are left out of all longer lengths, so that prose without repeats is finished after
a few lengths.

Propose.  Within a run of period q, a factor of length L >= q next occurs exactly q further (were it nearer,
the run would have a smaller period).  So occurrences of one name with equal gaps are arithmetic
progressions, and a gap q <= L proposes period q.

Extend.  Neighbouring factors with the same gap are one run: it starts with the first and ends q words after
the end of the last, and the word before or behind it breaks the period.

Deduplicate.  Every length of q or more proposes the same run.  It is taken from the least one, L/2 < q <= L.

Words are runs other than ASCII white space, unchanged.  Null and empty texts have no words and no runs.  A
document's result depends on its row alone, so equal rows get equal results, and null ids are as good as others.
Documents are worked on in batches by size; a very long one stands alone, and memory is that of one document.  An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import text_of
from contractflow.llm.encoding import slices
from contractflow.storage import ship_package

LEAST = 24
TIMES = 3
MAX_WORDS = 500_000
SLICE_BYTES = 4 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Codes(dict):
    """Word -> number in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def neighbours_as_runs(at: np.ndarray, period: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, words and period of the stretches of consecutive positions with one period."""
    if not len(at):
        return at, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] - at[first] + length + period[first], period[first]


def basic_factor_runs(key: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) by start, then period.

    ``key`` has a number per word; words of different documents differ, so no factor that spans two
    documents occurs twice.  ``longest`` is the number of words of the longest document.
    """
    at = np.arange(len(key))
    name = np.full(len(key), -1, dtype=np.int64)
    found = [np.zeros((0, 3), dtype=np.int64)]
    length = 1
    while len(at) and length // 2 < longest // times:
        # occurrences of each name, one after the other
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        gap = np.zeros(len(at), dtype=np.int64)
        gap[order[:-1]] = np.where(same, at[order[1:]] - at[order[:-1]], 0)
        proposed = (gap > length // 2) & (gap <= length)
        start, words, period = neighbours_as_runs(at[proposed], gap[proposed], length)
        enough = words >= np.maximum(least, times * period)
        found.append(np.stack((start[enough], words[enough], period[enough]), axis=1))

        repeated = np.zeros(len(at), dtype=bool)
        repeated[order[1:]] |= same
        repeated[order[:-1]] |= same
        number = np.empty(len(at), dtype=np.int64)
        number[order] = np.concatenate(([0], np.cumsum(~same)))
        name[at] = np.where(repeated, number, -1)
        alive = at[repeated]
        alive = alive[: np.searchsorted(alive, len(name) - length)]
        halves = alive[name[alive + length] >= 0]
        key = name[halves] * (int(number.max()) + 1) + name[halves + length]
        # what does not go on must not be taken for a half of the next length
        name[at] = -1
        at, length = halves, 2 * length
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_by_document(documents: list[list[bytes]], codes: Codes, least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Runs of each document of a batch, by start, then period; starts count from its first word."""
    if len(codes) > MAX_WORDS:
        codes.clear()
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    total = int(sizes.sum())
    code = np.fromiter((codes[w] for d in documents for w in d), dtype=np.int64, count=total)
    key = np.repeat(np.arange(len(documents)), sizes) * (len(codes) + 1) + code
    runs = basic_factor_runs(key, int(sizes.max(initial=0)), least, times)
    begins = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(runs[:, 0], begins)
    out = np.split(runs, cuts[1:])
    for part, begin in zip(out, begins.tolist()):
        part[:, 0] -= begin
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if len(runs):
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = compress(words, (np.cumsum(change)[:-1] == 0).tolist())
    return b" ".join(words)


def periodic_runs(
    docs: DataFrame,
    least: int = LEAST,
    times: int = TIMES,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period, by start and period), collapsed.

    ``prepare`` gets id and words of a document and returns the words to search.  ``times`` is 3 at least: a run
    of less may be too short to hold a factor and its next occurrence.
    """
    if times < 3:
        raise ValueError("a run has at least three periods")
    ship_package(docs.sparkSession)
    columns = {"doc_id": pa.int64(), "n_words": pa.int64(), "runs": pa.list_(RUN), "collapsed": pa.string()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for first, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, end - first)
                ids = part.column("doc_id").to_pylist()
                words = [t.as_py().encode().split() for t in part.column("text")]
                if prepare:
                    words = [prepare(i, w) for i, w in zip(ids, words)]
                runs = runs_by_document(words, codes, least, times)
                rows = np.concatenate(runs) if runs else np.zeros((0, 3), dtype=np.int64)
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), structs),
                        pa.array([collapsed(w, r).decode() for w, r in zip(words, runs)], pa.string()),
                    ],
                    schema=pa.schema(list(columns.items())),
                )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return read.mapInArrow(
        search, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a repeat planted where the id asks for one; a null id asks for none."""
    if doc_id is None or not words:
        return words
    g, chosen = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if chosen:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs, prepare=planted)
    # runs come by start, then period, so the first of the greatest stays
    best = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.selectExpr("doc_id", "runs", f"{best} as best", "sha2(collapsed, 256) as collapsed_sha256").selectExpr(
        "doc_id",
        "cast(size(runs) as bigint) as n_runs",
        "best.start as start",
        "best.length as length",
        "best.period as period",
        "1000 * best.length div best.period as exponent_milli",
        f"sha2({listed}, 256) as runs_sha256",
        "collapsed_sha256",
    )
