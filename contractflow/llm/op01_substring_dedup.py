"""Substring deduplication: seeds at winnowed anchors, extended to both sides.

A window is WINDOW consecutive words of one document.  A word goes if it lies in a window whose words also
start earlier: in a document that comes before, or earlier in the same one.  Windows are judged on the
input.

Seed.  Of every window the least hash among its word ANCHOR-grams is its anchor, so equal windows have the
same anchor at the same place.  Windows that follow each other and share an anchor form a segment; it is
the anchor extended both ways as far as its windows reach.  One row per segment is shuffled by anchor.

Extend.  A segment that is equal to an earlier one is a repeat with all its windows.  Among first
occurrences, an anchor with a single segment is settled.  Where an anchor has different segments, which
happens at the ends of repeats, windows are compared one by one: those of the first occurrences are enough,
as every other segment has its windows there, earlier.  Overlapping repeats of a document add up to maximal
ones.

Skew.  Every task first settles repeats among its own rows, so a passage in a third of all documents is one row
per task.  An anchor with many different segments in one task sends two of them as witnesses by anchor; the
others need no comparison there, are known to be unsettled and are dealt out by their own hash.

Words are runs other than ASCII white space, unchanged.  Null text has none.  Documents come in order of doc_id,
nulls last; where ids repeat or are null, in order of a hash of the text, and rows equal in both are one
document, whose windows are no earlier than themselves.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import text_of
from contractflow.llm.encoding import slices
from contractflow.storage import cut_lineage, ship_package

WINDOW = 20
ANCHOR = 8
# different segments of one anchor in one batch from which on only witnesses go by anchor
MANY = 64
MAX_WORDS = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
LAST = (1 << 63) - 1
# what is to be done with a row: compare it, take it as a repeat, compare its windows
OPEN, REPEAT, UNSETTLED = range(3)
COLUMNS = ["key", "anchor", "body", "doc", "part", "start", "stop", "state"]
SCHEMA = "key long, anchor long, body long, doc long, part long, start int, stop int, state int"


class Codes(dict):
    """Word -> 64-bit hash; forgets all when it holds MAX_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


class Powers:
    """Powers of an odd number modulo 2^64, and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.full(size, b, dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
            for powers in (self.up, self.down):
                powers[0] = 1
                powers.cumprod(out=powers)
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class Document:
    """Hashes of the words of a text, of their runs, and the anchors of its windows."""

    def __init__(self, words: list[bytes], codes: Codes, powers: Powers, window: int, anchor: int):
        self.window = window
        c = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
        up, self.down = powers.to(len(c) + 1)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(c * up[:-1], dtype=np.uint64)))
        grams = np.zeros(len(c) - anchor + 1, dtype=np.uint64)
        for k in range(anchor):
            grams = mixed(grams + c[k : k + len(grams)])
        self.grams, self.reach = grams, window - anchor + 1

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words from start to stop."""
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, first word and end of every segment."""
        views = np.lib.stride_tricks.sliding_window_view(self.grams, self.reach)
        place = np.arange(len(views)) + views.argmin(axis=1)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(views)])) - 1
        return self.grams[place[first]], first, last + self.window

    def anchors(self, starts: np.ndarray) -> np.ndarray:
        """Anchor hash of the windows at the given starts."""
        return np.lib.stride_tricks.sliding_window_view(self.grams, self.reach)[starts].min(axis=1)


def settle(rows: dict[str, np.ndarray], many: int) -> dict[str, np.ndarray]:
    """Settle repeats among the rows of one batch and choose where each row goes."""
    order = np.lexsort((rows["start"], rows["part"], rows["doc"], rows["body"], rows["anchor"]))
    r = {k: v[order] for k, v in rows.items()}
    n = len(order)
    if not n:
        return r | {"key": np.zeros(0, dtype=np.int64), "state": np.zeros(0, dtype=np.int32)}
    new_anchor = np.concatenate(([True], r["anchor"][1:] != r["anchor"][:-1]))
    new_body = new_anchor | np.concatenate(([True], r["body"][1:] != r["body"][:-1]))
    group = np.cumsum(new_body) - 1
    head = np.flatnonzero(new_body)[group]
    repeat = (r["doc"] != r["doc"][head]) | (r["part"] != r["part"][head]) | (r["start"] != r["start"][head])
    anchor_of = np.cumsum(new_anchor) - 1
    bodies = np.bincount(anchor_of, weights=new_body).astype(np.int64)
    # place of the row's body among the bodies of its anchor
    nth = group - group[np.flatnonzero(new_anchor)[anchor_of]]
    state = np.where(repeat, REPEAT, np.where((bodies[anchor_of] > many) & (nth >= 2), UNSETTLED, OPEN)).astype(np.int32)
    own = mixed(r["doc"].view(np.uint64) + mixed(r["start"].astype(np.uint64))).view(np.int64)
    key = np.where(state == OPEN, r["anchor"], own)
    keep = np.ones(n, dtype=bool)
    keep[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["start"][1:] != r["start"][:-1]) | (r["part"][1:] != r["part"][:-1]) | new_body[1:]
    return {k: v[keep] for k, v in (r | {"key": key, "state": state}).items()}


def merged_repeats(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Join overlapping repeats of a document; other rows stay as they are."""
    done = rows["state"] == REPEAT
    some = {k: v[done] for k, v in rows.items()}
    order = np.lexsort((some["start"], some["part"], some["doc"]))
    some = {k: v[order] for k, v in some.items()}
    if len(order):
        # starts and stops both ascend within a document
        new = np.ones(len(order), dtype=bool)
        new[1:] = (some["doc"][1:] != some["doc"][:-1]) | (some["part"][1:] != some["part"][:-1]) | (some["start"][1:] > some["stop"][:-1])
        first = np.flatnonzero(new)
        stop = np.maximum.reduceat(some["stop"], first)
        some = {k: v[first] for k, v in some.items()} | {"stop": stop}
    return {k: np.concatenate((v[~done], some[k])) for k, v in rows.items()}


def as_batch(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    types = {"start": pa.int32(), "stop": pa.int32(), "state": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(rows[c], types.get(c, pa.int64())) for c in COLUMNS], COLUMNS)


def gathered(parts: list[tuple]) -> dict[str, np.ndarray]:
    """Columns anchor, body, start, stop, doc, part of the parts of many documents."""
    kinds = {"anchor": np.int64, "body": np.int64, "start": np.int32, "stop": np.int32, "doc": np.int64, "part": np.int64}
    if not parts:
        return {k: np.zeros(0, dtype=t) for k, t in kinds.items()}
    sizes = [len(p[0]) for p in parts]
    out = {}
    for k, name in enumerate(kinds):
        if k < 2:
            out[name] = np.concatenate([p[k] for p in parts]).view(np.int64)
        elif k < 4:
            out[name] = np.concatenate([p[k] for p in parts]).astype(np.int32)
        else:
            out[name] = np.repeat(np.array([p[k] for p in parts], dtype=np.int64), sizes)
    return out


def seeds(docs: DataFrame, window: int, anchor: int, many: int) -> DataFrame:
    """The segments of all documents (doc, part, text), repeats within a batch settled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, powers = Codes(), Powers()
        for batch in batches:
            parts = []
            for doc, part, text in zip(batch.column("doc").to_pylist(), batch.column("part").to_pylist(), batch.column("text")):
                words = text.as_py().encode().split()
                if len(words) < window:
                    continue
                d = Document(words, codes, powers, window, anchor)
                anchors, start, stop = d.segments()
                parts.append((anchors, d.runs(start, stop), start, stop, doc, part))
            yield as_batch(merged_repeats(settle(gathered(parts), many)))

    return docs.select("doc", "part", "text").mapInArrow(cut, SCHEMA)


def compared(rows: DataFrame) -> DataFrame:
    """doc, part, start, stop, state after comparing all open rows by anchor and body.

    Open rows that are first of their body become UNSETTLED if their anchor has other bodies, and are left
    out if not; the others are repeats.
    """
    dealt = rows.repartition("key").sortWithinPartitions("key", "anchor", "body", "doc", "part", "start")
    same = "partition by key, anchor, body order by doc, part, start"
    judged = dealt.selectExpr(
        "doc", "part", "start", "stop", "state",
        f"first_value(doc) over ({same}) as d", f"first_value(part) over ({same}) as p", f"first_value(start) over ({same}) as s",
        "min(if(state = 0, body, null)) over (partition by key, anchor) as low", "max(if(state = 0, body, null)) over (partition by key, anchor) as high",
    )
    first = "d = doc and p = part and s = start"
    state = f"case when state <> {OPEN} then state when not ({first}) then {REPEAT} when low < high then {UNSETTLED} end"
    return judged.selectExpr("doc", "part", "start", "stop", f"{state} as state").where("state is not null")


def window_seeds(docs: DataFrame, wanted: DataFrame, window: int, anchor: int) -> DataFrame:
    """The single windows of unsettled segments, repeats within a batch settled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, powers = Codes(), Powers()
        for batch in batches:
            parts = []
            for doc, part, text, spans in zip(
                batch.column("doc").to_pylist(), batch.column("part").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()
            ):
                d = Document(text.as_py().encode().split(), codes, powers, window, anchor)
                starts = np.unique(np.concatenate([np.arange(s["start"], s["stop"] - window + 1) for s in spans]))
                parts.append((d.anchors(starts), d.runs(starts, starts + window), starts, starts + window, doc, part))
            # a body here is one window; different windows of an anchor need no comparison with each other
            rows = gathered(parts)
            rows["anchor"], rows["body"] = mixed(rows["anchor"].view(np.uint64) + mixed(rows["body"].view(np.uint64))).view(np.int64), rows["body"]
            yield as_batch(merged_repeats(settle(rows, 1)))

    spans = wanted.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.select("doc", "part", "text").join(spans, ["doc", "part"]).mapInArrow(cut, SCHEMA)


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, many: int = MANY) -> DataFrame:
    """doc, part, spans: the repeats of every document that has any; word positions, ends exclusive."""
    found = cut_lineage(compared(seeds(docs, window, anchor, many)))
    wanted = found.where(F.col("state") == UNSETTLED)
    more = compared(window_seeds(docs, wanted, window, anchor)).where(F.col("state") == REPEAT)
    spans = found.where(F.col("state") == REPEAT).unionByName(more)
    return spans.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, doc, part, text: (doc, part) is the place in the order of documents.

    ``part`` is only needed, and filled, where ids repeat or are null.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids")).first()
    plain = ids["rows"] == ids["ids"] and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        (F.lit(0).cast("long") if plain else F.xxhash64(text_of())).alias("part"),
        text_of().alias("text"),
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, many: int = MANY) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    ship_package(docs.sparkSession)
    placed = ordered(docs)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in slices(batch.column("text")):
                part = batch.slice(first, end - first)
                out = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    words = text.encode().split()
                    stays = np.ones(len(words), dtype=bool)
                    for s in spans or ():
                        stays[s["start"] : s["stop"]] = False
                    kept = words if not spans else list(compress(words, stays.tolist()))
                    out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
                n_words, n_removed, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    found = repeats(placed, window, anchor, many)
    joined = placed.join(found, ["doc", "part"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
