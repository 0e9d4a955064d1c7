"""A quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pairs cost no more than the
single features, as they are half of the sum over factors of (sum v_if x_i)^2 - sum v_if^2 x_i^2.

Features are log counts of words hashed into BUCKETS buckets, scaled to unit length, and statistics of
the whole text: length and shares of characters, words and lines.  Metadata is ``n_chars``, the length that the table
states, and how far it is from the text's; null or missing counts as not stated.  Labels, language, source and id are
never features.  The model is fitted on a bounded sample: of the labelled ids that the table holds, the SAMPLE_ROWS
with the least hash.  An id with several labels counts with the least, one with several texts with that of least
hash, so the model does not change from run to run.  It has a fixed size and travels with the job.  Every text is
scored to its end, empty and null ones too; repeated rows get equal scores.  Without any label every score is 0.5; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import crc32_of_id, text_of
from contractflow.llm.encoding import slices
from contractflow.storage import ship_package

BUCKETS = 4096
FACTORS = 6
SAMPLE_ROWS = 4000
EPOCHS = 30
THRESHOLD = 0.3
MAX_WORDS = 500_000
STATISTICS = (
    "log_bytes", "log_words", "upper", "digit", "punctuation", "space", "non_ascii", "word_length",
    "distinct_words", "commonest_word", "repeated_lines", "words_per_line", "symbol_words", "longest_word",
    "stated_chars", "stated_wrongly",
)

PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


class Buckets(dict):
    """Word -> bucket; forgets all when it holds MAX_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word.lower()) % BUCKETS
        if len(word) <= 64:
            self[word] = found
        return found


def features(text: str, buckets: Buckets, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that occur, their values, and the statistics of a text and of its metadata."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    counts = np.bincount(np.fromiter(map(buckets.__getitem__, words), dtype=np.int64, count=len(words)), minlength=1)
    index = np.flatnonzero(counts)
    value = np.log1p(counts[index])
    value = value / max(1e-9, float(np.sqrt((value * value).sum())))
    per_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, w = max(1, len(raw)), max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tally = Counter(words)
    symbol_words = sum(c for x, c in tally.items() if PUNCTUATION[x[-1]] and (len(x) < 2 or PUNCTUATION[x[-2]]))
    statistics = [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        per_byte[65:91].sum() / n,
        per_byte[48:58].sum() / n,
        per_byte[PUNCTUATION].sum() / n,
        (per_byte[9:14].sum() + per_byte[32]) / n,
        per_byte[128:].sum() / n,
        len(raw) / w / 10,
        len(tally) / w,
        max(tally.values(), default=0) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(w / max(1, len(lines))),
        symbol_words / w,
        np.log1p(max(map(len, tally), default=0)),
        np.log1p(max(0, n_chars or 0)),
        0.0 if n_chars is None else min(1.0, abs(n_chars - len(text)) / max(1, len(text))),
    ]
    return index, value, np.array(statistics)


class Machine:
    """The fitted model."""

    def __init__(self, w0, w, v, mean, scale):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale
        self.squares = (v * v).sum(axis=1)

    def score(self, index: np.ndarray, value: np.ndarray, statistics: np.ndarray) -> float:
        x = np.concatenate([value, np.clip((statistics - self.mean) / self.scale, -4, 4)])
        at = np.concatenate([index, BUCKETS + np.arange(len(STATISTICS))])
        summed = x @ self.v[at]
        z = self.w0 + x @ self.w[at] + 0.5 * (summed @ summed - (x * x) @ self.squares[at])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list, seed: int = 7) -> Machine | None:
    """Adam on minibatches of the sample; ``rows`` have index, value, statistics (float bytes) and label."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    labels = np.array([r["label"] for r in rows], dtype=np.float32)
    statistics = np.array([np.frombuffer(r["statistics"]) for r in rows])
    mean, scale = statistics.mean(axis=0), statistics.std(axis=0) + 1e-3
    size = BUCKETS + len(STATISTICS)
    x = np.zeros((len(rows), size), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["index"], dtype=np.int64)] = np.frombuffer(r["value"])
    x[:, BUCKETS:] = np.clip((statistics - mean) / scale, -4, 4)
    p = {"w0": np.zeros(1, np.float32), "w": np.zeros(size, np.float32), "v": rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)}
    m, s, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), 256):
            b = x[order[start : start + 256]]
            y = labels[order[start : start + 256]]
            summed, b2 = b @ p["v"], b * b
            z = p["w0"] + b @ p["w"] + 0.5 * ((summed**2).sum(axis=1) - b2 @ (p["v"] ** 2).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            grad = {
                "w0": np.array([g.sum()]),
                "w": b.T @ g + 1e-4 * p["w"],
                "v": b.T @ (g[:, None] * summed) - (b2.T @ g)[:, None] * p["v"] + 1e-3 * p["v"],
            }
            t += 1
            for k, a in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * a
                s[k] = 0.999 * s[k] + 0.001 * a * a
                p[k] = (p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Machine(float(p["w0"][0]), p["w"].astype(float), p["v"].astype(float), mean, scale)


def stated_chars(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long").alias("n_chars")


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of the labelled documents as bytes; ``labels`` (doc_id, label) is a bounded sample."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            for first, end in slices(batch.column("text")):
                part = batch.slice(first, end - first)
                found = [features(t, buckets, c) for t, c in zip(part.column("text").to_pylist(), part.column("n_chars").to_pylist())]
                columns = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, part.column("label")], ["index", "value", "statistics", "label"])

    rows = docs.select("doc_id", text_of().alias("text"), stated_chars(docs)).join(F.broadcast(labels), "doc_id")
    # one text per id
    least = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "n_chars", "label")).alias("r"))
    return least.select("r.text", "r.n_chars", "r.label").mapInArrow(extract, "index binary, value binary, statistics binary, label int")


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = SAMPLE_ROWS) -> Machine | None:
    """Fit on the ``rows`` labelled documents with the least hash."""
    ship_package(docs.sparkSession)
    sample = (
        labels.where(f"{column} is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min(F.col(column).cast("int")).alias("label"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id")
        .limit(rows)
    )
    found = labelled_features(docs, sample).collect()
    # the order of rows is part of the fit
    return fit(sorted(found, key=lambda r: (r["statistics"], r["index"], r["value"], r["label"])))


def quality_scores(docs: DataFrame, model: Machine | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of the documents, and the score."""
    ship_package(docs.sparkSession)
    read = docs.select(*keep, text_of().alias("__text"), stated_chars(docs).alias("__chars"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            for first, end in slices(batch.column("__text")):
                part = batch.slice(first, end - first)
                rows = zip(part.column("__text").to_pylist(), part.column("__chars").to_pylist())
                scores = [model.score(*features(t, buckets, c)) if model else 0.5 for t, c in rows]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(scores, pa.float64())], [*keep, "score"])

    return read.mapInArrow(score, read.drop("__text", "__chars").schema.add("score", "double"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    remainder = F.pmod(crc32_of_id(), F.lit(5))
    model = train(docs, labels.where(remainder != 0))
    return quality_scores(docs, model, ["doc_id"]).select(
        "doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
