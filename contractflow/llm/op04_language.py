"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text knows all its substrings.  A text is parsed from
left to right into phrases, each the longest match that the automaton still follows; a language in whose
text the document's phrases are long needs few of them.  Each phrase costs the logarithm of the training
text's length, and the language with the least cost per byte wins; ties go to the first name.

Training text is a bounded sample: of each language the different excerpts (SAMPLE_CHARS characters, at a place that
the text's hash chooses) of labelled documents with the least hash, SAMPLE_DOCS at most; ids play no part.  Scoring reads every text to its end.  Texts are
lower-cased; letters a-z and the bytes of other letters are symbols, everything else is one separator.
For the sake of bounded memory a phrase ends at every BLOCK bytes, for all languages alike.  There may be any
number of languages: a worker holds the tables of RESIDENT in memory, those of further languages in an unnamed
temporary file, read one at a time; of all costs only the two least of each document are kept.

Text that is null, or has no letter, gets ``und`` and score 0.  With no labelled document every text
does.  The score compares the two best languages: 0.5 when they cost the same, towards 1 when the second
costs much more; it is 1 if only one language was learnt.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import crc32_of_id, text_of
from contractflow.llm.encoding import give_back, held, slices
from contractflow.storage import ship_package

SAMPLE_DOCS = 40
SAMPLE_CHARS = 1000
RESIDENT = 16
BLOCK = 2048
UNKNOWN = "und"

# symbol of each byte: 0 separator, 1-26 letters, the rest the bytes of other scripts
SYMBOLS = np.zeros(256, dtype=np.uint8)
SYMBOLS[ord("a") : ord("z") + 1] = np.arange(1, 27)
SYMBOLS[128:] = np.arange(27, 155)


def symbols_of(text: str) -> np.ndarray:
    """The symbols of a text, runs of separators as one."""
    found = SYMBOLS[np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)]
    if len(found) > 1:
        found = found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]
    return found


def lettered(texts: list[str]) -> list[bool]:
    return [any(map(str.isalpha, t)) for t in texts]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts


class Parser:
    """Counts phrases of many blocks at once with one table of moves per language."""

    def __init__(self, training: dict[str, list[str]]):
        self.names = sorted(training)
        texts = {n: np.concatenate([np.append(symbols_of(t), 0) for t in training[n]]) for n in self.names}
        seen = np.unique(np.concatenate([*texts.values(), [0]])).astype(np.int64)
        # symbols in no training text share the last column, which no state follows
        self.columns = np.full(256, len(seen), dtype=np.uint8)
        self.columns[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        self.resident, self.spilled, self.cost = [], [], []
        self.file = tempfile.TemporaryFile() if len(self.names) > RESIDENT else None
        for n in self.names:
            columns = self.columns[texts[n]]
            nexts = suffix_automaton(columns.tolist())
            table = np.zeros((len(nexts), self.width), dtype=np.int32)
            for state, moves in enumerate(nexts):
                if moves:
                    table[state, list(moves)] = list(moves.values())
            del nexts
            # no move: the next phrase begins with this symbol, or is just it; at the start one always begins
            begins = table == 0
            begins[0] = True
            # in place, as every copy of a table is as large as what stays of it
            np.copyto(table, table[0].copy(), where=begins)
            table *= 2 * self.width
            table |= begins
            table = table.ravel()
            if len(self.resident) < RESIDENT:
                self.resident.append(table)
            else:
                self.spilled.append((self.file.tell(), len(table)))
                table.tofile(self.file)
            self.cost.append(math.log2(len(columns) + 1))
        give_back()

    def tables(self) -> Iterator[np.ndarray]:
        """The tables in the order of the names."""
        yield from self.resident
        for start, size in self.spilled:
            self.file.seek(start)
            yield np.fromfile(self.file, dtype=np.int32, count=size)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text by language."""
        return np.stack(list(self.counts(texts)), axis=1)

    def counts(self, texts: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Phrases of each text, one language after the other."""
        owner, blocks = [], []
        for i, t in enumerate(texts):
            for at in range(0, len(t), BLOCK):
                owner.append(i)
                blocks.append(t[at : at + BLOCK])
        if not blocks:
            yield from (np.zeros(len(texts)) for _ in self.names)
            return
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        lanes = np.zeros((sizes[0], len(blocks)), dtype=np.uint8)
        for lane, i in enumerate(order):
            lanes[: sizes[lane], lane] = self.columns[blocks[i]]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        owners = np.array(owner)[order]
        for table in self.tables():
            state = np.zeros(len(blocks), dtype=np.int32)
            total = np.zeros(len(blocks), dtype=np.int64)
            for step in range(sizes[0]):
                n = active[step]
                move = table[state[:n] + lanes[step, :n]]
                total[:n] += move & 1
                state[:n] = move >> 1
            yield np.bincount(owners, weights=total, minlength=len(texts))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        symbols = [symbols_of(t) for t in texts]
        sizes = np.maximum(1, [len(s) for s in symbols])
        best = np.zeros(len(texts), dtype=np.int64)
        least, second = np.full(len(texts), np.inf), np.full(len(texts), np.inf)
        for k, (count, cost) in enumerate(zip(self.counts(symbols), self.cost)):
            entropy = count * cost / sizes
            less = entropy < least
            second = np.where(less, least, np.minimum(second, entropy))
            best[less], least[less] = k, entropy[less]
        if len(self.names) == 1:
            score = np.ones(len(texts))
        else:
            score = second / np.maximum(least + second, 1e-9)
        has_letter = lettered(texts)
        return (
            [self.names[b] if has else UNKNOWN for b, has in zip(best, has_letter)],
            [float(s) if has else 0.0 for s, has in zip(score, has_letter)],
        )


def training_sample(docs: DataFrame, learn) -> dict[str, list[str]]:
    """Language -> excerpts of its documents with the least hash among those that ``learn`` selects."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # not the beginning, where a source may open all its documents with the same words
    place = f"1 + pmod(xxhash64(text, 'excerpt'), greatest(1, length(text) - {SAMPLE_CHARS} + 1))"
    begins = labelled.selectExpr("lang", f"substring(text, cast({place} as int), {SAMPLE_CHARS}) as t").withColumn("h", F.xxhash64("t", F.lit("language")))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy()
            parts = np.split(batch.column("h").to_numpy()[np.argsort(codes)], np.cumsum(np.bincount(codes))[:-1])
            for lang, part in zip(langs.dictionary.to_pylist(), parts):
                held[lang] = np.unique(np.concatenate([held.get(lang, part[:0]), part]))[:SAMPLE_DOCS]
        for lang, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64())], ["lang", "h"])

    ranked = begins.select("lang", "h").mapInArrow(least, "lang string, h long").distinct()
    picked = ranked.withColumn("n", F.expr("row_number() over (partition by lang order by h)")).where(F.col("n") <= SAMPLE_DOCS)
    # the driver holds the texts picked, so their hashes are small
    rows = begins.join(F.broadcast(picked.select("lang", "h")), ["lang", "h"]).dropDuplicates(["lang", "h", "t"])
    out: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "h", "t").collect():
        out.setdefault(r["lang"], []).append(r["t"])
    return out


def identify(docs: DataFrame, learn, keep: list[str], names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of the documents with language and score; ``learn`` selects training rows.

    ``names`` are the names of the new columns, which must differ from those kept; a third one says whether the
    text has a letter.
    """
    ship_package(docs.sparkSession)
    training = training_sample(docs, learn)
    model = hashlib.sha256(repr(sorted(training.items())).encode("utf-8", "replace")).hexdigest()
    # a text that is kept is sent once; a null one is read as empty here or there
    column = "text" if "text" in keep else "__text"
    read = docs.select(*keep) if column in keep else docs.select(*keep, text_of().alias(column))
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    if len(names) > 2:
        schema = schema.add(names[2], "boolean")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held(("languages", model), lambda: Parser(training)) if training else None
        for batch in batches:
            for first, end in slices(batch.column(column), 4 << 20):
                part = batch.slice(first, end - first)
                texts = [t or "" for t in part.column(column).to_pylist()]
                if parser:
                    languages, scores = parser.predict(texts)
                else:
                    languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
                if len(names) > 2:
                    columns.append(pa.array(lettered(texts), pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *names])
            # before the next one comes
            batch = part = columns = texts = None
        give_back()

    return read.mapInArrow(score, schema)


def keep_identified(docs: DataFrame, learn, languages: list[str] | None = None, least_score: float = 0.0) -> DataFrame:
    """The documents that are in some language, with all their columns; ``lang`` is what they were found to be in.

    Texts without a letter are in none.  With ``languages`` only documents in one of them stay, and with ``least_score``
    only those that are that sure.  Where nothing could be learnt, ``lang`` stays as it is and is what counts.
    """
    names = ("__language", "__score", "__lettered")
    found = identify(docs, learn, docs.columns, names).where("__lettered")
    learnt = F.col("__language") != UNKNOWN
    found = found.where(~learnt | (F.col("__score") >= least_score))
    found = found.withColumn("lang", F.when(learnt, F.col("__language")).otherwise(F.col("lang"))).drop(*names)
    return found if languages is None else found.where(F.col("lang").isin(languages))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.pmod(crc32_of_id(), F.lit(4))
    found = identify(docs, remainder != 2, ["doc_id"])
    return found.select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")
