"""Benchmark decontamination by templates, which also finds re-parameterised questions.

Words are canonicalised: numbers, names and units become typed placeholders, all else is lower-cased and
stripped of punctuation.  A letter of a script without spaces is a word.  Windows of WINDOW canonical words, at
least LITERALS of them no placeholder, are joined with the windows of the benchmark on their hash and then
their text.  What stood in the placeholders are the slots.  Every window is joined in the same way also as it
stands, without placeholders, so verbatim copies need no literals and no equal reading of capitals; only
re-parameterised ones do.  Matches of a document and an item on the same diagonal (distance of their
positions) are one occurrence.  Its slots are consistent if everywhere one value in the item is one value
in the document, be it the same or another; windows that hold a value for which this fails do not count.
A document is contaminated by an item, however long, if one of these holds:

* the windows that count are at least COVERAGE of the item's windows, or of those with enough literals;
* in one occurrence they cover RUN_WORDS words in a row;
* in one occurrence VERBATIM_WORDS words in a row (two windows side by side) stand as in the item, whatever
  other slots hold.

The match is exact if all slots of an occurrence are equal, otherwise re-parameterised.  What is left out: a
copy with a plain word changed every few words, so that no run is long enough and under COVERAGE is left.

Documents send only windows that pass a bitmap of fixed size made from the benchmark, which lets every true
match through.  Items shorter than a window are searched as one shorter window, those of fewer than LITERALS
literal words verbatim only.  Items without any letter or digit match nothing.  Null
texts have no words.  Equal rows get equal
answers.  An empty benchmark contaminates nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import KEY, text_of, with_key
from contractflow.llm.encoding import slices
from contractflow.storage import cut_lineage, ship_package

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
RUN_WORDS = 13
VERBATIM_WORDS = 2 * WINDOW
BITMAP_BITS = 23
MAX_WORDS = 500_000

# Words that count as units.
UNITS = frozenset(
    "kg km cm mm mg lb lbs oz ft mph kph hour hours minute minutes second seconds day days week weeks month months"
    " year years cent cents dollar dollars euro euros percent liter liters litre litres meter meters metre metres"
    " mile miles gram grams".split()
)
# letters of scripts written without spaces
SPACELESS = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
PLAIN, NUM, UNIT, NAME, NOTHING = range(5)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PLACEHOLDERS = {NUM: "<num>", UNIT: "<unit>", NAME: "<name>"}


def code_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


class Words(dict):
    """Word -> place in the arrays ``codes``, ``plain`` (code as a plain word), ``kinds`` and ``ends`` (a sentence)."""

    def __init__(self):
        self.codes, self.plain = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.uint64)
        self.kinds, self.ends = np.zeros(1024, dtype=np.int8), np.zeros(1024, dtype=bool)
        self.chars = 0

    def __missing__(self, word: str) -> int:
        bare = EDGES.sub("", word)
        lower = bare.lower()
        kind = PLAIN
        if not bare:
            kind = NOTHING
        elif NUMBER.fullmatch(bare):
            kind = NUM
        elif lower in UNITS:
            kind = UNIT
        elif len(bare) > 1 and bare[0].isupper() and bare[1].islower():
            kind = NAME
        at = len(self)
        if at == len(self.codes):
            for name in ("codes", "plain", "kinds", "ends"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.plain[at] = code_of(lower)
        self.codes[at] = code_of(PLACEHOLDERS[kind]) if kind in PLACEHOLDERS else self.plain[at]
        self.kinds[at], self.ends[at] = kind, word[-1] in ".!?:"
        self.chars += len(word)
        self[word] = at
        return at

    def places(self, words: list[str]) -> np.ndarray:
        """Places of the words of one text; forgets all others when there are too many."""
        if len(self) > MAX_WORDS or self.chars > 64 * MAX_WORDS:
            self.clear()
            self.chars = 0
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class Canonical:
    """The canonical words of a text: codes, which are slots, and the words themselves."""

    def __init__(self, text: str, words: Words):
        if not text.isascii():
            text = SPACELESS.sub(r" \g<0> ", text)
        raw = text.split()
        at = words.places(raw)
        kinds, ends = words.kinds[at], words.ends[at]
        # a capital says nothing at the start of a sentence
        starts = np.concatenate(([True], ends[:-1])) if raw else ends
        kinds[(kinds == NAME) & starts] = PLAIN
        codes = np.where(kinds == PLAIN, words.plain[at], words.codes[at])
        there = np.flatnonzero(kinds != NOTHING)
        # with and without placeholders
        self.codes, self.kinds, self.raw, self.there = np.stack([codes, words.plain[at]])[:, there], kinds[there], raw, there

    def __len__(self) -> int:
        return len(self.kinds)

    def hashes(self, n: int) -> np.ndarray:
        """Hashes of every window of n words, with placeholders (0 if literals are too few) and as it stands."""
        if len(self) < n:
            return np.zeros((2, 0), dtype=np.uint64)
        size = len(self) - n + 1
        total = np.full((2, size), [[n], [n + WINDOW]], dtype=np.uint64)
        for k in range(n):
            total *= MULTIPLIER
            total += self.codes[:, k : k + size]
        total ^= total >> np.uint64(29)
        total *= MULTIPLIER
        literal = np.concatenate(([0], np.cumsum(self.kinds == PLAIN)))
        total[0, literal[n:] - literal[:-n] < LITERALS] = 0
        return total

    def word(self, i: int) -> str:
        return EDGES.sub("", self.raw[self.there[i]]).lower()

    def verbatim(self, start: int, n: int) -> str:
        """The words as they stand; no template begins like this."""
        return " ".join(["=", *(self.word(start + i) for i in range(n))])

    def template(self, start: int, n: int) -> str:
        kinds = self.kinds[start : start + n]
        return " ".join(PLACEHOLDERS.get(int(k)) or self.word(start + i) for i, k in enumerate(kinds))

    def slots(self, start: int, n: int) -> list[str]:
        return [self.word(start + i) for i in range(n) if self.kinds[start + i] != PLAIN]


WINDOW_TYPES = pa.schema(
    [("hash", pa.int64()), ("template", pa.string()), ("at", pa.int64()), ("slots", pa.list_(pa.string()))]
)
WINDOW_SCHEMA = "hash long, template string, at long, slots array<string>"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n_windows, n_rich (those with enough literals), n (words in a window) and the windows of all benchmark items, stored.

    ``rich`` says whether a window is one with enough literals; it is there with placeholders and as it stands.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        types = pa.schema(
            [("item_id", pa.int64()), ("n", pa.int32()), ("n_windows", pa.int64()), ("n_rich", pa.int64()), ("rich", pa.bool_()), *WINDOW_TYPES]
        )
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                c = Canonical(text, words)
                n = min(WINDOW, len(c))
                typed, plain = c.hashes(n) if n else np.zeros((2, 0), dtype=np.uint64)
                own = {"item_id": item, "n": n, "n_windows": len(plain), "n_rich": int(np.count_nonzero(typed))}
                for at in range(len(plain)):
                    own |= {"at": at, "slots": c.slots(at, n), "rich": bool(typed[at])}
                    out.append(own | {"hash": int(plain[at].astype(np.int64)), "template": c.verbatim(at, n)})
                    if typed[at]:
                        out.append(own | {"hash": int(typed[at].astype(np.int64)), "template": c.template(at, n)})
            yield pa.RecordBatch.from_pylist(out, schema=types)

    read = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return cut_lineage(
        read.mapInArrow(cut, f"item_id long, n int, n_windows long, n_rich long, rich boolean, {WINDOW_SCHEMA}")
    )


def bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the hashes that occur in the benchmark; made in the tasks, of one size whatever the input."""
    low = F.col("hash").bitwiseAND((1 << BITMAP_BITS) - 1)
    words = windows.groupBy(F.shiftright(low, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(hash & 63 as int))")).alias("bits")
    )
    bits = np.zeros(1 << BITMAP_BITS - 6, dtype=np.uint64)
    for r in words.toLocalIterator():
        bits[r["w"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return bits


def document_windows(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """The key of every document once, and its windows that may be in the benchmark, stored.

    Windows as they stand have null for slots, as they are those of the item.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    names = [*KEY, "doc_id"]
    types = pa.schema([(KEY[0], pa.string()), (KEY[1], pa.int64()), ("doc_id", pa.int64()), *WINDOW_TYPES])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(), sent.value
        for batch in batches:
            for first, end in slices(batch.column("text")):
                part = batch.slice(first, end - first)
                out = [dict(zip(names, r)) for r in zip(*(part.column(n).to_pylist() for n in names))]
                for own, text in zip(list(out), part.column("text").to_pylist()):
                    c = Canonical(text, words)
                    for n in lengths:
                        hashes = c.hashes(n)
                        low = hashes & np.uint64((1 << BITMAP_BITS) - 1)
                        hit = (held[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)
                        typed, plain = hit.astype(bool) & (hashes != 0)
                        for at in np.flatnonzero(typed).tolist():
                            out.append(own | {"hash": int(hashes[0, at].astype(np.int64)), "template": c.template(at, n), "at": at, "slots": c.slots(at, n)})
                        seen = set()
                        for at in np.flatnonzero(plain).tolist():
                            # short windows are whole items, for which one place is enough
                            if n < WINDOW and hashes[1, at] in seen and c.verbatim(at, n) in seen:
                                continue
                            row = {"hash": int(hashes[1, at].astype(np.int64)), "template": c.verbatim(at, n), "at": at, "slots": None}
                            if n < WINDOW:
                                seen |= {hashes[1, at], row["template"]}
                            out.append(own | row)
                yield pa.RecordBatch.from_pylist(out, schema=types)

    read = with_key(docs).select(*names, text_of().alias("text"))
    return cut_lineage(read.mapInArrow(cut, f"`{KEY[0]}` string, `{KEY[1]}` long, doc_id long, {WINDOW_SCHEMA}"))


def has_run(positions: str, words: int) -> str:
    """SQL: whether the distinct window positions hold a run of windows that covers so many words."""
    n = words - WINDOW + 1
    ordered = f"array_sort({positions})"
    return f"exists(transform(slice({ordered}, {n}, size({positions})), (p, i) -> p - get({ordered}, i)), d -> d = {n - 1})"


def contaminations(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: key, doc_id, contaminated, items (ids, ascending), reparameterised (ids among them)."""
    ship_package(docs.sparkSession)
    items = item_windows(benchmark)
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())
    windows = document_windows(docs, lengths, bitmap(items))
    theirs = items.select(
        "item_id", "n_windows", "n_rich", "rich", "hash", "template", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")
    )
    matched = (
        windows.where("hash is not null")
        .join(theirs, ["hash", "template"])
        .withColumn("slots", F.coalesce("slots", "item_slots"))
    )
    item = ["item_id", "n_windows", "n_rich"]
    # an occurrence is as long as its item, so these groups are small
    occurrences = (
        matched.withColumn("diagonal", F.col("at") - F.col("item_at"))
        .groupBy(*KEY, "doc_id", *item, "diagonal")
        .agg(
            F.expr("collect_set(struct(item_at, arrays_zip(item_slots, slots) as pairs))").alias("windows"),
            F.collect_set(F.when(F.col("rich"), F.col("item_at"))).alias("rich"),
        )
        .withColumn("pairs", F.expr("array_sort(array_distinct(flatten(windows.pairs)))"))
        # sorted, so the values of one slot are neighbours
        .withColumn(
            "conflicts", F.expr("filter(pairs, (p, i) -> p.item_slots <=> get(pairs, i - 1).item_slots).item_slots")
        )
        .withColumn("verbatim", F.expr("filter(windows, w -> forall(w.pairs, p -> p.item_slots = p.slots)).item_at"))
        .withColumn("kept", F.expr("filter(windows, w -> not arrays_overlap(conflicts, w.pairs.item_slots)).item_at"))
        .withColumn("found", F.expr(f"if({has_run('verbatim', VERBATIM_WORDS)}, array_union(kept, verbatim), kept)"))
        .withColumn("long", F.expr(f"{has_run('kept', RUN_WORDS)} or {has_run('verbatim', VERBATIM_WORDS)}"))
        .where("size(found) > 0")
    )
    exact = F.expr("bool_or(forall(pairs, p -> p.item_slots = p.slots))")
    # the union is made of distinct positions of one item
    hits = (
        occurrences.groupBy(*KEY, "doc_id", *item)
        .agg(
            F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"),
            F.array_distinct(F.flatten(F.collect_set(F.array_intersect("found", "rich")))).alias("rich"),
            F.bool_or("long").alias("long"),
            exact.alias("exact"),
        )
        .where(
            F.col("long")
            | (F.size("found") >= F.lit(coverage) * F.col("n_windows"))
            | ((F.col("n_rich") > 0) & (F.size("rich") >= F.lit(coverage) * F.col("n_rich")))
        )
        .groupBy(*KEY)
        .agg(
            F.sort_array(F.collect_set("item_id")).alias("items"),
            F.sort_array(F.collect_set(F.when(~F.col("exact"), F.col("item_id")))).alias("reparameterised"),
        )
    )
    empty = F.array().cast("array<bigint>")
    return (
        windows.where("hash is null")
        .select(*KEY, "doc_id")
        .join(hits, KEY, "left")
        .withColumns({"contaminated": F.col("items").isNotNull()})
        .withColumns({"items": F.coalesce("items", empty), "reparameterised": F.coalesce("reparameterised", empty)})
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad = contaminations(docs, benchmark).where("contaminated").select(*KEY).distinct()
    return with_key(docs).join(bad, KEY, "left_anti").drop(*KEY)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminations(docs, benchmark).select(
        "doc_id", "contaminated", F.size("items").cast("long").alias("n_items"), "items", "reparameterised"
    )
