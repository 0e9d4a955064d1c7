"""Phrase collocation mining after Toivonen.

Per language, all phrases of up to LONGEST words that occur LEAST times or more are counted exactly, and those of two
words or more are scored by how much oftener they occur than their two parts would by chance, at the cut for which this
is least.

Sample.  RATE per cent of the documents, chosen by a hash of id and text, are counted with a threshold lowered by a
standard deviation.  The phrases over it are the proposal.

Full pass.  A phrase is counted in all documents if both its parts, without the last and without the first word, are in
the proposal (single words always are); so the proposal and its negative border, as far as it occurs, are counted
exactly.  A proposal that was too large only costs time.

Expansion.  A frequent phrase outside the proposal is a failure of the border: longer phrases with it have not been counted.
A further pass counts what has not been counted of the phrases whose parts may be frequent: a part may be if it is known to
be, or if it has not been counted either and its own parts may be.  As a phrase cannot be more frequent than its
parts, every frequent phrase that was left out is among these, up to the longest, so this one pass closes the border.
Whatever the sample was, the result does not depend on it.

The proposal goes to the tasks as a bitmap of fixed size, which lets every true member through; phrases that it lets
through by mistake are counted in vain, in all passes alike.  Occurrences are added up in the tasks and before the
shuffle, so a phrase that fills a third of the corpus is few rows per task.  Counts go by the phrases themselves, not by hashes.

Text is lower-cased in A-Z only and cut into pieces at punctuation marks and line ends, pieces into words at spaces and
tabs; phrases never cross pieces.  Null texts have no words, a null language is ``und``.  Repeated rows count each.
Scores are exact integers (38 digits on the way).  Ties are settled as the ranking says, down to the phrase's
bytes, so there are none.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import text_of
from contractflow.llm.encoding import slices
from contractflow.operators.bounded import lookup_join
from contractflow.storage import cut_lineage, ship_package, shuffles_released

LEAST = 100
LONGEST = 5
TOP = 2000
RATE = 10
UNKNOWN = "und"
BITMAP_BITS = 24
MAX_WORDS = 200_000
SLICE_BYTES = 8 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
# phrases that one batch holds
BATCH = 50_000
# parts that the ranking of one language is cut into before its last step
RANK_PARTS = 64
# the empty phrase has the number of words of a language
COLUMNS = ["lang", "phrase", "n"]
SCHEMA = "lang string, phrase string, n long"

# every end of a piece becomes a byte that no text holds
END = b"\xff"
ENDS = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class Words(dict):
    """Word -> number; the end of a piece is number 0."""

    def __init__(self):
        super().__init__()
        self.start()

    def start(self) -> None:
        self.clear()
        self.listed, self.hashes = [], np.zeros(0, dtype=np.uint64)
        self[END]

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.listed.append(word)
        return found

    def codes(self, texts: list[str]) -> np.ndarray:
        """Numbers of the words of all texts, with an end behind each piece and each text."""
        joined = END.join([t.encode() for t in texts]) + END
        words = joined.lower().translate(ENDS).replace(END, b" \xff ").split()
        found = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        new = [xxhash.xxh3_64_intdigest(w) for w in self.listed[len(self.hashes) :]]
        self.hashes = np.concatenate((self.hashes, np.array(new, dtype=np.uint64)))
        return found


def seed_of(lang: str, k: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=k))


def phrase_hash(lang: str, words: list[bytes]) -> int:
    """The same as :func:`hashes_at` gives, for one phrase."""
    total = np.array([seed_of(lang, len(words))])
    for w in words:
        total = mixed(total * MIX + np.uint64(xxhash.xxh3_64_intdigest(w)))
    return int(total[0])


def hashes_at(lang: str, code: np.ndarray, word_hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    total = np.full(len(at), seed_of(lang, k))
    for j in range(k):
        total = mixed(total * MIX + word_hashes[code[at + j]])
    return total


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64((1 << BITMAP_BITS) - 1)
    return ((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)


def phrases_of(code: np.ndarray, words: list[bytes], at: np.ndarray, k: int) -> pa.Array:
    """The phrases of k words at the given places."""
    used, place = np.unique(np.concatenate([code[at + j] for j in range(k)]), return_inverse=True)
    known = pa.array([words[i].decode() for i in used.tolist()], pa.string())
    parts = [known.take(pa.array(p)) for p in np.split(place, k)]
    return parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")


def counted(
    lang: str, code: np.ndarray, words: Words, inside: np.ndarray | None, before: np.ndarray | None, longest: int
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a stretch of text.

    Without ``inside`` all phrases are counted, else those whose parts are inside.  With ``before``, the bitmap of
    an earlier pass, those that that pass has counted are left out, single words among them, and a part may also be
    one that it has not counted.
    """

    def batch(k: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), phrases_of(code, words.listed, at, k), pa.array(n)], COLUMNS)

    def marks(k: int, start: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether phrases may be parts of longer ones, and whether they were in the pass before."""
        hashes = hashes_at(lang, code, words.hashes, start, k)
        goes_on = holds(inside, hashes) if inside is not None else np.ones(len(start), dtype=bool)
        if before is None:
            return goes_on, np.zeros(len(start), dtype=bool)
        return goes_on | ~known, holds(before, hashes) & known

    # words by number, which needs no sort; number 0 is the end of a piece
    times = np.bincount(code, minlength=len(words))
    times[0] = 0
    found = np.flatnonzero(times)
    if not len(found):
        return
    first = np.zeros(len(words), dtype=np.int64)
    first[code] = np.arange(len(code))
    if before is None:
        yield batch(1, first[found], times[found])
    new, old = np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=bool)
    new[found], old[found] = marks(1, first[found], np.ones(len(found), dtype=bool))
    # by place: name of the phrase that starts there, whether it may be a part, whether it was in the pass before
    name, new, old = code, new[code], old[code]
    for k in range(2, longest + 1):
        at = np.flatnonzero(new[:-1] & new[1:])
        if not len(at):
            return
        key = name[at] * (int(name.max()) + 1) + name[at + 1]
        _, first, place, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        start = at[first]
        known = old[start] & old[start + 1]
        send = np.flatnonzero(~known)
        for i in range(0, len(send), BATCH):
            yield batch(k, start[send[i : i + BATCH]], n[send[i : i + BATCH]])
        goes_on, was = marks(k, start, known)
        name, new, old = np.zeros(len(code), dtype=np.int64), np.zeros(len(code), dtype=bool), np.zeros(len(code), dtype=bool)
        name[at], new[at], old[at] = place, goes_on[place], was[place]


def count_phrases(
    texts: DataFrame, inside: Broadcast | None = None, before: Broadcast | None = None, least: int = 1, longest: int = LONGEST
) -> DataFrame:
    """lang, phrase, n of the phrases with n of ``least`` at least, and of the empty phrase."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        bits = [b.value if b is not None else None for b in (inside, before)]
        for batch in batches:
            for first, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, end - first)
                if len(words) > MAX_WORDS:
                    words.start()
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    mine = part.column("text").take(pa.array(np.flatnonzero(langs == lang)))
                    code = words.codes(mine.to_pylist())
                    yield from counted(lang, code, words, *bits, longest)
                    if before is None:
                        total = pa.array([int(np.count_nonzero(code))], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), total], COLUMNS)

    rows = texts.mapInArrow(count, SCHEMA)
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(f"phrase = '' or n >= {least}")


def bitmap(phrases: DataFrame) -> np.ndarray:
    """Bits of the hashes of the phrases; made in the tasks, of one size whatever the input."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            hashes = [phrase_hash(lang, phrase.encode().split(b" ")) & ((1 << BITMAP_BITS) - 1) for lang, phrase in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64())], ["place"])

    found = phrases.select("lang", "phrase").mapInArrow(places, "place long")
    words = found.groupBy(F.expr("place div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
    table = words.toArrow()
    bits = np.zeros(1 << BITMAP_BITS - 6, dtype=np.uint64)
    bits[table.column("w").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return bits


def outside(phrases: DataFrame, bits: Broadcast) -> DataFrame:
    """The phrases whose hash is not in the bitmap."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            hashes = np.array([phrase_hash(lang, phrase.encode().split(b" ")) for lang, phrase in pairs], dtype=np.uint64)
            yield batch.filter(pa.array(~holds(bits.value, hashes)))

    return phrases.mapInArrow(pick, phrases.schema)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, rate: int = RATE) -> DataFrame:
    """lang, phrase, n of all phrases of 1 to ``longest`` words that occur ``least`` times, and the empty one; stored."""
    spark = docs.sparkSession
    ship_package(spark)
    lang = F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")
    texts = docs.select(lang, text_of().alias("text"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("phrases")), F.lit(100))
    sampled = docs.where(place < rate).select(lang, text_of().alias("text"))
    expected = least * rate / 100
    lowered = max(1, math.ceil(expected - math.sqrt(expected)))
    # the shuffle of a pass is the largest thing on disk, and two of them are not needed at once
    with shuffles_released(spark):
        proposed = count_phrases(sampled, least=lowered, longest=longest - 1).where("phrase <> ''")
        inside = spark.sparkContext.broadcast(bitmap(proposed))
    with shuffles_released(spark):
        frequent = cut_lineage(count_phrases(texts, inside, None, least, longest))
    if not outside(frequent.where(f"phrase <> '' and {length('phrase')} < {longest}"), inside).isEmpty():
        known = spark.sparkContext.broadcast(bitmap(frequent.where("phrase <> ''")))
        with shuffles_released(spark):
            more = count_phrases(texts, known, inside, least, longest)
            frequent = cut_lineage(frequent.unionByName(more).distinct())
        known.unpersist()
    inside.unpersist()
    return frequent


def length(phrase: str) -> str:
    """Words of a phrase."""
    return f"if({phrase} = '', 0, length({phrase}) - length(replace({phrase}, ' ', '')) + 1)"


def collocations(frequent: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of the frequent phrases of two words or more that no longer one explains."""
    sized = frequent.withColumn("k", F.expr(length("phrase")))
    words = sized.where("k > 0").select("lang", "phrase", F.col("n").alias("f"))
    totals = sized.where("k = 0").select("lang", F.col("n").alias("total"))
    several = sized.where("k > 1").selectExpr("lang", "phrase", "k", "n as a", "split(phrase, ' ') as w")
    cuts = several.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).selectExpr(
        "lang", "phrase", "k", "a", "cut", "array_join(slice(w, 1, cut), ' ') as first", "array_join(slice(w, cut + 1, k - cut), ' ') as rest"
    )
    cuts = cuts.join(words.selectExpr("lang", "phrase as first", "f as l"), ["lang", "first"])
    cuts = cuts.join(words.selectExpr("lang", "phrase as rest", "f as r"), ["lang", "rest"])
    wide = {c: f"cast({c} as decimal(19,0))" for c in ("a", "total", "l", "r")}
    score = f"cast(1000 as decimal(4,0)) * {wide['a']} * {wide['total']} div ({wide['l']} * {wide['r']})"
    scored = lookup_join(cuts, totals, ["lang"]).withColumn("score", F.expr(score))
    best = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r", "total")).alias("b"))
    # a phrase two words longer is no more frequent than the one between, so the next longer ones decide
    inner = several.where("k > 2").selectExpr("lang", "a", "explode(array(slice(w, 1, k - 1), slice(w, 2, k - 1))) as w")
    explained = inner.groupBy("lang", F.expr("array_join(w, ' ')").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(explained, ["lang", "phrase"], "left").where("longer is null or longer < a")
    return kept.selectExpr("lang", "phrase", "k", "a", "b.l as l", "b.r as r", "b.total as n", "b.score as score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first of every language with their rank, chosen in parts of a language first."""
    order = "order by score desc, a desc, phrase"
    part = found.withColumn("part", F.expr(f"pmod(xxhash64(phrase), {RANK_PARTS})"))
    first = part.withColumn("rank", F.expr(f"row_number() over (partition by lang, part {order})")).where(F.col("rank") <= top)
    return first.withColumn("rank", F.expr(f"cast(row_number() over (partition by lang {order}) as bigint)")).where(F.col("rank") <= top).drop("part")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = ranked(collocations(frequent_phrases(docs)))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents
), lists as (
    select lang, regexp_extract_all(piece, '[^ \\t]+') as w from pieces
), totals as (
    select lang, sum(len(w)) as n from lists group by lang
), places as (
    select lang, w, unnest(range(1, len(w) + 1)) as i from lists
), grams as (
    select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as phrase
    from places, (select unnest([1, 2, 3, 4, 5]) as k) where i + k - 1 <= len(w)
), frequent as (
    select lang, k, phrase, count(*) as f from grams group by lang, k, phrase having count(*) >= 100
), cuts as (
    select lang, phrase, k, f as a, unnest(range(1, k)) as cut from frequent where k > 1
), parts as (
    select *, array_to_string(list_slice(string_split(phrase, ' '), 1, cut), ' ') as head,
           array_to_string(list_slice(string_split(phrase, ' '), cut + 1, k), ' ') as tail
    from cuts
), scored as (
    select p.lang, p.phrase, p.k, p.a, p.cut, x.f as l, y.f as r, t.n,
           1000::hugeint * p.a * t.n // (x.f::hugeint * y.f) as score
    from parts p join frequent x on x.lang = p.lang and x.phrase = p.head
    join frequent y on y.lang = p.lang and y.phrase = p.tail join totals t on t.lang = p.lang
), best as (
    select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as place from scored) where place = 1
), inner_parts as (
    select lang, f, unnest([array_to_string(list_slice(string_split(phrase, ' '), 1, k - 1), ' '),
                            array_to_string(list_slice(string_split(phrase, ' '), 2, k), ' ')]) as phrase
    from frequent where k > 2
), kept as (
    select * from best b
    where not exists (select 1 from inner_parts i where i.lang = b.lang and i.phrase = b.phrase and i.f >= b.a)
)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
) where rank <= 2000
"""
