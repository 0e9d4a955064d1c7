"""Secret scan: fixed patterns, and formats learnt from what they find by grammar inference.

The base finds three kinds of span (assign, access, hex) with fixed patterns in every whole text.  The
credentials that it finds in all texts are the labelled examples; of each kind the SAMPLE_PER_KIND with the least hash
are learnt from.

Inference.  The examples of a kind make a prefix tree over classes of characters.  States of the same depth are merged
first, where nothing speaks against it: where their ends and their moves, and those of all their successors, agree
within the Hoeffding bound.  That pools the evidence of random characters without losing length or order.
Then states of different depth are merged, which makes loops, but only where something speaks for it: both have been
seen LEAST_STATE times and agree all the way down.  So a fixed length stays fixed, a prefix keeps its order, and a
free length becomes a loop.  Half of the examples are learnt from; a quarter chooses the confidence of the bound by likelihood, and a quarter sets
the threshold: the likelihood per character that all but QUANTILE of unseen credentials reach.

Every candidate of every text is scored: a run of credential characters outside all base spans, as short as the
base allows for a kind that was learnt.  Where the run as a whole is none, its pieces between ``=`` are tried, then
theirs between ``/`` and between ``.`` (``:`` ends a run).  One that reaches the threshold of a kind, and is MARGIN
bits per character likelier under its automaton than under one learnt from other runs, becomes a span of
kind ``like_<kind>``.  Base spans always stay.

Offsets are code points, ends are exclusive.  Null text is empty and has no spans.  A candidate that reaches several
thresholds belongs to the likeliest kind, of equal ones to the first.  Repeated rows get equal spans and do not
weigh on what is learnt, since values are learnt once; ids play no part.  Kinds of under LEAST_EXAMPLES different values
add nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import text_of
from contractflow.llm.encoding import slices
from contractflow.storage import ship_package

SAMPLE_PER_KIND = 400
LONGEST_EXAMPLE = 200
LEAST_EXAMPLES = 10
# evidence that a loop needs, and the confidences that are tried for the bound
LEAST_STATE = 20
ALPHAS = (0.5, 0.05, 0.005, 0.0005)
# bits of a character that no example had at its place
LOST = 12.0
MAX_KNOWN = 200_000
QUANTILE = 0.05
MARGIN = 1.0

# The base patterns.  Runs are maximal, so their least length can stand in the pattern.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile("AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile("[0-9a-f]{24,}")
HEX_LEAST = 24
KINDS = ("assign", "access", "hex")
LEASTS = {"assign": ASSIGN_LEAST, "access": ACCESS_LEAST, "hex": HEX_LEAST}
SEPARATORS = "=/."

Span = tuple[int, int, int]  # start, place in KINDS (added kinds follow), end


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def symbols(text: str) -> str:
    """The text in classes of characters: digits, hexadecimal and other letters; the rest as it is."""
    return text.translate(CLASSES)


CLASSES = {ord(c): "0" for c in "0123456789"} | {ord(c): "f" for c in "abcdef"} | {ord(c): "F" for c in "ABCDEF"}
CLASSES |= {c: "z" for c in range(ord("g"), ord("z") + 1)} | {c: "Z" for c in range(ord("G"), ord("Z") + 1)}


class Automaton:
    """A probabilistic automaton inferred from examples by merging states of their prefix tree."""

    def __init__(self, examples: list[str], alpha: float = ALPHAS[1], least_state: int = LEAST_STATE):
        self.next: list[dict[str, int]] = []
        self.count: list[Counter] = []
        self.ends: list[int] = []
        # a state that was merged into another one
        self.into: dict[int, int] = {}
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.least_state = least_state
        self.grow(examples)
        self.merge_layers()
        self.merge_loops()

    def new_state(self) -> int:
        self.next.append({})
        self.count.append(Counter())
        self.ends.append(0)
        return len(self.ends) - 1

    def grow(self, examples: list[str]) -> None:
        self.new_state()
        for example in examples:
            state = 0
            for c in example:
                self.count[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = self.new_state()
                state = self.next[state][c]
            self.ends[state] += 1

    def find(self, state: int) -> int:
        while state in self.into:
            self.into[state] = self.into.get(self.into[state], self.into[state])
            state = self.into[state]
        return state

    def after(self, state: int) -> dict[str, int]:
        return {c: self.find(s) for c, s in self.next[state].items()}

    def total(self, state: int) -> int:
        return self.ends[state] + self.count[state].total()

    def states(self) -> set[int]:
        """All states that can be reached."""
        found, todo = {0}, [0]
        while todo:
            new = set(self.after(todo.pop()).values()) - found
            found |= new
            todo += new
        return found

    def agree(self, a: int, b: int) -> bool:
        n, m = self.total(a), self.total(b)
        if not n or not m:
            return True
        allowed = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        moves = self.count[a].keys() | self.count[b].keys()
        pairs = [(self.ends[a], self.ends[b]), *((self.count[a][c], self.count[b][c]) for c in moves)]
        return all(abs(k / n - l / m) <= allowed for k, l in pairs)

    def compatible(self, a: int, b: int) -> bool:
        """Whether two states, and all pairs of states that their merge would join, go on alike."""
        todo, seen = [(a, b)], set()
        while todo:
            pair = todo.pop()
            if pair in seen or pair[0] == pair[1]:
                continue
            seen.add(pair)
            if not self.agree(*pair):
                return False
            left, right = self.after(pair[0]), self.after(pair[1])
            todo += [(left[c], right[c]) for c in left.keys() & right.keys()]
        return True

    def merge(self, a: int, b: int) -> None:
        """Make two states one, and those that the same moves then lead to."""
        todo = [(a, b)]
        while todo:
            a, b = map(self.find, todo.pop())
            if a == b:
                continue
            self.into[b] = a
            self.ends[a] += self.ends[b]
            self.count[a].update(self.count[b])
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def merge_layers(self) -> None:
        layer = [0]
        while layer:
            kept: list[int] = []
            for state in sorted(layer, key=lambda s: (-self.total(s), s)):
                alike = next((k for k in kept if self.compatible(k, state)), None)
                if alike is None:
                    kept.append(state)
                else:
                    self.merge(alike, state)
            layer = sorted({s for k in kept for s in self.after(k).values()})

    def merge_loops(self) -> None:
        red = [0]
        while blue := {s for r in red for s in self.after(r).values()} - set(red):
            state = max(blue, key=lambda s: (self.total(s), -s))
            seen = self.total(state) >= self.least_state
            alike = next((r for r in red if seen and self.total(r) >= self.least_state and self.compatible(r, state)), None)
            if alike is None:
                red.append(state)
            else:
                self.merge(alike, state)
                red = sorted({self.find(r) for r in red})

    def bits(self, form: str, least: float = -math.inf) -> float:
        """Mean log2 likelihood of a character, the end included; ``-inf`` as soon as it is sure to miss ``least``."""
        state, total, needed = 0, 0.0, least * (len(form) + 1)
        for i, c in enumerate(form):
            seen = self.count[state][c]
            if not seen:
                total -= LOST * (len(form) + 1 - i)
                break
            total += math.log2(seen / self.total(state))
            if total < needed:
                return -math.inf
            state = self.find(self.next[state][c])
        else:
            total += math.log2(self.ends[state] / self.total(state)) if self.ends[state] else -LOST
        return total / (len(form) + 1) if total >= needed else -math.inf


def fitted(examples: list[str], held_out: list[str]) -> Automaton:
    """The automaton whose confidence makes the held-out examples likeliest."""
    tried = [Automaton(examples, alpha) for alpha in ALPHAS]
    return max(tried, key=lambda a: sum(a.bits(x) for x in held_out))


class Grammar:
    """Automata and thresholds by kind, and an automaton of other runs to compare with."""

    def __init__(self, credentials: dict[str, list[str]], others: list[str]):
        self.kinds: dict[str, tuple[Automaton, float]] = {}
        # kind by form; forgets all when it holds MAX_KNOWN
        self.known: dict[str, str | None] = {}
        for kind, found in credentials.items():
            if len(found) >= LEAST_EXAMPLES:
                forms = list(map(symbols, found))
                automaton = fitted(forms[::2], forms[1::4])
                scores = sorted(automaton.bits(x) for x in forms[3::4])
                self.kinds[kind] = (automaton, scores[int(QUANTILE * len(scores))])
        self.others = Automaton(list(map(symbols, others)))
        self.least = min((LEASTS.get(k, ASSIGN_LEAST) for k in self.kinds), default=ASSIGN_LEAST)
        self.candidate = re.compile(rf"[A-Za-z0-9+/_.=-]{{{self.least},}}")

    def kind_of(self, candidate: str) -> str | None:
        form = symbols(candidate)
        if form in self.known:
            return self.known[form]
        if len(self.known) >= MAX_KNOWN:
            self.known.clear()
        found = self.decide(form)
        if len(form) <= 64:
            self.known[form] = found
        return found

    def decide(self, form: str) -> str | None:
        best = None
        for kind, (automaton, threshold) in self.kinds.items():
            bits = automaton.bits(form, threshold)
            if bits >= threshold and (best is None or bits > best[0]):
                best = (bits, kind)
        return best[1] if best and best[0] - self.others.bits(form) >= MARGIN else None


def added_spans(text: str, base: list[Span], grammar: Grammar) -> list[Span]:
    found: list[Span] = []
    if not grammar.kinds:
        return found

    def search(start: int, piece: str, level: int) -> None:
        bare = piece.rstrip(".=-")
        if len(bare) < grammar.least:
            return
        end = start + len(bare)
        free = not any(s < end and start < e for s, _, e in base)
        if free and (kind := grammar.kind_of(bare)):
            found.append((start, len(KINDS) + KINDS.index(kind), end))
            return
        for k in range(level, len(SEPARATORS)):
            if SEPARATORS[k] in bare:
                for part in bare.split(SEPARATORS[k]):
                    search(start, part, k + 1)
                    start += len(part) + 1
                return

    for m in grammar.candidate.finditer(text):
        search(m.start(), m[0], 0)
    return found


def written(spans: list[Span]) -> str:
    names = (*KINDS, *(f"like_{k}" for k in KINDS))
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def examples(docs: DataFrame, most: int = SAMPLE_PER_KIND) -> DataFrame:
    """kind, hash, value: of every kind the credentials with the least hash, ``most`` per task.

    Runs that are no credentials have kind ``other``; one is taken of each text, at a place that its hash chooses.
    """
    run = re.compile(rf"[A-Za-z0-9+/_.=-]{{{ASSIGN_LEAST},}}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, str]] = {}
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                found = [(KINDS[k], ASSIGN.match(text, s, e)[2] if k == 0 else text[s:e]) for s, k, e in base]
                place = xxhash.xxh3_64_intdigest(text.encode()) % max(1, len(text))
                if (m := run.search(text, place)) and not any(s < m.end() and m.start() < e for s, _, e in base):
                    found.append(("other", m[0]))
                for kind, value in found:
                    if len(value) <= LONGEST_EXAMPLE:
                        held.setdefault(kind, {})[xxhash.xxh3_64_intdigest(value.encode()) >> 1] = value
            for kind, values in held.items():
                if len(values) > most:
                    held[kind] = {h: values[h] for h in sorted(values)[:most]}
        rows = [(kind, h, v) for kind, values in held.items() for h, v in values.items()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays(columns, ["kind", "hash", "value"])

    return docs.select(text_of().alias("text")).mapInArrow(find, "kind string, hash long, value string")


def learn_grammar(docs: DataFrame) -> Grammar:
    """Learn from the different credentials of all texts that have the least hash, SAMPLE_PER_KIND of each kind."""
    ship_package(docs.sparkSession)
    order = F.expr("row_number() over (partition by kind order by hash, value)")
    least = examples(docs).distinct().withColumn("at", order).where(F.col("at") <= SAMPLE_PER_KIND)
    out: dict[str, list[str]] = {}
    for r in least.orderBy("kind", "at").collect():
        out.setdefault(r["kind"], []).append(r["value"])
    return Grammar({k: out.get(k, []) for k in KINDS}, out.get("other", []))


def scan(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_added, base (spans as text), spans."""
    ship_package(docs.sparkSession)
    types = pa.schema(
        [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in (*KINDS, "added")), ("base_sha256", pa.string()), ("spans", pa.string())]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop in slices(batch.column("text")):
                part, out = batch.slice(first, stop - first), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    base = base_spans(text)
                    more = added_spans(text, base, grammar)
                    tally = Counter(k for _, k, _ in base)
                    digest = hashlib.sha256(written(base).encode()).hexdigest()
                    out.append((doc_id, tally[0], tally[1], tally[2], len(more), digest, written(sorted(base + more))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), types)], schema=types)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_added long, base_sha256 string, spans string"
    return read.mapInArrow(find, schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, learn_grammar(docs))
