"""Encoding with a public tokenizer, remembering the units that a text falls into.

Both tokenizers used here cut a text before they merge, and never look back across a cut.  So a text's
ids are the ids of its units, one after the other, and a unit met before need not be encoded again.
A new unit of printable ASCII and Latin letters is cut here, into the pieces that the tokenizer would
cut it into, and only its merges are asked for; any other goes to the tokenizer as it is.
"""

from __future__ import annotations

import ctypes
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Units kept per worker process, and the longest unit worth keeping.
MAX_UNITS = 250_000
LONGEST_UNIT = 64
# Pieces of plain words kept by WordIds, and those that one call of the library merges.
MAX_PIECES = 250_000
MERGED_AT_ONCE = 10_000
# Bytes of text that one step works on.
STEP_BYTES = 1 << 20

_loaded: dict[str, object] = {}
_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """What a worker keeps from task to task; one thing at a time, as workers outlive the stages of a pipeline.

    A function of the module: what is sent with a task has its own copy of the variables that it names.
    """
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Forget what earlier tasks have left, before a stage that keeps nothing but needs the memory."""
    _held.clear()
    _loaded.clear()
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: an idle worker's counts against its executor, and the next stage's adds to it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def load(path: str):
    """The tokenizer of a file, once per process, on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


# The cuts of both tokenizers, for the characters of PLAIN.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
PLAIN = re.compile(f"[!-~{LETTERS}]+")
SPACED_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ {LETTERS}0-9]+")
WORD_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Units:
    """Key of a unit -> value of its ids.

    ``value`` makes the value from ids and ``join`` the value of several pieces; ``lead`` stands in front
    of a unit in a text, and ``cut`` and ``fold`` are what the tokenizer does to a plain one.
    """

    def __init__(self, path: str, value, join, lead: str, cut: re.Pattern, fold=str):
        self.tokenizer, self.value, self.join = load(path), value, join
        self.lead, self.cut, self.fold = lead, cut, fold
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.known: dict = {}
        self.pieces: dict = {}

    def mapped(self, text: str) -> str:
        return text.replace(" ", self.alphabet[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)

    def piece(self, text: str):
        found = self.pieces.get(text)
        if found is None:
            found = self.value([t.id for t in self.merge(self.mapped(text))])
            if len(self.pieces) >= MAX_UNITS:
                self.pieces.clear()
            self.pieces[text] = found
        return found

    def unit(self, text: str):
        if text.isascii() and text.isalpha():
            return self.piece(self.lead + self.fold(text))
        folded = self.fold(text)
        # some plain letters fold to one that the cut does not know
        if PLAIN.fullmatch(text) and "<|" not in text and (folded is text or PLAIN.fullmatch(folded)):
            return self.join(map(self.piece, self.cut.findall(self.lead + folded)))
        return self.encode(self.lead + text)

    def learn_all(self, keys: set) -> None:
        """Make all ``keys`` known.  Others may be forgotten."""
        new = keys.difference(self.known)
        if len(self.known) + len(new) > MAX_UNITS:
            self.known.clear()
            new = keys
        for key in new:
            self.known[key] = self.unit(key)

    def encode(self, text: str):
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Packed ids of words that ASCII white space parts, for a tokenizer that drops it and folds case.

    Plain words without an apostrophe are cut all at once, on their bytes: a piece begins where the kind of
    character changes, and at every digit.  Any other word goes to :class:`Units`.
    """

    # kinds of bytes in a folded plain word; those of two and three bytes are letters
    OTHER, DIGIT, LETTER = range(3)
    KINDS = np.full(256, OTHER, np.uint8)
    KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = LETTER
    KINDS[0x80:] = LETTER
    KINDS[list(b"0123456789")] = DIGIT

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.units = Units(path, packed, b"".join, "", WORD_CUT, str.lower)
        # the merges alone: pieces are cut and folded before
        self.merges = Tokenizer(self.units.tokenizer.model)
        self.known: dict[str, bytes] = {}

    def pieces(self, texts: list[str]) -> list[bytes]:
        """Packed ids of pieces that differ; without room for the new ones, all but those asked for here are forgotten."""
        found = list(map(self.known.get, texts))
        new = [i for i, v in enumerate(found) if v is None]
        if len(self.known) + len(new) > MAX_PIECES:
            self.known = {t: v for t, v in zip(texts, found) if v is not None}
        for at in range(0, len(new), MERGED_AT_ONCE):
            some = new[at : at + MERGED_AT_ONCE]
            merged = self.merges.encode([self.units.mapped(texts[i]) for i in some], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(merged.ids, "<u4").tobytes()
            ends = np.cumsum(4 * np.bincount(np.array(merged.word_ids, np.int64), minlength=len(some))).tolist()
            for i, begin, end in zip(some, [0, *ends], ends):
                found[i] = self.known[texts[i]] = ids[begin:end]
        return found

    def ids(self, words: pa.Array) -> pa.Array:
        """Packed ids of each of the ``words``, which should differ, as large binary."""
        words = words.cast(pa.large_string())
        cuttable = pc.and_(
            pc.and_(pc.match_substring_regex(words, f"^[!-&(-~{LETTERS}]*$"), pc.less_equal(pc.binary_length(words), LONGEST_UNIT)),
            pc.invert(pc.match_substring(words, "<|")),
        )
        others = words.filter(pc.invert(cuttable)).to_pylist()
        if not others:
            return self.cut(words)
        short = {w for w in others if len(w) <= LONGEST_UNIT}
        self.units.learn_all(short)
        found = [self.units.known[w] if w in short else self.units.encode(w) for w in others]
        # back in the order of the words
        mask = cuttable.to_numpy(zero_copy_only=False)
        at = np.where(mask, np.cumsum(mask) - 1, len(words) - len(others) + np.cumsum(~mask) - 1)
        return pa.concat_arrays([self.cut(words.filter(cuttable)), pa.array(found, pa.large_binary())]).take(pa.array(at))

    def cut(self, words: pa.Array) -> pa.Array:
        """Packed ids of plain words without an apostrophe."""
        if not pc.any(pc.greater(pc.binary_length(words), 0)).as_py():
            return pa.array([b""] * len(words), pa.large_binary())
        folded = pc.utf8_lower(words)
        _, ends, data = folded.buffers()
        ends = np.frombuffer(ends, np.int64)[folded.offset : folded.offset + len(folded) + 1]
        kinds = self.KINDS[np.frombuffer(data, np.uint8)[: ends[-1]]]
        first = kinds == self.DIGIT
        first[1:] |= kinds[1:] != kinds[:-1]
        first[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.append(np.flatnonzero(first), len(kinds))
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), data]).dictionary_encode()
        values = pa.array(self.pieces(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        flat = values.take(pieces.indices)
        _, bounds, data = flat.buffers()
        # a word's ids lie between those of its first piece and the next word's
        bounds = np.frombuffer(bounds, np.int64)[flat.offset :][np.searchsorted(starts, ends)]
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds), data])


def slices(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each; a longer text stands alone."""
    sizes = np.zeros(len(column), dtype=np.int64)
    if len(column):
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(column):
        yield start, len(column)


class SpacedCounts:
    """Counts tokens of a byte-level BPE whose cuts attach one space to the word behind it.

    Between two characters that aren't white space, a single space always starts a new cut, so a text
    without other spaces is the list of its words with their space.
    """

    def __init__(self, path: str):
        self.units = Units(path, len, sum, " ", SPACED_CUT)

    def counts(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") for t in texts]
        words = set().union(*split)
        # a space next to white space, or at an end: such texts are encoded as a whole
        uneven = {u for u in words if not u or u[0].isspace() or u[-1].isspace()}
        long = {u for u in words if len(u) > LONGEST_UNIT and u not in uneven}
        words -= uneven
        words -= long
        self.units.learn_all(words)
        known, encode = self.units.known, self.units.encode
        extra = {u: encode(" " + u) for u in long}
        out = []
        for text, units in zip(texts, split):
            if not uneven.isdisjoint(units):
                out.append(encode(text))
            elif long.isdisjoint(units):
                out.append(encode(units[0]) + sum(map(known.__getitem__, units[1:])))
            else:
                out.append(encode(units[0]) + sum(known[u] if u in known else extra[u] for u in units[1:]))
        return out
