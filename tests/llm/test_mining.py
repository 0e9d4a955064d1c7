"""Operators 11 to 13 against brute force, and the cases every operator has to stand."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from contractflow.llm import op11_collocations as op11
from contractflow.llm import op12_simhash as op12
from contractflow.llm import op13_periodic_runs as op13

SCHEMA = "doc_id long, text string, lang string, rank int, phrase string, fp string, runs int, mask int, n long, k string, label int"


def table(spark, rows, parts=3):
    """Documents of (doc_id, text, lang), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "p", "f", 2, 3, 4, "k", 5) for r in rows], SCHEMA).repartition(parts)


def some_rows(seed=5):
    rng = random.Random(seed)
    rows = [(None, "a b a b", "en"), (None, None, None), (1, "", "en"), (2, "  \t\n ", None), (3, None, "en"), (3, "a b, a b", "en")]
    for i in range(40):
        words = rng.choices(["the", "The", "sea", "is", "deep", "é", "x,", "y.", "z\n"], k=rng.randrange(1, 60))
        rows.append((10 + i, " ".join(words), rng.choice(["en", "fr", None])))
    rows += [rows[-1]] * 3 + [(99, "long " * 30_000 + "tail", "fr")]
    return rows


# --- 11


def phrases_by_hand(rows, least, longest):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return {p: f for p, f in counts.items() if f >= least}, totals


def collocations_by_hand(rows, least, longest, top):
    frequent, totals = phrases_by_hand(rows, least, longest)
    out = {}
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        longer = [f for (x, w), f in frequent.items() if x == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(f >= a for f in longer):
            continue
        cuts = []
        for c in range(1, len(words)):
            l, r = frequent[lang, words[:c]], frequent[lang, words[c:]]
            cuts.append((1000 * a * totals[lang] // (l * r), c, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, k, p.decode(), -a, l, r, totals[lang], -s)
        for lang, found in out.items()
        for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


@pytest.mark.parametrize("rate", [0, 30, 100])
def test_collocations_whatever_the_sample(spark, rate):
    """With an empty sample every frequent word is a failure of the border, with a full one there is none."""
    rows = some_rows()
    found = op11.ranked(op11.collocations(op11.frequent_phrases(table(spark, rows), 4, 5, rate)), 7)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())
    assert got == collocations_by_hand(rows, 4, 5, 7)
    assert any(len(r[2].split()) == 5 for r in got) or rate != 100


def test_collocations_of_nothing(spark):
    nothing = table(spark, some_rows()).where("false")
    assert op11.collocations(op11.frequent_phrases(nothing)).collect() == []
    blank = table(spark, [(1, None, None), (2, "", "en")])
    assert op11.collocations(op11.frequent_phrases(blank, 1)).collect() == []


def test_scores_beyond_64_bits(spark):
    n = 10**15
    rows = [("en", "", n), ("en", "a", 10**13), ("en", "b", 10**12), ("en", "a b", 999_999_999_999)]
    frequent = spark.createDataFrame(rows, op11.SCHEMA)
    assert [r["score"] for r in op11.collocations(frequent).collect()] == [1000 * 999_999_999_999 * n // 10**25]


# --- 12


def fingerprint_by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components_by_hand(prints, radius=3):
    """Index of each print -> label, over all pairs."""
    label = list(range(len(prints)))
    kinds = sorted(set(prints))
    near = {x: [y for y in kinds if (x ^ y).bit_count() <= radius] for x in kinds}
    seen = {}
    for x in kinds:
        if x in seen:
            continue
        stack = [x]
        while stack:
            y = stack.pop()
            if y not in seen:
                seen[y] = x
                stack += near[y]
    return [seen[p] for p in prints]


def near_rows(seed=8):
    rng = random.Random(seed)
    rows = some_rows(seed)
    for family in range(4):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for i in range(40):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(150)] = f"x{rng.randrange(99)}"
            rows.append((1000 * (family + 1) + i, " ".join(copy), "en"))
    return rows


@pytest.mark.parametrize("block", [1024, 5])
def test_simhash_brute_force(spark, block):
    rows = near_rows()
    prints = [fingerprint_by_hand(t) for _, t, _ in rows]
    labels = components_by_hand(prints)
    assert len(set(labels)) < len(set(prints))
    least = {}
    for (d, _, _), c in zip(rows, labels):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    want = sorted(((d, p, least.get(c)) for (d, _, _), p, c in zip(rows, prints, labels)), key=repr)
    found = op12.simhash_components(table(spark, rows), block=block).collect()
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found), key=repr)
    assert got == want


def test_simhash_shards_lose_no_link():
    rng = random.Random(1)
    for nodes, depth in ((10, 0), (1000, 16), (10**8, 28), (10**12, 37)):
        masks = op12.masks(nodes)
        assert min(m.bit_count() for m in masks) == depth
        for _ in range(2000):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 3):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_simhash_of_nothing(spark):
    nothing = table(spark, some_rows()).where("false")
    assert op12.simhash_components(nothing).collect() == []


# --- 13


def runs_by_hand(words, least=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s = words[i : j + q]
            if len(s) >= max(least, times * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_rows(seed=2):
    rng = random.Random(seed)
    rows = some_rows(seed)
    for i in range(120):
        words = [f"{rng.randrange(rng.choice([2, 3, 50]))}" for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            at, q, length = rng.randrange(len(words) + 1), rng.randrange(1, 30), rng.randrange(20, 120)
            piece = [f"{rng.randrange(9)}" for _ in range(q)]
            words[at:at] = (piece * length)[:length]
        rows.append((500 + i, " ".join(words), "en"))
    return rows


@pytest.mark.parametrize("least, times", [(24, 3), (4, 3), (8, 5)])
def test_periodic_runs_brute_force(spark, least, times):
    rows = [r for r in periodic_rows() if len(r[1] or "") < 5000]
    found = op13.periodic_runs(table(spark, rows), least, times).collect()
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=repr)
    want = []
    for d, text, _ in rows:
        words = (text or "").encode().split()
        runs = runs_by_hand(words, least, times)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((d, len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert got == sorted(want, key=repr)


def test_periodic_query_plants_and_digests(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(90)), "en") for i in range(60)]
    rows += [(100, "a b c " * 40 + "x " + "d e " * 60, "en"), (None, "q " * 40, "en"), (101, None, None), (102, "", "en"), (103, "long " * 200_000, "en")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in op13.op13_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for d, text, _ in rows:
        words = (text or "").split()
        h, n = (op13.zlib.crc32(str(d).encode()) if d is not None else 1), len(words)
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        r = found[d]
        if n > 5000:
            assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (1, 0, n, 1, 1000 * n)
            continue
        runs = runs_by_hand(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert planted


def test_periodic_runs_of_nothing(spark):
    nothing = table(spark, some_rows()).where("false")
    assert op13.periodic_runs(nothing).collect() == []
    assert op13.periodic_runs(table(spark, [(1, None, None)])).select(F.size("runs")).first()[0] == 0
