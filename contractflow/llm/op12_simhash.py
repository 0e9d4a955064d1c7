"""SimHash near-duplicates, found with BK-trees.

A text's fingerprint has 64 bits: those set in over half the XXH64 values (seed 42) of its three-word shingles, repeats
counted.  Documents whose fingerprints differ in at most RADIUS bits are linked, and a component is what links
join.  Equal fingerprints are one node, however many documents have them.

Shards.  If the bits are cut into RADIUS + 1 blocks, two linked fingerprints agree in one block at least, so a shard
is the nodes that agree in one block.  Where that leaves over SHARD nodes a shard on average, the bits that are left
are cut again, and a shard agrees in a block of these as well; no link is ever lost.

Trees.  Every shard gets a BK-tree: a node's children are keyed by their distance to it.  A search that is d
away from a node follows only the edges d - RADIUS to d + RADIUS.  The trees of all the fingerprints are too much for
a broadcast, so a shard's nodes meet by a shuffle.  A shard of more than BLOCK nodes, such as a large family
of near copies, is cut into blocks, and the tree of each block is sent to all blocks of the same shard, so that
every task's memory is that of two blocks.

Links.  A search keeps only links between nodes not yet joined in its task; so a dense family sends fewer links
than it has nodes, from each unit of two blocks.  The work in a family of n different fingerprints grows with n * n / 2
distances at worst, over (n / BLOCK)^2 / 2 units.

Text is lower-cased in A-Z only; words are runs other than ASCII white space.  A text of one or two words has one
shingle, all of it.  Texts without words, null among them, have fingerprint zero, which is linked like any other.
A component is named by its smallest doc_id; null ids count only where no other is there, and repeated rows are rows of
their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import look_up, text_of
from contractflow.llm.components import components
from contractflow.llm.encoding import slices
from contractflow.operators.bounded import lookup_join
from contractflow.storage import cut_lineage, ship_package

BITS = 64
RADIUS = 3
WORDS = 3
SEED = 42
SHARD = 64
BLOCK = 1024
# searches that go through the trees of a batch together
SEARCHES = 2048
# hashes whose bits are counted in one step
STEP = 1 << 15
# what a row of a unit is for
BOTH, TREE, SEARCH = range(3)


def fingerprint(text: str, n: int = WORDS) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[min(n, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype="<u8", count=len(stops))
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), STEP):
        part = hashes[k : k + STEP].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number; stored."""
    ship_package(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in slices(batch.column("text")):
                part = batch.slice(first, end - first)
                found = np.array([fingerprint(t.as_py(), n) for t in part.column("text")], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return cut_lineage(read.mapInArrow(sign, "doc_id long, fp long"))


def masks(nodes: int, radius: int = RADIUS, shard: int = SHARD) -> list[int]:
    """Sets of bits such that fingerprints within the radius agree in one of them, for shards of this size on average."""
    found = [0]
    while nodes > shard << min(m.bit_count() for m in found) and found[0].bit_count() + radius < BITS:
        found = [m | block for m in found for block in cut_bits(~m & (1 << BITS) - 1, radius + 1)]
    return found


def cut_bits(bits: int, parts: int) -> list[int]:
    """The set bits in this many blocks of about equal size."""
    places = [k for k in range(BITS) if bits >> k & 1]
    return [sum(1 << k for k in block.tolist()) for block in np.array_split(np.array(places, dtype=object), parts)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def units(nodes: DataFrame, total: int, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """unit, role, fp: what has to be compared, in units of at most two blocks of a shard.

    Units are told apart by a hash; should two share one, more is compared and nothing is lost.
    """
    listed = ", ".join(f"{signed(m)}L" for m in masks(total, radius))
    placed = nodes.selectExpr("fp", f"explode(array({listed})) as mask").selectExpr("fp", "xxhash64(mask, fp & mask) as shard")
    sizes = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > block).selectExpr("shard", f"cast(ceil(n / {block}) as int) as blocks"))
    cut = lookup_join(placed, large, ["shard"]).selectExpr(
        "fp", "shard", "coalesce(blocks, 1) as blocks", "cast(pmod(xxhash64(fp, 'block'), coalesce(blocks, 1)) as int) as own"
    )
    paired = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    role = f"case when own = other then {BOTH} when own < other then {TREE} else {SEARCH} end"
    return paired.selectExpr("xxhash64(shard, least(own, other), greatest(own, other)) as unit", f"{role} as role", "fp")


class Forest:
    """BK-trees of many units, grown side by side; ``tree`` are the rows of the trees."""

    def __init__(self, values: np.ndarray, unit: np.ndarray, tree: np.ndarray, radius: int):
        self.values, self.radius = values, radius
        # columns on both sides stay empty, for edges below 0 and above BITS
        self.width = BITS + 1 + 2 * radius
        self.children = np.full(len(values) * self.width, -1, dtype=np.int32)
        units, first = np.unique(unit[tree], return_index=True)
        place = np.minimum(np.searchsorted(units, unit), max(0, len(units) - 1))
        self.root = np.full(len(values), -1, dtype=np.int64)
        if len(units):
            has = units[place] == unit
            self.root[has] = tree[first][place[has]]
        rows = np.setdiff1d(tree, tree[first], assume_unique=True)
        above = self.root[rows]
        while len(rows):
            slot = self.slots(rows, above)
            taken, first = np.unique(slot, return_index=True)
            free = self.children[taken] < 0
            self.children[taken[free]] = rows[first[free]]
            below = self.children[slot]
            goes_on = below != rows
            rows, above = rows[goes_on], below[goes_on].astype(np.int64)

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.values[a] ^ self.values[b]).astype(np.int64)

    def slots(self, a: np.ndarray, node: np.ndarray) -> np.ndarray:
        return node * self.width + self.radius + self.distance(a, node)

    def near(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a searching row and a row of its unit's tree within the radius."""
        edges = np.arange(-self.radius, self.radius + 1)
        rows = rows[self.root[rows] >= 0]
        for k in range(0, len(rows), SEARCHES):
            searching = rows[k : k + SEARCHES]
            node = self.root[searching]
            while len(searching):
                slot = self.slots(searching, node)
                hit = (slot - node * self.width <= 2 * self.radius) & (searching != node)
                yield searching[hit], node[hit]
                below = self.children[slot[:, None] + edges]
                follows = below >= 0
                searching = np.repeat(searching, follows.sum(axis=1))
                node = below[follows].astype(np.int64)


class Joined:
    """Which rows of a batch are joined by the links so far."""

    def __init__(self, rows: int):
        self.label = np.arange(rows)

    def joining(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the links (a, b) some that join all rows that these links join."""
        p, q = self.label[a], self.label[b]
        low, high = np.minimum(p, q), np.maximum(p, q)
        kinds, first = np.unique(low * len(self.label) + high, return_index=True)
        first = first[low[first] != high[first]]
        if not len(first):
            return a[:0], b[:0]
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                above[x] = above.get(above[x], above[x])
                x = above[x]
            return x

        used = []
        for k, x, y in zip(first.tolist(), low[first].tolist(), high[first].tolist()):
            x, y = top(x), top(y)
            if x != y:
                above[max(x, y)] = min(x, y)
                used.append(k)
        names = np.arange(len(self.label))
        names[list(above)] = [top(x) for x in above]
        self.label = names[self.label]
        return a[used], b[used]


def links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between fingerprints that join all those within the radius that share a unit."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            unit = table.column("unit").to_numpy()
            # the last unit may go on in the next batch
            whole = int(np.searchsorted(unit, unit[-1]))
            held = table.slice(whole).to_batches()
            yield links_of(table.slice(0, whole), radius)
        if held:
            yield links_of(pa.Table.from_batches(held), radius)

    dealt = rows.repartition("unit").sortWithinPartitions("unit", "fp")
    return dealt.mapInArrow(search, "a long, b long")


def links_of(table: pa.Table, radius: int) -> pa.RecordBatch:
    """The joining links of whole units, whose rows stand together."""
    unit, role, fp = (table.column(c).to_numpy() for c in ("unit", "role", "fp"))
    new = np.ones(len(unit), dtype=bool)
    new[1:] = unit[1:] != unit[:-1]
    of = np.cumsum(new) - 1
    several = np.bincount(of, minlength=1)[of] > 1 if len(of) else new
    unit, role, fp = of[several], role[several], fp[several]
    forest = Forest(fp.view(np.uint64), unit, np.flatnonzero(role != SEARCH), radius)
    joined, found = Joined(len(fp)), []
    for a, b in forest.near(np.flatnonzero(role != TREE)):
        found.append(joined.joining(a, b))
    a = np.concatenate([fp[x] for x, _ in found]) if found else fp[:0]
    b = np.concatenate([fp[y] for _, y in found]) if found else fp[:0]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def simhash_components(docs: DataFrame, radius: int = RADIUS, n: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fp, component_id, copies (documents with the same fingerprint)."""
    found = fingerprints(docs, n)
    nodes = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")))
    sizes = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    pairs = cut_lineage(links(units(nodes.select("fp"), sizes["nodes"], radius, block), radius).distinct())
    labels = components(pairs)
    named = cut_lineage(
        nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    )
    classes = named.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("in_class"))
    by_fp = look_up(named, classes, "label", "in_class", sizes["rows"]).select("fp", "component_id", "copies")
    return look_up(found, cut_lineage(by_fp), "fp", "copies", sizes["rows"]).select("doc_id", "fp", "component_id", "copies")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
