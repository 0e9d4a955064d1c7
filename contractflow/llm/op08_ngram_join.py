"""N-gram Jaccard join: MinHash banding, then verification on the full sets of word n-grams.

Documents with the same set of n-grams are one node, however many they are.  The number of bands follows
from the threshold and the recall wanted for a pair right at it; nodes are shuffled on their band hashes,
and nodes that share a band hash are a bucket.  Candidates of a bucket of up to SMALL nodes are all its pairs.
In a larger one every node is compared with the bucket's hub, the node that shares most buckets with
others.  Pairs are verified on the full sets, and links make classes.  What is then still open, larger buckets
that hold nodes of different classes, is compared exactly, in units of two blocks of BLOCK nodes: a unit counts
common n-grams over postings, in its task, and sends only links that join classes.  So no two linked nodes
that share a bucket end in different classes, and the pairs of a family of thousands of near copies are never
listed.

The class of a document is the smallest doc_id of its connected component.  n_links is the number of other
nodes, that is of different texts, with the similarity; it is counted in the same kind of units over each class,
so also where two members share no bucket.  Counting all links takes work with the square of a family's size,
spread over units of bounded memory; what is shuffled grows with its size times its number of blocks.

Words are runs without white space, unchanged.  A text of fewer than five words has one n-gram, all of
it; a text without words has none, and is a class of its own.  Null is empty.  Null ids sort last.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import KEY, look_up, text_of, with_key
from contractflow.llm.components import components
from contractflow.llm.encoding import release, slices
from contractflow.storage import cut_lineage, ship_package

N = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 160
SMALL = 16
BLOCK = 512
MAX_WORDS = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the longest bands that reach the recall at the threshold with ``most`` hashes."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


class Codes(dict):
    """Word -> 64-bit hash; forgets all when it holds MAX_WORDS words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def ngrams(text: str, codes: Codes, n: int = N) -> np.ndarray:
    """The set of n-gram hashes of a text, sorted."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    c = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = max(1, len(c) - n + 1)
    total = np.full(size, len(c) if len(c) < n else n, dtype=np.uint64)
    for k in range(min(n, len(c))):
        total = mixed(total * MIX + c[k : k + size])
    return np.unique(total)


def min_hashes(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.empty(len(factors), dtype=np.uint64)
    step = max(1, (1 << 18) // len(grams))
    for k in range(0, len(factors), step):
        hashed = np.multiply.outer(factors[k : k + step], grams)
        hashed += offsets[k : k + step, None]
        out[k : k + step] = hashed.min(axis=1)
    return out


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """row, key, doc_id, digest of the n-gram set (null without words), n_grams and band hashes, stored."""
    names = ["row", *KEY, "doc_id"]
    types = pa.schema(
        [("row", pa.int64()), (KEY[0], pa.string()), (KEY[1], pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n_grams", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rng = np.random.default_rng(20)
        factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offsets = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        codes = Codes()
        for batch in batches:
            for first, end in slices(batch.column("text")):
                part = batch.slice(first, end - first)
                digests, sizes, hashes = [], [], []
                for text in part.column("text").to_pylist():
                    grams = ngrams(text, codes, n)
                    sizes.append(len(grams))
                    if not len(grams):
                        digests.append(None)
                        hashes.append(None)
                        continue
                    digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                    table = mixed(min_hashes(grams, factors, offsets)).reshape(bands, rows)
                    total = np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        total = mixed(total * MIX + table[:, k])
                    hashes.append(total.view(np.int64))
                columns = [part.column(c) for c in names] + [
                    pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=types)

    read = with_key(docs).select(
        F.monotonically_increasing_id().alias("row"), *KEY, F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")
    )
    schema = f"row long, `{KEY[0]}` string, `{KEY[1]}` long, doc_id long, digest binary, n_grams long, bands array<long>"
    return cut_lineage(read.mapInArrow(sign, schema))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, n: int = N) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold, stored; ``texts`` (node, text) is stored."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, last = Codes(), (None, None)
        for batch in batches:
            keep = []
            for i, (a, text_a, text_b) in enumerate(
                zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"))
            ):
                if last[0] != a:
                    last = (a, ngrams(text_a.as_py(), codes, n))
                x, y = last[1], ngrams(text_b.as_py(), codes, n)
                both = len(np.intersect1d(x, y, assume_unique=True))
                # a / b >= t without rounding of the quotient
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return cut_lineage(joined.mapInArrow(verify, "a long, b long"))


def ordered_pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def crossing(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label, cluster: nodes of buckets that hold different classes, and what such buckets connect."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("first"))
    held = cut_lineage(named.join(split.where("low < high").select("band", "first"), "band").select("node", "label", "first"))
    clusters = components(held.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())
    return cut_lineage(held.select("node", "label").distinct().join(clusters.withColumnRenamed("label", "cluster"), "node"))


def similar_pairs(table: pa.Table, threshold: float, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of one unit (i, j) every row with the rows before it that are similar; if i and j differ, across blocks only.

    Common n-grams are counted over postings, row by row, so memory is that of the sets.
    """
    codes = Codes()
    sets = [ngrams(t.as_py(), codes, n) for t in table.column("text")]
    blocks = table.column("block").to_numpy()
    across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    sizes = np.array([len(x) for x in sets])
    grams, place = np.unique(np.concatenate(sets), return_inverse=True)
    postings = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]
    ends = np.cumsum(np.bincount(place, minlength=len(grams)))
    starts = np.concatenate(([0], ends[:-1]))
    for x, own in enumerate(np.split(place, np.cumsum(sizes)[:-1])):
        length = ends[own] - starts[own]
        skip = starts[own] - np.cumsum(length) + length
        common = np.bincount(postings[np.repeat(skip, length) + np.arange(length.sum())], minlength=len(sets))[:x]
        similar = common >= threshold * (sizes[x] + sizes[:x] - common) - 1e-9
        if across:
            similar &= blocks[:x] != blocks[x]
        if similar.any():
            yield x, np.flatnonzero(similar)


def joining_links(table: pa.Table, threshold: float, n: int) -> pa.Table:
    """Links between different classes of one unit; enough of them to join all that are linked."""
    nodes, root = table.column("node").to_pylist(), table.column("label").to_pylist()
    above: dict[int, int] = {}

    def find(x: int) -> int:
        while x in above:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    out = []
    for x, similar in similar_pairs(table, threshold, n):
        for y in similar.tolist():
            p, q = find(root[x]), find(root[y])
            if p != q:
                above[max(p, q)] = min(p, q)
                out.append(sorted((nodes[x], nodes[y])))
    return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate("ab")})


def link_counts(table: pa.Table, threshold: float, n: int) -> pa.Table:
    """Number of links of every node inside one unit."""
    counts = np.zeros(table.num_rows, dtype=np.int64)
    for x, similar in similar_pairs(table, threshold, n):
        counts[x] += len(similar)
        counts[similar] += 1
    return pa.table({"node": table.column("node"), "n_links": counts})


def units(nodes: DataFrame, cluster: str, texts: DataFrame):
    """Rows (node, label, block, text) grouped into units (i, j) of one or two blocks of a cluster."""
    sizes = nodes.groupBy(cluster).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = nodes.join(sizes, cluster).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    placed = block.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        F.col(cluster).alias("of"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label"
    )
    return placed.join(texts, "node").groupBy("of", "i", "j")


def size_allows(x: str, y: str, threshold: float) -> str:
    return f"least({x}, {y}) >= {threshold} * greatest({x}, {y})"


def hub_pairs(members: DataFrame) -> DataFrame:
    """Pairs of every member with its bucket's hub."""
    best = members.groupBy("band").agg(F.max(F.struct("shared", "node")).alias("hub"))
    joined = members.join(best.select("band", F.col("hub.node").alias("hub")), "band")
    return joined.where("node <> hub").select(*ordered_pairs("node", "hub"))


def near_labels(docs: DataFrame, threshold: float, recall: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """Signatures, nodes, the label of each linked node, the texts of nodes in buckets, and the number of documents.

    All of them are stored.  No link is counted for this.
    """
    ship_package(docs.sparkSession)
    bands, rows = bands_for(threshold, recall)
    signed = signatures(docs, bands, rows, n)
    total = signed.count()
    nodes = cut_lineage(
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    )
    own = signed.select(F.col("row").alias("node"), *KEY, "n_grams", "bands").join(nodes.select("node"), "node", "left_semi")
    placed = own.select("node", "n_grams", F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut_lineage(look_up(placed, buckets, "band", "size", total).where("size is not null"))
    shared = members.groupBy("node").agg(F.sum("size").alias("shared"))

    small = members.where(F.col("size") <= SMALL)
    others = small.select("band", F.col("node").alias("other"), F.col("n_grams").alias("other_grams"))
    listed = small.join(others, "band").where(f"node < other and {size_allows('n_grams', 'other_grams', threshold)}")
    large = cut_lineage(members.where(F.col("size") > SMALL).join(shared, "node"))
    pairs = cut_lineage(
        listed.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(hub_pairs(large)).distinct()
    )

    # the text of every node in a bucket, found again by its key
    wanted = own.join(members.select("node").distinct(), "node", "left_semi").select("node", *KEY)
    texts = cut_lineage(
        with_key(docs).select(*KEY, text_of().alias("text")).join(wanted, KEY).dropDuplicates(["node"]).select("node", "text")
    )
    links = verified(pairs, texts, threshold, n)
    labels = components(links)
    open_nodes = crossing(large, labels)
    if not open_nodes.isEmpty():
        found = units(open_nodes, "cluster", texts).applyInArrow(lambda t: joining_links(t, threshold, n), "a long, b long")
        links = links.unionByName(cut_lineage(found.distinct()))
        labels = components(links)
    return signed, nodes, labels, texts, total


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """One row per document: key, row, doc_id, class_id, label, n_links, n_copies."""
    signed, nodes, labels, texts, total = near_labels(docs, threshold, recall, n)
    counted = units(labels, "label", texts).applyInArrow(lambda t: link_counts(t, threshold, n), "node long, n_links long")
    degree = counted.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    named = cut_lineage(nodes.join(labels, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node")))
    classes = named.groupBy("label").agg(F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("in_class"))
    by_digest = look_up(named, classes, "label", "in_class", total).select(
        "digest", "label", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies"
    )
    known = look_up(signed.drop("bands"), cut_lineage(by_digest), "digest", "copies", total)
    alone = F.col("digest").isNull()
    return known.select(
        *KEY,
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("row")).otherwise(F.col("label")).alias("label"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the smallest id of their class, with all their columns; one row per class.

    Of rows with equal n-grams the first of the smallest id stands for the others; nulls come last.
    """
    signed, _, labels, _, _ = near_labels(docs, threshold, RECALL, N)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row", *KEY)
    # reduced before the shuffle twice: to one row per set of n-grams, then to one per class
    of_digest = signed.groupBy(F.coalesce("digest", F.col("row").cast("string").cast("binary")).alias("digest")).agg(
        F.min("row").alias("node"), F.min(order).alias("k")
    )
    of_class = of_digest.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("k").alias("k"))
    keys = of_class.select(*(F.col(f"k.{c}").alias(c) for c in KEY))
    return with_key(docs).join(keys, KEY, "left_semi").dropDuplicates(KEY).drop(*KEY)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_classes(docs).select("doc_id", "class_id", "n_links", "n_copies")
