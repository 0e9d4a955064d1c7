"""Sharding by a k-d tree over metadata, with leaves of nearly equal bytes.

The tree starts with one node that holds all shards.  A node with k shards is cut into floor(k/2) and
ceil(k/2) along the dimension in which its rows are spread widest, at the point that gives each side its share of
the bytes (the weighted median when the halves are equal), until every node is one shard.  A side's share is taken of
the bytes its node really has, so the error of a cut is shared out among all shards below it.

Equal texts stay together.  They get one position, the least of their values in every dimension, and a cut falls
beside a position, never into it.  Only a group that weighs more than HEAVY of a shard is laid out as several
positions of about that weight, next to each other: such a group is cut where a shard is full, and nowhere
else.  So no cut is further from its point than half of HEAVY of a shard, or half the document that lies there.

All nodes of a level are worked on at once.  Coordinates are 62-bit integers: the value of the
dimension above, a hash of the text and the place in its group below.  A cut is found by radix: histograms of
CELLS cells per node over the stored metadata, each round inside the cell that holds the cut, until that cell
is light or one value wide.  Only the histogram cell and the bounds of each node (at most one per shard) reach the
driver.  The finished tree has one node fewer than there are shards and is applied as one expression, so rows are
never moved for it.

Size is the UTF-8 bytes of the text (null: none) plus 16; null counts as the empty text.  Null metadata is a value of
its own.  With fewer rows than shards some shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractflow.llm.common import look_up, number_within, text_of
from contractflow.operators.fence import fenced
from contractflow.storage import cut_lineage

SHARDS = 40
OVERHEAD = 16
CELLS = 32768
# a cut may be off by this part of a shard
TOLERANCE = 0.0005
# a group of equal texts that weighs more than this part of a shard may be cut
HEAVY = 1 / 16
# coordinates per value of a dimension, and those of one text among them
TIES = 1 << 31
PLACES = 1 << 15

# name -> expression of a value in [0, 2^31); numbers by magnitude, names by hash
DIMENSIONS = {
    "length": "cast(ln(size) * 40000000 as bigint)",
    "chars": "if(n_chars is null or n_chars < 0, 0, cast(ln(n_chars + 2) * 40000000 as bigint))",
    "source": "if(source is null, 0, pmod(xxhash64(source), 2147483648))",
    "lang": "if(lang is null, 0, pmod(xxhash64(lang), 2147483648))",
}


def metadata(docs: DataFrame, dimensions: dict[str, str], shards: int) -> DataFrame:
    """doc_id, row, size, text_crc32 and one coordinate per dimension; the only pass over the texts, stored."""
    text = text_of()
    sized = docs.withColumns(
        {
            "size": (F.octet_length(text) + OVERHEAD).cast("long"),
            "__crc": F.crc32(text.cast("binary")),
            "__text": F.xxhash64(text),
            "__row": F.monotonically_increasing_id(),
        }
    )
    values = [F.expr(f"cast(least({e}, 2147483647) as bigint)").alias(f"axis_{n}") for n, e in dimensions.items()]
    own = cut_lineage(sized.select("doc_id", F.col("__row").alias("row"), "size", F.col("__crc").alias("text_crc32"), F.col("__text").alias("text"), *values))
    return cut_lineage(with_positions(own, [f"axis_{n}" for n in dimensions], shards))


def with_positions(own: DataFrame, axes: list[str], shards: int) -> DataFrame:
    """Coordinates instead of values: those of a text's copies are the same, or next to each other if they weigh much."""
    total = own.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    heavy = max(1, int(HEAVY * total["bytes"] / shards))
    groups = own.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes"), *[F.min(a).alias(f"least_{a}") for a in axes])
    several = cut_lineage(groups.where("copies > 1"))
    found = look_up(own, several, "text", "copies", total["rows"])
    places = f"least({PLACES}, ceil(coalesce(bytes, 0) / {heavy}))"
    tie = f"(pmod(text, {TIES // PLACES}) * {PLACES} + pmod(xxhash64(row), greatest(1, {places})))"
    coordinates = [F.expr(f"coalesce(least_{a}, {a}) * {TIES} + {tie}").alias(a) for a in axes]
    return found.select("doc_id", "row", "size", "text_crc32", *coordinates)


class Node:
    """A node of the tree: its shards and bytes, the box of its rows; once it is cut, the axis, the first value right of it, two children."""

    def __init__(self, first: int, shards: int, n_bytes: int):
        self.first, self.shards, self.n_bytes = first, shards, n_bytes
        self.box: dict[str, tuple[int, int]] = {}
        self.axis = ""
        self.cut = 0
        self.children: tuple[Node, Node] | None = None

    def expression(self) -> str:
        """SQL for the first shard of the undivided node that a row falls into."""
        if self.children is None:
            return str(self.first)
        left, right = (c.expression() for c in self.children)
        return f"if({self.axis} < {self.cut}L, {left}, {right})"

    def divide(self, cut: int, left_bytes: int) -> None:
        self.cut, half = cut, self.shards // 2
        self.children = (
            Node(self.first, half, left_bytes),
            Node(self.first + half, self.shards - half, self.n_bytes - left_bytes),
        )


def find_boxes(placed: DataFrame, nodes: list[Node], axes: list[str]) -> None:
    """Bounds of the rows of every node in each dimension."""
    bounds = [f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)]
    found = {r["node"]: r for r in placed.groupBy("node").agg(*bounds).collect()}
    for node in nodes:
        r = found.get(node.first)
        node.box = {a: (r[f"min_{a}"], r[f"max_{a}"]) if r else (0, 0) for a in axes}


def find_cuts(placed: DataFrame, nodes: list[Node], span: dict[str, int], tolerance: float) -> None:
    """Divide every given node; column ``node`` of ``placed`` is the first shard of a row's node."""
    spark, axes = placed.sparkSession, list(span)
    # per node: values from low to high hold the cut, and what lies below low weighs less than wanted
    searched: dict[int, tuple[Node, int, int, int]] = {}
    for node in nodes:
        node.axis = max(axes, key=lambda a: (node.box[a][1] - node.box[a][0]) / span[a])
        searched[node.first] = (node, *node.box[node.axis], 0)
    by_axis = "case axis " + " ".join(f"when '{a}' then {a}" for a in axes) + " end"
    while searched:
        # one row per node: the same plan each round, so its code is compiled once
        table = ", ".join(
            f"({key}, '{n.axis}', {low}L, {high}L, {(high - low) // CELLS + 1}L, {n.n_bytes * (n.shards // 2) / n.shards - below!r}D)"
            for key, (n, low, high, below) in searched.items()
        )
        search = spark.sql(f"select * from values {table} as t(node, axis, low, high, width, wanted)")
        inside = placed.join(F.broadcast(search), "node").withColumn("v", F.expr(by_axis)).where("v between low and high")
        cells = inside.groupBy("node", "wanted", F.expr("(v - low) div width").alias("cell")).agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")
        )
        # at most CELLS rows per node
        running = cells.withColumn("upto", F.expr("sum(bytes) over (partition by node order by cell)"))
        hit = {r["node"]: r for r in running.where("upto >= wanted and upto - bytes < wanted").collect()}
        for key, (node, low, high, below) in list(searched.items()):
            if key not in hit:  # an empty node, or one that ends here but for rounding
                node.divide(high + 1, node.n_bytes)
                del searched[key]
                continue
            r, step = hit[key], (high - low) // CELLS + 1
            start, end = low + r["cell"] * step, min(high, low + (r["cell"] + 1) * step - 1)
            before = below + r["upto"] - r["bytes"]
            if r["n"] == 1 or start >= end or r["bytes"] <= tolerance:
                left_is_nearer = r["wanted"] - (r["upto"] - r["bytes"]) < r["bytes"] / 2
                node.divide(*((start, before) if left_is_nearer else (end + 1, before + r["bytes"])))
                del searched[key]
            else:
                searched[key] = (node, start, end, before)


def grow_tree(rows: DataFrame, shards: int, axes: list[str]) -> Node:
    root = Node(0, shards, rows.agg(F.sum("size")).first()[0] or 0)
    span: dict[str, int] = {}
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        placed = fenced(rows, {"node": root.expression()})
        find_boxes(placed, level, axes)
        span = span or {a: max(1, high - low) for a, (low, high) in root.box.items()}
        find_cuts(placed, level, span, TOLERANCE * root.n_bytes / shards)
        level = [c for n in level for c in n.children]
    return root


def kd_shards(docs: DataFrame, shards: int = SHARDS, dimensions: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, row, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    dimensions = dimensions or DIMENSIONS
    rows = metadata(docs, dimensions, shards)
    root = grow_tree(rows, shards, [f"axis_{n}" for n in dimensions])
    placed = fenced(rows, {"shard": f"cast({root.expression()} as int)"}).select(
        "doc_id", "row", "size", "text_crc32", "shard"
    )
    return number_within(placed, "shard", "slot", F.col("row"), rows.count())


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return kd_shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
