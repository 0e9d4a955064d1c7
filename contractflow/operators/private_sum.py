"""Per-group totals over ciphertexts; nothing but the total is ever decrypted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractflow.functions.crypto import PublicKey, SecretKey, combine, reveal
from contractflow.storage import ship_package


# groups whose totals a task holds at once
HELD = 20_000


class EncryptionDisabled(RuntimeError):
    """Totals were asked for without a key."""


def encrypted_sum(metrics: DataFrame, by: list[str], key: PublicKey | None, column: str = "ciphertext") -> DataFrame:
    """``by..., ciphertext, n``: the encrypted total and the number of values per group.

    A column ``n`` says how many values a row stands for; without one every row is one value.  Two folds with
    one shuffle between them: every task first folds its rows, holding the totals of HELD groups at most, so a
    group that fills the table is one row per task; then one row per task and group is folded over sorted rows.
    """
    if key is None:
        raise EncryptionDisabled("cannot total encrypted values: no key is configured")
    ship_package(metrics.sparkSession)
    types = dict(metrics.select(*by).dtypes)
    schema = ", ".join([*[f"`{b}` {types[b]}" for b in by], "ciphertext binary", "n bigint"])

    square = key.n * key.n

    def emit(sums: dict[tuple, tuple[int, int]], like: pa.RecordBatch) -> pa.RecordBatch:
        groups, totals = list(sums), list(sums.values())
        columns = [pa.array([g[i] for g in groups], like.schema.field(i).type) for i in range(len(by))]
        columns += [
            pa.array([t[0].to_bytes(key.width, "big") for t in totals], pa.binary()),
            pa.array([t[1] for t in totals], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [*by, "ciphertext", "n"])

    def add(sums: dict[tuple, tuple[int, int]], batch: pa.RecordBatch) -> None:
        groups = zip(*[batch.column(i).to_pylist() for i in range(len(by))])
        rows: dict[tuple, tuple[list[bytes], list[int]]] = {}
        for group, ciphertext, n in zip(groups, batch.column("ciphertext").to_pylist(), batch.column("n").to_pylist()):
            ciphertexts, counts = rows.setdefault(group, ([], []))
            ciphertexts.append(ciphertext)
            counts.append(n)
        for (group, (_, counts)), product in zip(rows.items(), combine([ciphertexts for ciphertexts, _ in rows.values()], key)):
            # popped and put back, so that the group seen last stays last
            total, count = sums.pop(group, (None, 0))
            sums[group] = (product if total is None else total * product % square, count + sum(counts))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[int, int]] = {}
        batch = None
        for batch in batches:
            add(sums, batch)
            if len(sums) > HELD:
                yield emit(sums, batch)
                sums = {}
        if sums:
            yield emit(sums, batch)

    def per_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by group, so only the last group of a batch can go on in the next
        sums: dict[tuple, tuple[int, int]] = {}
        batch = None
        for batch in batches:
            add(sums, batch)
            if len(sums) > 1:
                last = next(reversed(sums))
                tail = sums.pop(last)
                yield emit(sums, batch)
                sums = {last: tail}
        if sums:
            yield emit(sums, batch)

    n = F.col("n") if "n" in metrics.columns else F.lit(1)
    values = metrics.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("ciphertext"), n.cast("bigint").alias("n"))
    # few bytes with much work per row: as many tasks as the session has, not as few as the bytes would fill
    tasks = int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return values.mapInArrow(per_task, schema).repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(per_group, schema)


def user_totals(metrics: DataFrame, key: PublicKey | None, secret: SecretKey | None) -> DataFrame:
    """``user_id, n, total`` for every user with encrypted metrics; also from totals kept by :mod:`kept_totals`."""
    summed = encrypted_sum(metrics, ["user_id"], key).where("n > 0")
    if secret is None:
        raise EncryptionDisabled("cannot reveal totals: no secret key is configured")
    return summed.select("user_id", "n", reveal(F.col("ciphertext"), secret).alias("total"))


def user_total(metrics: DataFrame, user_id: str, key: PublicKey | None, secret: SecretKey | None) -> DataFrame:
    """The total of one user; no row when there is nothing to add up."""
    return user_totals(metrics.where(F.col("user_id") == user_id), key, secret)
