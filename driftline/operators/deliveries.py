"""Exactly one copy of messages delivered at least once, by a persistent index of identifiers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.runtime import drop_path, latest, new_path, publish, within, written

LAST = np.iinfo(np.int64).max
RUN = "prefix int, ids array<long>, at array<long>, delivery array<long>"
STEP = RUN + ", surplus array<long>, surplus_of array<long>"


def _flat(t: pa.Table, name: str) -> np.ndarray:
    column = t.column(name).combine_chunks()
    return column.values.to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))


def best_first(ids: np.ndarray, at: np.ndarray, delivery: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (id, at, delivery), and a mask of the first row of each id in that order."""
    order = np.lexsort((delivery, at, ids))
    first = np.ones(len(order), bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    return order, first


def prefix_of(ids: np.ndarray, prefixes: int) -> np.ndarray:
    """The hash prefix of identifiers; with twice the prefixes, each one's identifiers go to two of the new ones."""
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 by the golden ratio
    return ((mixed >> np.uint64(32)) % np.uint64(prefixes)).astype(np.int32)


def _spread(prefixes: int):
    """Within each Arrow batch, mark all copies but the best as lost and send them anywhere: no prefix gets a hot id whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, delivery = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order, first = best_first(ids, at, delivery)
            lost = np.ones(len(ids), bool)
            lost[order[first]] = False
            prefix = np.where(lost, np.arange(len(ids)) % prefixes, prefix_of(ids, prefixes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, at, delivery, prefix, lost)], ["id", "at", "delivery", "prefix", "lost"])

    return run


def _take(prefix: tuple, batch: pa.Table, index: pa.Table) -> pa.Table:
    """One prefix of one batch against the sorted runs of the index."""
    ids, at, delivery, lost = (batch.column(c).to_numpy() for c in ("id", "at", "delivery", "lost"))
    surplus, surplus_of = [delivery[lost]], [ids[lost]]
    ids, at, delivery = ids[~lost], at[~lost], delivery[~lost]
    order, first = best_first(ids, at, delivery)
    ids, at, delivery = ids[order], at[order], delivery[order]
    surplus.append(delivery[~first])
    surplus_of.append(ids[~first])
    ids, at, delivery = ids[first], at[first], delivery[first]
    known_at, known_delivery, known = np.full(len(ids), LAST), np.full(len(ids), LAST), np.zeros(len(ids), bool)
    for row in range(index.num_rows):  # one row per run: a handful, as runs are merged
        run, run_at, run_delivery = (_flat(index.slice(row, 1), c) for c in ("ids", "at", "delivery"))
        if not len(run):
            continue
        place = np.minimum(np.searchsorted(run, ids), len(run) - 1)
        hit = run[place] == ids
        better = hit & (~known | (run_at[place] < known_at) | ((run_at[place] == known_at) & (run_delivery[place] < known_delivery)))
        known_at[better], known_delivery[better] = run_at[place][better], run_delivery[place][better]
        known |= hit
    wins = known & ((at < known_at) | ((at == known_at) & (delivery < known_delivery)))
    loses = known & ~wins
    surplus += [delivery[loses], known_delivery[wins]]
    surplus_of += [ids[loses], ids[wins]]
    new = ~loses
    return pa.table(
        {"prefix": pa.array([prefix[0]], pa.int32())}
        | {k: _listed(v) for k, v in (("ids", ids[new]), ("at", at[new]), ("delivery", delivery[new]))}
        | {"surplus": _listed(np.concatenate(surplus)), "surplus_of": _listed(np.concatenate(surplus_of))}
    )


def _merge(prefixes: int):
    """One prefix of all runs as one run, by the number of prefixes there are to be."""

    def run(prefix: tuple, runs: pa.Table) -> pa.Table:
        ids, at, delivery = (_flat(runs, c) for c in ("ids", "at", "delivery"))
        order, first = best_first(ids, at, delivery)
        keep = order[first]
        ids, at, delivery = ids[keep], at[keep], delivery[keep]
        to = prefix_of(ids, prefixes)
        parts = [(k, np.flatnonzero(to == k)) for k in np.unique(to)]
        lists = {
            name: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(w) for _, w in parts)]), pa.int32()), pa.array(np.concatenate([x[w] for _, w in parts]) if parts else x, pa.int64()))
            for name, x in (("ids", ids), ("at", at), ("delivery", delivery))
        }
        return pa.table({"prefix": pa.array([k for k, _ in parts], pa.int32())} | lists)

    return run


class DeliveryIndex:
    """Identifiers seen so far with the copy kept of each, as sorted arrays by hash prefix in immutable runs.

    ``ingest`` takes a batch of (id, at, delivery): each prefix of it is searched in the runs of that prefix by
    binary search, what is new is made unique locally and written as a further run. After every ``merge_every`` runs
    they are merged into one, and prefixes are doubled as long as they hold more than ``prefix_rows`` identifiers,
    so a task's share stays of one size as days come in. The copy kept is the one with the smallest (at, delivery);
    a better copy that comes later takes its place and the former one becomes surplus, so results do not depend on
    the order of the batches.

    Runs live under ``folder``, which all executors share; the runs in force are named by a record that is replaced
    as a whole, so an index can be opened again at any time, also after a crash, and stands as after the last
    complete batch. A lost executor costs the repetition of its tasks alone.
    """

    def __init__(self, spark: SparkSession, folder: str, prefixes: int = 4, merge_every: int = 4, prefix_rows: int = 400_000):
        self.spark, self.folder, self.merge_every, self.prefix_rows = spark, folder.rstrip("/"), merge_every, prefix_rows
        record = latest(spark, f"{self.folder}/records") or {"prefixes": prefixes, "runs": []}
        self.prefixes: int = record["prefixes"]
        self.runs: list[list] = record["runs"]  # [path, identifiers]

    def _publish(self, runs: list[list], prefixes: int) -> None:
        publish(self.spark, f"{self.folder}/records", {"prefixes": prefixes, "runs": runs})
        self.runs, self.prefixes = runs, prefixes

    def _index(self) -> DataFrame:
        parts = [self.spark.read.schema(RUN).parquet(path) for path, _ in self.runs]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], RUN)

    def _run(self, df: DataFrame, label: str) -> tuple[DataFrame, list]:
        run = written(df, label, within=self.folder, n=F.sum(F.size("ids")))
        return run.df, [run.path, run.seen["n"] or 0]

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Deliveries that became surplus by this batch: ``id, delivery``."""
        rows = batch.select("id", "at", "delivery").mapInArrow(_spread(self.prefixes), "id long, at long, delivery long, prefix int, lost boolean")
        step, run = self._run(rows.groupBy("prefix").cogroup(self._index().groupBy("prefix")).applyInArrow(_take, STEP), "run")
        self._publish([*self.runs, run], self.prefixes)
        if len(self.runs) > self.merge_every:
            self.merge()
        return step.select(F.explode(F.arrays_zip("surplus_of", "surplus")).alias("x")).select(
            F.col("x.surplus_of").alias("id"), F.col("x.surplus").alias("delivery")
        )

    def merge(self) -> None:
        """Merge all runs into one. Their files stay, as results may still read them; :meth:`vacuum` removes them."""
        prefixes, n = self.prefixes, sum(n for _, n in self.runs)
        while n > prefixes * self.prefix_rows:
            prefixes *= 2
        _, run = self._run(self._index().groupBy("prefix").applyInArrow(_merge(prefixes), RUN), "merged")
        self._publish([run], prefixes)

    def vacuum(self) -> None:
        """Remove runs that are no longer in force; surplus deliveries not yet read from them are lost."""
        for path in within(self.spark, self.folder):
            if not path.endswith("/records") and path.split("/")[-1] not in {p.split("/")[-1] for p, _ in self.runs}:
                drop_path(self.spark, path)

    def kept(self) -> DataFrame:
        """The copy kept of each identifier: ``id, at, delivery``."""
        if len(self.runs) > 1:
            self.merge()
        zipped = self._index().select(F.explode(F.arrays_zip("ids", "at", "delivery")).alias("x"))
        return zipped.select(F.col("x.ids").alias("id"), F.col("x.at").alias("at"), F.col("x.delivery").alias("delivery"))


def surplus_deliveries(
    df: DataFrame, ident: str, at: str, delivery: str, batch: str, waves: int = 6, prefix_rows: int = 400_000, folder: str | None = None
) -> DataFrame:
    """All deliveries of an ``ident`` but the one with the smallest (``at``, ``delivery``): ``ident, delivery``.

    The table is taken in as ``waves`` of about equal size in the order of ``batch``, through :class:`DeliveryIndex`,
    whose runs are merged on the way. Prefixes grow with the rows, so that a task holds about ``prefix_rows`` of them
    at any scale. Copies of one identifier are reduced to one per Arrow batch before they are sent to their prefix,
    so a hot one fills none. The index is a new one unless a ``folder`` is named, whose identifiers then count as
    seen.

    A null ident names no message: such rows are never surplus. Null ``at`` or ``delivery`` come after all others;
    a null ``batch`` is taken in last. Rows repeated as a whole are copies like others. Empty input gives no rows.
    """
    spark = df.sparkSession
    rows = df.where(F.col(ident).isNotNull()).select(
        F.col(ident).cast("long").alias("id"),
        F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(int(LAST))).alias("at"),
        F.coalesce(F.col(delivery).cast("long"), F.lit(int(LAST))).alias("delivery"),
        F.col(batch).cast("long").alias("batch"),
    )
    steps = [k / waves for k in range(1, waves)]
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("batch", steps, F.lit(1000)).alias("cuts")).first()
    cuts = sorted(set(about.cuts or []))
    index = DeliveryIndex(spark, folder or new_path(spark, "deliveries"), max(4, -(-about.n // (waves * prefix_rows))), prefix_rows=prefix_rows)
    found = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        wave = F.lit(True) if low is None else F.col("batch").isNull() | (F.col("batch") > low)
        if high is not None:
            wave = wave & (F.col("batch") <= high)
        elif low is None:
            wave = F.lit(True)
        part = index.ingest(rows.where(wave).drop("batch"))
        found = part if found is None else found.unionByName(part)
    lost = F.when(F.col("delivery") != F.lit(int(LAST)), F.col("delivery"))
    return found.select(F.col("id").alias(ident), lost.alias(delivery))
