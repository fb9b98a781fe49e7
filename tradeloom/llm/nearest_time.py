"""Nearest record in time of the same entity within a tolerance, by x-fast tries.

Both tables are cut into cells (entity, window of time, salt); the right-hand rows are copied into each window that their tolerance
reaches, so every cell holds all that its left-hand rows can match. Cells are hashed into buckets and each bucket is one co-grouped task:
it keeps the distinct times of each cell as the leaves of a trie and, for a prefix length, a hash table from the prefixes of the leaves to
the first and last leaf below. All queries of the bucket search the length of their longest present prefix by bisection, one hash probe a
step; that node gives predecessor and successor. The nearer one within the tolerance wins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.heavy_keys import ROWS_PER_BUCKET, heavy_keys_and_rows, key_frame
from tradeloom.session import partitions


class XFastTries:
    """Tries over the integers below 2**bits of many groups; groups are numbered from 0, up to 2**(63 - bits) of them, and prefix every key."""

    def __init__(self, group: np.ndarray, value: np.ndarray, bits: int):
        self.bits = bits
        self.leaves = np.unique((group.astype(np.int64) << bits) | value.astype(np.int64))

    def level(self, length: int) -> tuple[pd.Index, np.ndarray, np.ndarray]:
        """The hash table of one prefix length: prefixes, and the first and last leaf below each."""
        prefixes = self.leaves >> (self.bits - length)  # in order, as the leaves are
        first = np.flatnonzero(np.append(True, prefixes[1:] != prefixes[:-1]))
        return pd.Index(prefixes[first]), first, np.append(first[1:], len(self.leaves)) - 1

    def neighbours(self, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the leaves at or before, and at or after, each query in its group; -1 where there is none."""
        n = len(group)
        before, after = np.full(n, -1), np.full(n, -1)
        if not len(self.leaves) or not n:
            return before, after
        key = (group.astype(np.int64) << self.bits) | value.astype(np.int64)
        low, high = np.full(n, -1), np.full(n, self.bits)  # longest length known to be present; longest still possible
        first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        while (active := low < high).any():
            probe = np.where(active, (low + high + 1) // 2, -1)
            for length in np.unique(probe[active]):
                at = np.flatnonzero(probe == length)
                table, starts, ends = self.level(int(length))
                node = table.get_indexer(key[at] >> (self.bits - int(length)))
                hit = node >= 0
                low[at[hit]] = length
                first[at[hit]], last[at[hit]] = starts[node[hit]], ends[node[hit]]
                high[at[~hit]] = length - 1
        there, exact = low >= 0, low == self.bits
        right = there & ~exact & (((key >> np.maximum(self.bits - 1 - low, 0)) & 1) == 1)  # all leaves below lie before
        left = there & ~exact & ~right
        before[exact] = after[exact] = first[exact]
        before[right], after[right] = last[right], last[right] + 1
        after[left], before[left] = first[left], first[left] - 1
        for end in (before, after):  # the neighbouring leaf may be another group's
            inside = (end >= 0) & (end < len(self.leaves))
            own = inside & ((self.leaves[np.where(inside, end, 0)] >> self.bits) == group)
            end[~own] = -1
        return before, after


def _nearest(gq: np.ndarray, values: np.ndarray, gr: np.ndarray, local: np.ndarray, ids_in: np.ndarray, bits: int, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """Which queries have a match within the tolerance, and its id."""
    tries = XFastTries(gr, local, bits)
    before, after = tries.neighbours(gq, values)
    mask, far = (1 << bits) - 1, np.int64(1) << 62
    at = lambda i: tries.leaves[np.maximum(i, 0)] & mask
    back = np.where(before >= 0, values - at(before), far)
    ahead = np.where(after >= 0, at(after) - values, far)
    nearest = np.where(back <= ahead, before, after)  # ties go to the earlier time
    ok = np.minimum(back, ahead) <= tolerance
    # the smallest id of the rows at each leaf
    leaf = np.searchsorted(tries.leaves, (gr.astype(np.int64) << bits) | local)
    ids = np.full(len(tries.leaves), np.iinfo(np.int64).max)
    np.minimum.at(ids, leaf, ids_in)
    return ok, ids[nearest[ok]]


def _bucket(tolerance: int, width: int, groups_at_once: int | None = None):
    bits = int(width + 2 * tolerance + 1).bit_length()
    most = groups_at_once or 1 << (62 - bits)  # a group's number and a time have 63 bits together

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        cell = ["entity", "window", "salt"]
        q, r = left.to_pandas(), right.to_pandas()
        groups = pd.concat([q[cell], r[cell]]).groupby(cell, sort=False).ngroup().to_numpy()
        gq, gr = groups[: len(q)], groups[len(q) :]
        local = lambda d: d["at"].to_numpy(np.int64) - d["window"].to_numpy(np.int64) * width + tolerance
        vq, vr, iq, ir = local(q), local(r), q["id"].to_numpy(np.int64), r["id"].to_numpy(np.int64)
        lefts, rights = [], []
        for start in range(0, int(groups.max()) + 1, most):  # more groups than fit a key take several rounds
            a, b = (np.flatnonzero((g >= start) & (g < start + most)) for g in (gq, gr))
            if len(a) and len(b):
                ok, found = _nearest(gq[a] - start, vq[a], gr[b] - start, vr[b], ir[b], bits, tolerance)
                lefts.append(iq[a][ok])
                rights.append(found)
        whole = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return pa.table({"left_id": whole(lefts), "right_id": whole(rights)}, schema=schema)

    return match


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_entity: Column,
    right_entity: Column,
    left_time: Column,
    right_time: Column,
    tolerance_seconds: int,
    window_seconds: int | None = None,
    share: float = 0.02,
    salts: int = 8,
) -> DataFrame:
    """(left_id, right_id): for each left row the right row of the same entity nearest in time within the tolerance (inclusive).

    Times are compared in microseconds. Ties go to the earlier right time, then to the smaller right id. Rows with a null entity or time
    take no part; left rows without a match give no row; repeated left rows give a row each, repeated right rows count once. Hot entities
    are split by windows of time and their left rows further by salts; buckets and salts grow with the rows, so that a task stays small.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp_ntz").cast("timestamp"))
    tol = tolerance_seconds * 1_000_000
    width = max(window_seconds * 1_000_000 if window_seconds else 0, 6 * tol, 3_600_000_000)
    window = lambda c: F.floor(c / F.lit(width)).cast("int")
    q = left.select(F.col(left_id).cast("long").alias("id"), left_entity.alias("entity"), micros(left_time).alias("at")).where("entity IS NOT NULL AND at IS NOT NULL")
    r = right.select(F.col(right_id).cast("long").alias("id"), right_entity.alias("entity"), micros(right_time).alias("at")).where("entity IS NOT NULL AND at IS NOT NULL")
    r = r.groupBy("entity", "at").agg(F.min("id").alias("id"))  # rows at the same moment differ by id only
    q = q.withColumn("window", window(F.col("at")))
    r = r.withColumn("window", F.explode(F.sequence(window(F.col("at") - tol), window(F.col("at") + tol))))
    hot, n = heavy_keys_and_rows(q, "entity", share)
    buckets = max(4 * partitions(left.sparkSession), -(-(n + right.count()) // ROWS_PER_BUCKET))
    salts = max(salts, -(-n // ROWS_PER_BUCKET))
    zero = F.lit(0).cast("int")
    if hot:
        listed = F.broadcast(key_frame(q, "entity", hot))  # fewer than 1 / share rows
        on, is_hot = F.col("entity") == F.col("heavy_key"), F.col("heavy_key").isNotNull()
        q = q.join(listed, on, "left").withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).otherwise(zero)).drop("heavy_key")
        every = F.sequence(zero, F.lit(salts - 1).cast("int"))
        r = r.join(listed, on, "left").withColumn("salt", F.explode(F.when(is_hot, every).otherwise(F.array(zero)))).drop("heavy_key")
    else:
        q, r = q.withColumn("salt", zero), r.withColumn("salt", zero)
    place = F.pmod(F.xxhash64("entity", "window", "salt"), F.lit(buckets)).cast("int")
    q, r = q.withColumn("bucket", place), r.withColumn("bucket", place)
    found = q.groupBy("bucket").cogroup(r.groupBy("bucket")).applyInArrow(_bucket(tol, width), "left_id long, right_id long")
    return found.select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id))
