"""Order statistics of the first n rows of a series, for many n at once and without any task holding a series.

Rows are numbered by position and by value.  Both numberings are cut into blocks of at most ``TILE``
rows; a table of counts says how many rows of each value block stand before each position block.
The r-th smallest of the first n rows is found by two bounded look-ups: the task of n's position
block finds the value block that holds it, and the task of this value block finds the row, by a
wavelet matrix over the positions of its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

KEY = "series_id"
TILE = 1 << 16
#: Places that a search round tries for each origin.
PROBES = 16


class Wavelet:
    """A permutation of 0 .. m - 1: the k-th smallest of its first places."""

    def __init__(self, line: np.ndarray):
        self.bits = max(1, int(len(line) - 1).bit_length())
        self.zeros, self.until = [], []
        for bit in range(self.bits - 1, -1, -1):
            low = (line >> bit) & 1 == 0
            self.zeros.append(int(low.sum()))
            self.until.append(np.concatenate(([0], np.cumsum(low))))
            line = np.concatenate((line[low], line[~low]))

    def smallest(self, places: np.ndarray, k: np.ndarray) -> np.ndarray:
        """For each query the k-th smallest (from 0) of the first ``places`` entries."""
        low, high, k = np.zeros(len(k), np.int64), places.astype(np.int64), k.astype(np.int64)
        out = np.zeros(len(k), np.int64)
        for zeros, until in zip(self.zeros, self.until):
            a, b = until[low], until[high]
            left = k < b - a
            out = out << 1 | ~left
            k = np.where(left, k, k - (b - a))
            low, high = np.where(left, a, zeros + low - a), np.where(left, b, zeros + high - b)
        return out


class Prefixes:
    """The numbered rows of a table (series, pos, value), ready for queries.  Positions count from 0 without gaps, values aren't null."""

    def __init__(self, rows: DataFrame, value: str = "target", tile: int = TILE):
        spark = rows.sparkSession
        rows = rows.select(KEY, F.col("pos").cast("bigint").alias("pos"), F.col(value).cast("double").alias("v"))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() >> 20)
        ranged = cut(rows.repartitionByRange(parts, KEY, "v", "pos").withColumn("part", F.spark_partition_id()))
        counts = ranged.groupBy(KEY, "part").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy(KEY).orderBy("part")  # one row for each range
        offsets = counts.select(KEY, "part", (F.sum("n").over(before) - F.col("n")).alias("offset"))
        rank = F.row_number().over(Window.partitionBy(KEY, "part").orderBy("v", "pos")) - 1 + F.col("offset")
        block = lambda c: F.floor(F.col(c) / tile).cast("bigint")
        placed = ranged.join(offsets, [KEY, "part"]).select(KEY, "pos", "v", rank.cast("bigint").alias("rank"))
        self.rows = cut(placed.withColumn("pos_block", block("pos")).withColumn("value_block", block("rank")))
        self.tile, self.kind = tile, self.rows.schema[KEY].dataType.simpleString()
        self.sizes = cut(self.rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("size")))
        last = F.floor((F.col("size") - 1) / tile)
        cells = self.sizes.select(KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("pos_block"), last.alias("last"))
        cells = cells.select(KEY, "pos_block", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("value_block"))
        held = self.rows.groupBy(KEY, "pos_block", "value_block").agg(F.count(F.lit(1)).alias("held"))
        filled = cells.join(held, [KEY, "pos_block", "value_block"], "left").fillna(0, ["held"])
        earlier = F.sum("held").over(Window.partitionBy(KEY, "value_block").orderBy("pos_block")) - F.col("held")
        listed = filled.withColumn("earlier", earlier).groupBy(KEY, "pos_block").agg(F.sort_array(F.collect_list(F.struct("value_block", "earlier"))).alias("l"))
        head = listed.select(KEY, "pos_block", F.lit(-1).cast("bigint").alias("pos"), F.lit(-1).cast("bigint").alias("value_block"), F.col("l.earlier").alias("earlier"))
        body = self.rows.select(KEY, "pos_block", "pos", "value_block", F.lit(None).cast("array<bigint>").alias("earlier"))
        self.strips = cut(body.unionByName(head))

    def select(self, queries: DataFrame) -> DataFrame:
        """(series, n, r) -> (series, n, r, value): the r-th smallest, from 0, of the first n rows; queries out of range have no row."""
        inside = queries.select(KEY, "n", "r").distinct().join(self.sizes, KEY).filter("r >= 0 and r < n and n <= size")
        asked = inside.select(F.col(KEY).alias("k"), F.least(F.floor(F.col("n") / self.tile), F.floor((F.col("size") - 1) / self.tile)).alias("b"), "n", "r")

        def place(key, strip: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            if not len(asks) or not len(strip):
                return pd.DataFrame(columns=[KEY, "value_block", "n", "r", "inner"])
            counts = np.array(strip.loc[strip["pos"] < 0, "earlier"].iloc[0], np.int64)
            strip = strip[strip["pos"] >= 0].sort_values("pos")
            pos, block = strip["pos"].to_numpy(), strip["value_block"].to_numpy(np.int64)
            done, out = 0, []
            for n, some in asks.groupby("n", sort=True):
                until = int(np.searchsorted(pos, n))
                counts += np.bincount(block[done:until], minlength=len(counts))
                done, sums = until, np.cumsum(counts)
                r = some["r"].to_numpy(np.int64)
                at = np.searchsorted(sums, r, "right")
                out.append(np.stack([at, np.full(len(r), n), r, r - (sums[at] - counts[at])]))
            at, n, r, inner = np.concatenate(out, axis=1)
            return pd.DataFrame({KEY: pd.Series([key[0]] * len(n), dtype=object), "value_block": at, "n": n, "r": r, "inner": inner})

        placed = self.strips.groupBy(KEY, "pos_block").cogroup(asked.groupBy("k", "b")).applyInPandas(place, f"{KEY} {self.kind}, value_block bigint, n bigint, r bigint, inner bigint")
        placed = placed.withColumnsRenamed({KEY: "k", "value_block": "b"})

        def find(key, block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            if not len(asks) or not len(block):
                return pd.DataFrame(columns=[KEY, "n", "r", "value"])
            block = block.sort_values("rank")
            by_pos = np.argsort(block["pos"].to_numpy())
            pos, values = block["pos"].to_numpy()[by_pos], block["v"].to_numpy()
            there = np.searchsorted(pos, asks["n"].to_numpy())
            found = Wavelet(by_pos).smallest(there, asks["inner"].to_numpy())
            return pd.DataFrame({KEY: pd.Series([key[0]] * len(asks), dtype=object), "n": asks["n"].to_numpy(), "r": asks["r"].to_numpy(), "value": values[found]})

        rows = self.rows.select(KEY, "value_block", "rank", "pos", "v")
        return rows.groupBy(KEY, "value_block").cogroup(placed.groupBy("k", "b")).applyInPandas(find, f"{KEY} {self.kind}, n bigint, r bigint, value double")

    def medians(self, prefixes: DataFrame) -> DataFrame:
        """(series, n) -> (series, n, center, mad): median and median absolute deviation from it, of the first n rows.

        The deviations of the k + 1 rows nearest to the median are those of k + 1 neighbours in order
        of value.  Where these begin is searched, for all n at once, in rounds of PROBES places.
        """
        n, one = F.col("n"), F.lit(1)
        asked = cut(prefixes.select(KEY, F.col("n").cast("bigint").alias("n")).distinct())
        ends = [F.floor((n - 1) / 2), F.floor(n / 2)]
        middle = self.select(asked.select(KEY, "n", F.explode(F.array(*ends)).alias("r"))).groupBy(KEY, "n").agg(((F.min("value") + F.max("value")) / 2.0).alias("center"))
        k = F.floor(n / 2)
        state = cut(asked.join(middle, [KEY, "n"]).withColumn("k", k).withColumn("low", F.lit(0).cast("bigint")).withColumn("high", n - k))
        while not state.filter("low < high").isEmpty():
            spot = F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda j: F.col("low") + F.floor((F.col("high") - F.col("low")) * j / PROBES))
            tried = state.filter("low < high").withColumn("a", F.explode(F.array_distinct(spot)))
            values = cut(self.select(tried.select(KEY, "n", F.explode(F.array(F.col("a"), F.col("a") + F.col("k"))).alias("r"))))
            tried = tried.withColumn("b", F.col("a") + F.col("k"))
            tried = tried.join(values.withColumnsRenamed({"r": "a", "value": "left"}), [KEY, "n", "a"]).join(values.withColumnsRenamed({"r": "b", "value": "right"}), [KEY, "n", "b"])
            beyond = F.col("left") + F.col("right") >= 2 * F.col("center")
            step = tried.groupBy(KEY, "n").agg(F.max(F.when(~beyond, F.col("a") + 1)).alias("l"), F.min(F.when(beyond, F.col("a"))).alias("h"))
            state = cut(state.join(step, [KEY, "n"], "left").select(KEY, "n", "center", "k", F.coalesce("l", "low").alias("low"), F.coalesce("h", "high").alias("high")))
        windows = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), one), lambda d: F.array(F.struct((F.col("low") + d).alias("a"), F.col("k").alias("w")), F.struct((F.col("low") + d).alias("a"), (F.col("k") - 1 + n % 2).alias("w")))))
        last = state.withColumn("x", F.explode(windows)).select(KEY, "n", "center", "x.a", "x.w").filter("a >= 0 and a + w < n").distinct()
        last = last.withColumn("b", F.col("a") + F.col("w"))
        values = cut(self.select(last.select(KEY, "n", F.explode(F.array("a", "b")).alias("r"))))
        last = last.join(values.withColumnsRenamed({"r": "a", "value": "left"}), [KEY, "n", "a"]).join(values.withColumnsRenamed({"r": "b", "value": "right"}), [KEY, "n", "b"])
        far = F.greatest(F.col("center") - F.col("left"), F.col("right") - F.col("center"))
        per_width = last.groupBy(KEY, "n", "center", "w").agg(F.min(far).alias("d"))
        # an odd number of rows has one width, an even one two
        return per_width.groupBy(KEY, "n", "center").agg(F.avg("d").alias("mad"))
