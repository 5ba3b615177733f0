"""Vectors in tiles: usable rows, bounded samples, and tiles of queries meeting tiles of candidates.

A stated set of queries meets all candidates in tiles of bounded size, dealt
by a hash of the id, so no id, label or copied vector makes a tile larger than
the rest. A pair of tiles is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dbpulse.llm.common import pick

TILE_VALUES = 1 << 19    # components that a tile of candidates holds about
QUERY_TILE = 4096        # queries that a tile has about
LEAST_TILES = 12         # so many tiles of candidates at least, if there are rows for them
LEAST_ROWS = 512         # ... of so many rows


def usable(table: DataFrame, id_column: str, vector_column: str, *more: str, zero: bool = True) -> DataFrame:
    """(id, v, x0, x1, ...) of the rows that take part: id and vector not null, all
    components finite (as doubles) and, unless ``zero``, not all zero."""
    v = F.transform("v", lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not zero:
        good = good & F.exists(v, lambda x: x != 0)
    names = [f"x{i}" for i in range(len(more))]
    return (pick(table, id_column, vector_column, *more).toDF("id", "v", *names)
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False))).select("id", v.alias("v"), *names))


def sample_vectors(vectors: DataFrame, rows: int, column: str = "v") -> dict[int, np.ndarray]:
    """At most ``rows`` different vectors, those with the smallest hashes, by their length."""
    keyed = vectors.select(column).withColumn("key", F.xxhash64(column))
    keys = keyed.select("key").distinct().orderBy("key").limit(rows).toPandas()["key"].to_numpy(np.int64)
    if not len(keys):
        return {}
    # the keys are the smallest, so a bound picks them out again
    got = (keyed.where(F.col("key") <= int(keys.max())).groupBy("key").agg(F.min(column).alias("v"))
           .orderBy("key").limit(rows).toPandas())
    by_length: dict[int, list] = {}
    for x in got["v"]:
        by_length.setdefault(len(x), []).append(np.asarray(x, np.float64))
    return {n: np.stack(x) for n, x in by_length.items() if n}


def matrices(table: pa.Table, column: str = "v") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: row numbers and vectors of a column of number lists."""
    lists = table.column(column).combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        out[int(dim)] = at, flat.reshape(len(at), int(dim))
    return out


def tile_counts(vectors: DataFrame, is_query: Column, queries: int = QUERY_TILE,
                values: int = TILE_VALUES) -> tuple[int, int]:
    """(tiles of queries, tiles of candidates) for ``vectors`` (id, v)."""
    n, asked, sizes = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.sum(F.size("v"))).first()
    by_values = -(-(sizes or 0) // values)
    by_rows = min(LEAST_TILES, -(-n // LEAST_ROWS))
    return max(1, -(-asked // queries)), max(1, by_values, by_rows)


def meet(queries: DataFrame, candidates: DataFrame, tiles: tuple[int, int],
         fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of every tile of ``queries`` with every tile of ``candidates`` (both have ``id``)."""
    q_tiles, c_tiles = tiles
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    there = candidates.withColumn("c", of(c_tiles, 1)).withColumn("q", numbers(q_tiles))
    here = queries.withColumn("q", of(q_tiles, 2)).withColumn("c", numbers(c_tiles))
    here = here.toDF(*[f"{c}_" for c in here.columns]).toDF(*here.columns)  # columns of its own
    return here.groupBy("q", "c").cogroup(there.groupBy("q", "c")).applyInArrow(fn, schema)
