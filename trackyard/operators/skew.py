"""Skew-safe building blocks used by several operators.

A single key (user, schedule, route) may carry a third of all rows, so
nothing here sends a whole key group to one task unboundedly:

* ``pick_per_key`` keeps one row per key with ``max_by``/``min_by``; the
  aggregate runs partial (map-side) first, so a hot key is reduced before
  the shuffle.
* ``top_n_per_group`` ranks inside ``(key, salt)`` sub-groups first and
  keeps at most ``n`` rows from each, then ranks the survivors per key.
  Any row that is not in the top ``n`` of its sub-group cannot be in the
  top ``n`` of its group, so the result is exact, and the second window
  sees at most ``salt_buckets * n`` rows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALT_BUCKETS = 64


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def pick_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                 last: bool = True) -> DataFrame:
    """One row per key: the row with the greatest (``last``) or least order.

    ``order`` must make rows of one key distinct (add a unique column as the
    final tie-breaker) so the choice is deterministic.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    payload = F.struct(*[F.col(c) for c in others])
    ordkey = F.struct(*_cols(order))
    pick = F.max_by if last else F.min_by
    out = df.groupBy(*keys).agg(pick(payload, ordkey).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    n: int, salt_buckets: int = DEFAULT_SALT_BUCKETS,
                    salt_on: Sequence[str] | None = None,
                    rank_col: str = "rank") -> DataFrame:
    """Exact top-``n`` rows per ``keys`` by ``order`` (a total order).

    ``salt_on`` names the columns hashed into the salt (default: all
    columns), which spreads one hot key over ``salt_buckets`` tasks.
    """
    keys = list(keys)
    salt_src = [F.col(c) for c in (salt_on or df.columns)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    pruned = (salted.withColumn("_r1", F.row_number().over(w1))
              .where(F.col("_r1") <= n).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (pruned.withColumn(rank_col, F.row_number().over(w2).cast("bigint"))
            .where(F.col(rank_col) <= n))
