"""DQ2: deletes over the whole foreign-key graph (CASCADE, SET NULL, RESTRICT).

A batch asks to delete rows of several tables.  Each request stands or falls as a whole: its
row and all rows that cascades reach from it go, or none of them.  It falls if any of those
rows has a RESTRICT child that stays.  A child stays unless it goes by this batch itself, so a
request that falls can make others fall (its rows stay and restrict their parents); what is
deleted in the end is the largest set of requests that can go together, children first.

Set form: ``doomed`` rows are found parents first, ``blocked`` rows children first, requests
on blocked rows fall, and both passes repeat with the requests left until none falls.  A pass
reads only the rows of child tables whose parent was doomed at the start (``edges``), found
by one join per foreign key and checkpointed; later passes never read the tables again.
The number of passes is at most the number of tables on a path of the graph, plus one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackyard.session import ensure_checkpoint_dir
from trackyard.sources.schema import FOREIGN_KEYS

Edge = tuple[str, str, str, str, str]          # child, column, parent, parent column, on delete


class Deletion(NamedTuple):
    tables: dict[str, DataFrame]   # new snapshots
    outcomes: DataFrame            # (table_name, key, outcome): deleted / restricted / not_found per request
    effects: DataFrame             # (table_name, column_name, effect, rows)


def parents_first(tables: Sequence[str], foreign_keys: Sequence[Edge]) -> list[str]:
    """The tables in an order in which every parent comes before its children."""
    left, order = list(tables), []
    while left:
        free = [t for t in left if not any(c == t and p in left for c, _, p, _, _ in foreign_keys)]
        if not free:
            raise ValueError(f"foreign keys form a cycle: {', '.join(left)}")
        order += free
        left = [t for t in left if t not in free]
    return order


class _Graph:
    """Requests, edges and the two passes over them."""

    def __init__(self, tables: Mapping[str, DataFrame], requests: Mapping[str, DataFrame], foreign_keys: Sequence[Edge],
                 key: str):
        self.tables, self.key = tables, key
        self.foreign_keys = [e for e in foreign_keys if e[0] in tables and e[2] in tables and e[1] in tables[e[0]].columns]
        if odd := [e for e in self.foreign_keys if e[3] != key]:
            raise ValueError(f"parents are known by {key}: {odd}")
        self.order = parents_first(list(tables), self.foreign_keys)
        ensure_checkpoint_dir(next(iter(tables.values())).sparkSession)
        self.requests = {t: _stored(r.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
                                    .join(tables[t].select(F.col(key).alias("k")), "k", "left_semi"))
                         for t, r in requests.items()}
        # tables whose rows can go and whose own rows must be known one by one
        self.tracked: list[str] = []
        for t in self.order:
            if key in tables[t].columns and (t in requests or self._cascades(t)):
                self.tracked.append(t)
        self.edges: dict[tuple[str, str], DataFrame] = {}
        self.fixed: dict[str, list[DataFrame]] = {t: [] for t in self.order}

    def _cascades(self, child: str) -> list[Edge]:
        return [e for e in self.foreign_keys if e[0] == child and e[4] == "cascade" and e[2] in self.tracked]

    def _children(self, parent: str, on_delete: str) -> list[Edge]:
        return [e for e in self.foreign_keys if e[2] == parent and e[4] == on_delete]

    def _touched(self, edge: Edge, doomed: DataFrame) -> DataFrame:
        """(child, parent) keys of the child rows whose parent is doomed."""
        child, col, _, _, _ = edge
        pairs = self.tables[child].select(F.col(self.key).alias("child"), F.col(col).alias("parent"))
        return _stored(pairs.join(doomed, F.col("parent") == F.col("k"), "left_semi"))

    def doomed(self, requests: Mapping[str, DataFrame], first: bool) -> dict[str, DataFrame]:
        """Rows that go with the requests, by table."""
        out: dict[str, DataFrame] = {}
        for t in self.tracked:
            parts = [requests[t]] if t in requests else []
            for edge in self._cascades(t):
                if first:
                    self.edges[t, edge[1]] = self._touched(edge, out[edge[2]])
                hit = self.edges[t, edge[1]].join(out[edge[2]], F.col("parent") == F.col("k"), "left_semi")
                parts.append(hit.select(F.col("child").alias("k")))
            out[t] = parts[0] if len(parts) == 1 and t in requests else _stored(reduce(DataFrame.unionByName, parts).distinct())
        if first:
            for t in self.tracked:
                for edge in self._children(t, "restrict"):
                    if edge[0] in self.tracked:
                        self.edges[edge[0], edge[1]] = self._touched(edge, out[t])
                    else:
                        held = self.tables[edge[0]].where(F.col(edge[1]).isNotNull()).select(F.col(edge[1]).alias("k")).distinct()
                        self.fixed[t].append(_stored(out[t].join(held, "k", "left_semi")))
        return out

    def blocked(self, doomed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Doomed rows that cannot go, by table: a RESTRICT child stays, or a cascade reaches a row that cannot go."""
        out: dict[str, DataFrame] = {}
        for t in reversed(self.tracked):
            parts = list(self.fixed[t])
            for child, col, _, _, kind in self._children(t, "restrict") + self._children(t, "cascade"):
                if child not in self.tracked:
                    continue
                pairs = self.edges[child, col].select(F.col("child").alias("c"), F.col("parent").alias("k"))
                stay = [pairs.join(out[child].select(F.col("k").alias("c")), "c", "left_semi")]
                if kind == "restrict":
                    stay.append(pairs.join(doomed[child].select(F.col("k").alias("c")), "c", "left_anti"))
                parts += [s.select("k") for s in stay]
            if parts:
                found = reduce(DataFrame.unionByName, parts).distinct()
                out[t] = _stored(found.join(doomed[t], "k", "left_semi"))
            else:
                out[t] = doomed[t].limit(0)
        return out

    def settle(self) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """(requests that go, rows that go)."""
        requests, first = dict(self.requests), True
        while True:
            doomed = self.doomed(requests, first)
            blocked = self.blocked(doomed)
            fallen = [t for t in requests if not blocked[t].join(requests[t], "k", "left_semi").isEmpty()]
            if not fallen:
                return requests, doomed
            for t in fallen:
                requests[t] = _stored(requests[t].join(blocked[t], "k", "left_anti"))
            if not any(self._cascades(t) for t in self.tracked):
                return requests, requests              # no cascade is undone, so nothing new can stay behind
            first = False


def _stored(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)


def delete_rows(tables: Mapping[str, DataFrame], requests: Mapping[str, DataFrame],
                foreign_keys: Sequence[Edge] = FOREIGN_KEYS, key: str = "id") -> Deletion:
    """Delete the requested rows (table -> rows or keys, by column ``key``) with all declared effects.

    Every table that is a parent, or that has requests, has the column ``key``; other tables need none.
    NULL keys ask for nothing; a repeated request counts once.  A NULL foreign key has no parent.
    Jobs run when this is called (checkpoints of the key sets); snapshots and counts are lazy.
    """
    graph = _Graph(tables, requests, foreign_keys, key)
    settled, gone = graph.settle()

    outcomes = []
    for t, asked in requests.items():
        keys = asked.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
        known = graph.requests[t].withColumn("_known", F.lit(True))
        done = settled[t].withColumn("_done", F.lit(True))
        outcomes.append(keys.join(known, "k", "left").join(done, "k", "left").select(
            F.lit(t).alias("table_name"), F.col("k").cast("string").alias("key"),
            F.when(F.col("_done"), "deleted").when(F.col("_known"), "restricted").otherwise("not_found").alias("outcome")))
    outcome = reduce(DataFrame.unionByName, outcomes)

    snapshots, effects = {}, [
        outcome.where("outcome <> 'not_found'").groupBy("table_name", F.lit(None).cast("string").alias("column_name"),
                                                       F.col("outcome").alias("effect")).agg(F.count(F.lit(1)).alias("rows"))]
    for t, df in tables.items():
        hits = [e for e in graph.foreign_keys if e[0] == t and e[4] != "restrict" and e[2] in gone]
        rows = df
        for _, col, parent, _, _ in hits:
            k = gone[parent].select(F.col("k").alias(f"_k_{col}"))
            rows = rows.join(k, F.col(col) == F.col(f"_k_{col}"), "left")
        leaves = F.lit(False)
        if t in gone:
            own = gone[t].select(F.col("k").alias("_own"))
            rows = rows.join(own, F.col(key) == F.col("_own"), "left")
            leaves = F.col("_own").isNotNull()
        for _, col, _, _, kind in hits:
            if kind == "cascade":
                leaves = leaves | F.col(f"_k_{col}").isNotNull()
        nulled = {col for _, col, _, _, kind in hits if kind == "set_null"}
        snapshots[t] = rows.where(~leaves).select(*[
            F.when(F.col(f"_k_{c}").isNull(), F.col(c)).alias(c) if c in nulled else F.col(c) for c in df.columns])
        if hits:
            counts = rows.agg(*[F.count_if(F.col(f"_k_{col}").isNotNull() & (leaves if kind == "cascade" else ~leaves)).alias(col)
                                for _, col, _, _, kind in hits])
            cells = F.explode(F.array(*[F.struct(F.lit(col).alias("column_name"), F.lit(kind).alias("effect"),
                                                 F.col(col).alias("rows")) for _, col, _, _, kind in hits]))
            effects.append(counts.select(F.lit(t).alias("table_name"), cells.alias("c")).select("table_name", "c.*"))
    return Deletion(snapshots, outcome, reduce(DataFrame.unionByName, effects))
