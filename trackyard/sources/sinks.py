"""Writers: versioned snapshots and CSV export (SNK1 write path, SNK14)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_snapshot(df: DataFrame, base: str, mode: str = "errorifexists") -> str:
    """Write ``df`` as a new snapshot folder under ``base`` and return its path.

    A mutation job reads snapshot ``v`` and writes ``v+1`` to a fresh
    folder, so it never overwrites the folder it reads from; readers switch
    to the new path once the write has succeeded.
    """
    path = f"{base.rstrip('/')}/snapshot-{uuid.uuid4().hex[:12]}"
    df.write.mode(mode).parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    """SNK14: CSV export with a header row, written in parallel (one file per
    partition; readers take the folder)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
