"""Stages of a run that can go on where it stopped.

Every stage has a fingerprint of what it works on: settings, tables, and the stages before it.
When a stage has succeeded, the fingerprint is written as its mark.  A later run passes over
the stages whose mark is the same and repeats the others, from their stored inputs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.sources.folders import read_text, remove, write_text


def table_fingerprint(df: DataFrame) -> str:
    """Columns, rows and a sum of hashes of a table; the order of the rows does not matter.

    Two tables of the same rows have the same fingerprint.  Hashes are added up in halves, so
    that neither repeated rows cancel out nor a sum overflows.
    """
    h = F.xxhash64(*[F.col(c) if not kind.startswith("map") else F.map_entries(c) for c, kind in df.dtypes])
    sums = df.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return _digest([df.dtypes, list(sums)])


def _digest(parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class Stages:
    """The marks of a run's stages, in a folder below its output."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.folder = spark, f"{out}/_stages"
        self.ran: list[str] = []
        self.prints: dict[str, str] = {}

    def run(self, name: str, work: Callable[[], None], after: tuple[str, ...] = (), **inputs) -> bool:
        """Do a stage unless its mark says that it was done on the same inputs; whether it was done now."""
        found = self.prints[name] = _digest([name, inputs, [self.prints[a] for a in after]])
        mark = f"{self.folder}/{name}"
        if (read_text(self.spark, mark) or "").split("\n")[0] == found:
            return False
        # a stage that fails has no mark, whatever it had before
        remove(self.spark, mark)
        work()
        write_text(self.spark, mark, f"{found}\n{json.dumps(inputs, sort_keys=True, default=str)}\n")
        self.ran.append(name)
        return True
