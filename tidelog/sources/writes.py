"""Staged writes: what a commit will do to each table, merged before it is published in one manifest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class WriteSet:
    """Rows for one table. mode: put (upsert by key) or delete."""

    table: str
    rows: DataFrame
    mode: str = "put"

    def merge(self, other: WriteSet | None) -> WriteSet:
        """Both sets as one; only sets of one table and mode go together. None changes nothing."""
        if other is None:
            return self
        if (self.table, self.mode) != (other.table, other.mode):
            raise ValueError(f"cannot merge writes of {other.table}/{other.mode} into {self.table}/{self.mode}")
        return WriteSet(self.table, self.rows.unionByName(other.rows, allowMissingColumns=True), self.mode)


@dataclass
class Transaction:
    """Groups of staged writes, in order."""

    groups: list[WriteSet] = field(default_factory=list)

    def merge(self, other: Transaction | None) -> Transaction:
        """The groups of both, in order; None changes nothing."""
        return Transaction([*self.groups, *(other.groups if other else [])])

    def add(self, group: WriteSet | None) -> Transaction:
        return self if group is None else Transaction([*self.groups, group])

    def by_table(self) -> dict[tuple[str, str], WriteSet]:
        """One set for each table and mode."""
        out: dict[tuple[str, str], WriteSet] = {}
        for g in self.groups:
            key = (g.table, g.mode)
            out[key] = out[key].merge(g) if key in out else g
        return out
