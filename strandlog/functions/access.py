"""Access rules as a pure function and as a filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WRITES = {"POST", "PUT", "PATCH", "DELETE"}


@dataclass(frozen=True)
class Rule:
    """A resource, exact or with a trailing ``*``; ``write`` implies read; a denying rule grants nothing."""

    resource: str
    action: str = "read"
    deny: bool = False

    def grants(self, path: str, action: str) -> bool:
        hit = path.startswith(self.resource[:-1]) if self.resource.endswith("*") else path == self.resource
        return hit and not self.deny and (self.action == action or (self.action == "write" and action == "read"))


def action_of(method: str) -> str:
    """``write`` for every method that changes something, else ``read``."""
    return "write" if method.upper() in _WRITES else "read"


def allowed(rules: list[Rule], path: str, action: str) -> bool:
    """Rules are alternatives: one that grants is enough, whatever others deny."""
    return any(r.grants(path, action) for r in rules)


def granted(rules: list[Rule], path: Column, action: str = "read") -> Column:
    """:func:`allowed` as an expression over a column of paths."""
    hit = F.lit(False)
    for r in rules:
        if r.deny or not (r.action == action or r.action == "write"):
            continue
        hit = hit | (path.startswith(r.resource[:-1]) if r.resource.endswith("*") else path == F.lit(r.resource))
    return F.coalesce(hit, F.lit(False))


def visible_datasets(catalog: DataFrame, rules: list[Rule], action: str = "read") -> DataFrame:
    """The catalog rows that the rules let through."""
    return catalog.where(granted(rules, F.concat(F.lit("/datasets/"), F.col("dataset")), action))
