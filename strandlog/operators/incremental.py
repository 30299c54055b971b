"""Incremental recomputation over join chains: which main entities a change touches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..identity import Namespaces
from ..session import materialise
from .graph import ANY, hop, relations
from .snapshot import latest, latest_only


@dataclass(frozen=True)
class Join:
    """One step of a dependency: into ``dataset`` over ``predicate``, against the link if ``inverse``."""

    dataset: str
    predicate: str
    inverse: bool = False


@dataclass(frozen=True)
class Dependency:
    dataset: str
    joins: tuple[Join, ...] = ()


@dataclass
class Tracker:
    """Registers query chains of a transform as dependencies.

    ``hop`` and ``ihop`` describe how the transform walks from the main dataset; the chain
    is turned round, because a change travels from the dependency back to the main
    dataset, and every dataset on the way is a dependency too. Repeats are registered once.
    """

    main: str
    proxies: frozenset[str] = frozenset()
    _chain: tuple[tuple[str, str, bool], ...] = ()
    _found: list[Dependency] = field(default_factory=list)

    def _step(self, dataset: str, predicate: str, inverse: bool) -> "Tracker":
        if dataset in self.proxies:
            raise ValueError(f"proxy dataset {dataset} cannot be a dependency")
        chain = (*self._chain, (dataset, predicate, inverse))
        back: list[Join] = []
        for i in range(len(chain) - 1, -1, -1):
            into = chain[i - 1][0] if i else self.main
            back.append(Join(into, chain[i][1], not chain[i][2]))
        dependency = Dependency(dataset, tuple(back))
        if dependency not in self._found:
            self._found.append(dependency)
        return Tracker(self.main, self.proxies, chain, self._found)

    def hop(self, dataset: str, predicate: str) -> "Tracker":
        return self._step(dataset, predicate, False)

    def ihop(self, dataset: str, predicate: str) -> "Tracker":
        return self._step(dataset, predicate, True)

    def dependencies(self) -> list[Dependency]:
        return list(self._found)


def dependencies_from_config(config: list[dict], main: str, proxies: frozenset[str] = frozenset()) -> list[Dependency]:
    """Dependencies of a job configuration, each intermediate dataset added, repeats removed."""
    found: list[Dependency] = []
    for entry in config:
        joins = tuple(Join(j["dataset"], j["predicate"], bool(j.get("inverse", False))) for j in entry["joins"])
        if not joins or joins[-1].dataset != main:
            raise ValueError("the last join must lead to the main dataset")
        starts = [(entry["dataset"], 0), *((j.dataset, i + 1) for i, j in enumerate(joins[:-1]))]
        for dataset, at in starts:
            if dataset in proxies:
                raise ValueError(f"proxy dataset {dataset} cannot be a dependency")
            dependency = Dependency(dataset, joins[at:])
            if dependency not in found:
                found.append(dependency)
    return found


def chain_links(log: DataFrame, namespaces: Namespaces | None, dependencies: list[Dependency], at: int | None = None) -> DataFrame:
    """The links of the predicates that the dependencies' joins follow, as they are now or were ``at``."""
    wanted = sorted({j.predicate for d in dependencies for j in d.joins})
    links = relations(log, namespaces, at).select("dataset", "subject", "predicate", "object", "recorded")
    return links if ANY in wanted else links.where(F.col("predicate").isin(wanted))


def touched_by(log: DataFrame, namespaces: Namespaces | None, main: str, dependency: Dependency, since: int, all_levels: bool = False, links: DataFrame | None = None) -> DataFrame:
    """``entity_id`` of the main entities that changes of a dependency since its token reach.

    ``links`` are those of :func:`chain_links`, for callers that have several dependencies.

    Links count as they are now; for the first join, if it follows links outwards, also as
    they were at the dependency's last change before ``since``, so an entity whose link was
    removed is still found. ``all_levels`` looks back at every outward join.
    """
    source = log.where(F.col("dataset") == dependency.dataset)
    ids = source.where(F.col("seq") >= since).select("entity_id").distinct()
    links = chain_links(log, namespaces, [dependency]) if links is None else links
    before = None
    if since > 0:
        before = source.where(F.col("seq") < since).agg(F.max("recorded")).first()[0]
    for level, join in enumerate(dependency.joins):
        # the links lie in the dataset that is left if followed outwards, else in the one entered
        starts = ids.select(F.col("entity_id").alias("start_id"))
        reached = hop(starts, links, join.predicate, join.inverse).select(F.col("related_id").alias("entity_id"))
        if before is not None and not join.inverse and (level == 0 or all_levels):
            # outward links are those of the starts themselves, so only their versions are reduced
            held = log.join(ids, "entity_id", "left_semi").where(F.col("recorded") <= before)
            old = chain_links(held, namespaces, [dependency])
            reached = reached.unionByName(hop(starts, old, join.predicate, False).select(F.col("related_id").alias("entity_id")))
        ids = reached.distinct()
    present = log.where(F.col("dataset") == main).select("entity_id").distinct()
    return ids.join(present, "entity_id", "left_semi")


def multi_source(log: DataFrame, namespaces: Namespaces | None, main: str, dependencies: list[Dependency], tokens: dict[str, int], only_latest: bool = False) -> DataFrame:
    """Entities of the main dataset to process: changed themselves or touched by a dependency.

    All dependencies are judged against the tokens from before the run. Returns the newest
    versions of touched entities, and the main changes since their token (newest only if
    ``only_latest``).
    """
    mine = log.where(F.col("dataset") == main)
    own = (latest_only(mine) if only_latest else mine).where(F.col("seq") >= tokens.get(main, 0))
    columns = ["dataset", "entity_id", "seq", "recorded", "batch_seq", "deleted", "props", "refs"]
    out = own.select(*columns)
    if dependencies:
        touched = None
        links = materialise(chain_links(log, namespaces, dependencies), "chain-links")  # once for all dependencies
        for d in dependencies:
            ids = touched_by(log, namespaces, main, d, tokens.get(d.dataset, 0), links=links)
            touched = ids if touched is None else touched.unionByName(ids)
        now = latest(mine).join(touched.distinct(), "entity_id", "left_semi").select(*columns)
        out = out.unionByName(now).dropDuplicates(["dataset", "seq"])
    return out


def next_tokens(log: DataFrame, datasets: list[str]) -> dict[str, int]:
    """The offset after the last change of each dataset; recorded before a full sync reads anything."""
    rows = log.where(F.col("dataset").isin(datasets)).groupBy("dataset").agg(F.max("seq").alias("last")).collect()
    found = {r.dataset: r["last"] + 1 for r in rows}
    return {d: found.get(d, 0) for d in datasets}
