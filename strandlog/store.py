"""A change log on shared storage: catalog, atomic appends and full syncs."""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.uri import PrefixTable
from .model import COLUMNS
from .operators import maintenance, mutation, snapshot
from .session import materialise
from .shared import SharedFiles

CATALOG = "core.Dataset"

#: Rows of a batch that one bucket is made for, and the most buckets of a batch (both powers of two divide evenly).
BUCKET_ROWS, MAX_BUCKETS = 1 << 17, 1 << 10
#: Rows up to which a write looks only at the buckets and ids it names.
SMALL_WRITE = 1_000
#: Batches of one size class that are merged.
MERGE = 16
#: Up to this many datasets are named in an expression; more are joined.
INLINE_DATASETS = 1_000

_PAYLOAD = ("seq", "entity_id", "recorded", "batch_seq", "deleted", "props", "refs", "content_key")
_STORED = "seq bigint, entity_id string, recorded bigint, batch_seq bigint, deleted boolean, props string, refs string, content_key binary, batch string, ds string, bucket int"


def _bucket(buckets: int) -> Column:
    """An entity's bucket of ``buckets``, a power of two: that of fewer buckets is its remainder."""
    return F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int")


class Conflict(RuntimeError):
    """A write that a running full sync excludes."""


class Gone(RuntimeError):
    """A full sync that ended or timed out before this request."""


@dataclass
class Lease:
    sync_id: str
    until: float


class EntityStore:
    """Versions in parquet batches below ``folder``, visible once a manifest names them.

    One writer at a time. A batch is written completely, then the manifest is replaced in
    one step, so readers and a restarted writer see all of a transaction or nothing; files
    of a failed write are never read. ``folder`` must be storage that all executors share.

    A batch is partitioned by dataset and by hash bucket of the entity (more buckets the
    more rows it has) and sorted by entity, and holds each version's content key. So a
    write reads, of the datasets it touches, the keys in the buckets it touches, and never
    a payload; the ends of the logs are in the manifest. Batches of similar size are
    merged when there are ``MERGE`` of them, so their number grows with the logarithm of
    the rows. Folders that the manifest no longer names are deleted after ``grace_seconds``,
    which running readers have to finish.
    """

    def __init__(self, spark: SparkSession, folder: str, lease_seconds: float = 3600, grace_seconds: float = 3600):
        self.spark, self.folder, self.lease_seconds, self.grace_seconds = spark, folder.rstrip("/"), lease_seconds, grace_seconds
        self._leases: dict[str, Lease] = {}
        self._files = SharedFiles(folder, spark)
        fresh = {"batches": [], "datasets": {}, "next_id": 1, "namespaces": [], "content": {}, "last": 0, "next_offset": {}, "retired": {}, "dropped": {}}
        self._meta = fresh | (self._files.get("manifest") or {})

    def _commit(self) -> None:
        self._files.put("manifest", self._meta)

    # catalog

    def create_dataset(self, name: str, kind: str = "regular", public_namespaces: list[str] | None = None, url: str | None = None, token_provider: str | None = None, build: str | None = None, params: dict | None = None) -> int:
        """The dataset's internal id; creating an existing one changes nothing. Ids are never reused.

        A ``proxy`` stands for the remote dataset at ``url``, asked with the named token
        provider; a ``virtual`` dataset is what the registered function ``build`` makes of ``params``.
        """
        if kind == "proxy" and not url:
            raise ValueError("a proxy dataset needs a url")
        if kind == "virtual" and not build:
            raise ValueError("a virtual dataset needs a function that builds it")
        held = self._meta["datasets"].get(name)
        if held is None:
            held = {"id": self._meta["next_id"], "kind": kind, "public": public_namespaces or [], "url": url, "token_provider": token_provider, "build": build, "params": params or {}}
            held["storage"] = f"{name}#{held['id']}"  # a later dataset of the same name must not see these rows
            self._meta["datasets"][name] = held
            self._meta["next_id"] += 1
            self._commit()
        return held["id"]

    def rename_dataset(self, name: str, new_name: str) -> None:
        """The dataset under a new name, with its id and rows."""
        if new_name in self._meta["datasets"]:
            raise ValueError(f"dataset {new_name} exists")
        self._meta["datasets"][new_name] = self._meta["datasets"].pop(name)
        self._commit()

    def delete_dataset(self, name: str) -> None:
        """Hides the dataset at once; its rows stay until :meth:`collect_garbage`."""
        storage = self._meta["datasets"].pop(name)["storage"]
        self._meta["dropped"][storage] = time.time()
        self._meta["next_offset"].pop(storage, None)
        self._leases.pop(name, None)
        self._commit()

    def dataset_names(self) -> list[str]:
        return sorted(self._meta["datasets"])

    def dataset(self, name: str) -> dict | None:
        """What the catalog holds of a dataset: its id, kind and settings."""
        return self._meta["datasets"].get(name)

    def proxy_url(self, name: str) -> str | None:
        held = self._meta["datasets"].get(name)
        return held["url"] if held and held["kind"] == "proxy" else None

    def catalog(self) -> DataFrame:
        """``(dataset, dataset_id, kind, deleted, public_namespaces)``."""
        rows = [(n, d["id"], d["kind"], False, d["public"]) for n, d in sorted(self._meta["datasets"].items())]
        return self.spark.createDataFrame(rows, "dataset string, dataset_id int, kind string, deleted boolean, public_namespaces array<string>")

    def dataset_entities(self) -> DataFrame:
        """The built-in catalog dataset: one row per dataset with its item counter."""
        return self.catalog().join(maintenance.item_counts(self.changes()), "dataset", "left").select("dataset", "dataset_id", "kind", "public_namespaces", F.coalesce("items", F.lit(0)).alias("items"))

    # namespaces and content

    def prefixes(self) -> PrefixTable:
        return PrefixTable([tuple(x) for x in self._meta["namespaces"]])

    def save_prefixes(self, table: PrefixTable) -> None:
        self._meta["namespaces"] = [[p, e] for p, e, _ in table.rows()]
        self._commit()

    def context(self, dataset: str | None = None, strict: bool = False) -> dict:
        public = self._meta["datasets"][dataset]["public"] if dataset else None
        return self.prefixes().context(public, strict)

    def put_content(self, key: str, data: dict | None) -> None:
        """Stores a JSON document under a key; None removes it."""
        self._meta["content"].pop(key, None)
        if data is not None:
            self._meta["content"][key] = data
        self._commit()

    def get_content(self, key: str) -> dict | None:
        return self._meta["content"].get(key)

    def contents(self) -> dict[str, dict]:
        """All stored documents by key."""
        return dict(sorted(self._meta["content"].items()))

    # reads

    def _read(self, batches: list[dict]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).option("basePath", self.folder).parquet(*[f"{self.folder}/batch={b['name']}" for b in batches])

    def _named(self, stored: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Stored rows of the datasets ``names`` (all visible ones without) under their current names.

        The filter and the name are expressions of the partition column, so a filter on
        the name prunes partitions too.
        """
        held = {d["storage"]: n for n, d in self._meta["datasets"].items() if names is None or n in names}
        if len(held) <= INLINE_DATASETS:
            rows = stored.where(F.col("ds").isin(list(held)))
        else:
            rows = stored.join(self.spark.createDataFrame([(s,) for s in held], "ds string"), "ds", "left_semi")
        name = F.left("ds", F.length("ds") - F.length(F.substring_index("ds", "#", -1)) - 1)
        renamed = {s: n for s, n in held.items() if s != f"{n}#{s.rsplit('#', 1)[1]}"}
        if renamed and len(renamed) <= INLINE_DATASETS:
            name = F.coalesce(F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])[F.col("ds")], name)
        elif renamed:
            side = self.spark.createDataFrame(list(renamed.items()), "ds string, new_name string")
            rows, name = rows.join(side, "ds", "left"), F.coalesce("new_name", name)
        return rows.withColumn("dataset", name)

    def changes(self) -> DataFrame:
        """The whole visible log; datasets by their current names."""
        return self._named(self._read(self._meta["batches"])).select(*COLUMNS)

    def _changes_of(self, dataset: str) -> DataFrame:
        return self._named(self._read(self._meta["batches"]), [dataset]).select(*COLUMNS)

    def feed(self, dataset: str, since: int = 0, **options: object) -> DataFrame:
        return snapshot.feed(self._changes_of(dataset), dataset, since, **options)

    def entities(self, dataset: str, include_deleted: bool = True) -> DataFrame:
        return snapshot.latest(self._changes_of(dataset), include_deleted=include_deleted)

    # writes

    def _now(self) -> int:
        self._meta["last"] = max(time.time_ns(), self._meta["last"] + 1)  # strictly rising
        return self._meta["last"]

    def transaction(self, rows: DataFrame, strict: bool = False) -> int:
        """Appends real changes of ``(dataset, entity_id, deleted, props, refs[, pos])`` to any datasets, all or none.

        Without ``pos`` rows count as given in the order of the frame.
        """
        if "pos" not in rows.columns:
            rows = rows.withColumn("pos", F.monotonically_increasing_id())
        stored = self.spark.createDataFrame([(n, d["storage"]) for n, d in self._meta["datasets"].items()], "dataset string, ds string")
        rows = mutation.incoming_rows(rows)
        # more names than datasets: some are unknown
        given = {r.dataset: r["count"] for r in rows.groupBy("dataset").count().limit(len(self._meta["datasets"]) + 1).collect()}
        if unknown := sorted(set(given) - set(self._meta["datasets"])):
            raise ValueError(f"no such dataset: {unknown[:5]}")
        n = sum(given.values())
        places = materialise(mutation.numbered(self._touched(rows, list(given), n), rows, strict, n), "places")
        counts = {r.dataset: r["count"] for r in places.groupBy("dataset").count().collect()}  # one row per dataset
        if not counts:
            return 0
        storages = {n: self._meta["datasets"][n]["storage"] for n in counts}
        ends = self.spark.createDataFrame([(n, self._meta["next_offset"].get(s, 0)) for n, s in storages.items()], "dataset string, next_offset bigint")
        fresh = mutation.stamped(rows, places, ends, self._now()).join(stored, "dataset")
        self._meta["batches"].append(self._write(fresh, {storages[n]: c for n, c in counts.items()}))
        for n, s in storages.items():
            self._meta["next_offset"][s] = self._meta["next_offset"].get(s, 0) + counts[n]
        self._commit()
        self._merge()
        return sum(counts.values())

    def _touched(self, rows: DataFrame, names: list[str], n: int) -> DataFrame:
        """The committed versions that a transaction's rows are compared with, without payload.

        Only the datasets ``names`` of the ``n`` rows are read, and if the rows are few (at
        most ``SMALL_WRITE``) only the buckets and the range of ids they fall in.
        """
        found = rows.select("entity_id", _bucket(MAX_BUCKETS).alias("h")).distinct().collect() if n <= SMALL_WRITE else []
        ids, hashes = [r.entity_id for r in found], {r.h for r in found}
        groups: dict[int, list[dict]] = {}
        for b in self._meta["batches"]:
            if any(self._meta["datasets"][n]["storage"] in b["rows"] for n in names):
                groups.setdefault(b["buckets"], []).append(b)
        out = self._read([])
        for buckets, batches in groups.items():
            part = self._read(batches)
            if n <= SMALL_WRITE:
                part = part.where(F.col("bucket").isin(sorted({h % buckets for h in hashes})) & F.col("entity_id").isin(ids))
            out = out.unionByName(part)
        return self._named(out, names).select("dataset", "entity_id", "recorded", "batch_seq", "seq", "content_key")

    def _write(self, rows: DataFrame, counts: dict[str, int] | None = None) -> dict:
        """A batch of stored rows on disk, as the manifest names it; ``counts`` are its rows per dataset, if known."""
        if counts is None:
            rows = materialise(rows, "rewrite")
            counts = {r.ds: r["count"] for r in rows.groupBy("ds").count().collect()}
        wanted = -(-sum(counts.values()) // BUCKET_ROWS)
        buckets = min(MAX_BUCKETS, 1 << max(0, wanted - 1).bit_length())
        name = uuid.uuid4().hex
        placed = rows.withColumn("bucket", _bucket(buckets)).select(*_PAYLOAD, "ds", "bucket")
        spread = placed.hint("rebalance", F.col("ds"), F.col("bucket")).sortWithinPartitions("ds", "bucket", "entity_id")
        spread.write.option("compression", "zstd").partitionBy("ds", "bucket").parquet(f"{self.folder}/batch={name}")
        return {"name": name, "buckets": buckets, "rows": counts}

    def store_entities(self, dataset: str, entities: DataFrame, strict: bool = False, sync_id: str | None = None) -> int:
        """Appends the real changes among ``entities`` to one dataset; how many there were."""
        lease = self._lease(dataset)
        if lease is not None and lease.sync_id != sync_id:
            raise Conflict(f"a full sync of {dataset} is running")
        return self.transaction(entities.drop("dataset").withColumn("dataset", F.lit(dataset)), strict)

    # full sync

    def _lease(self, dataset: str) -> Lease | None:
        lease = self._leases.get(dataset)
        if lease is not None and lease.until < time.time():
            del self._leases[dataset]
            return None
        return lease

    def start_full_sync(self, dataset: str, sync_id: str) -> None:
        """Begins a full sync; one that runs already is replaced, as its sender has begun anew."""
        self._leases[dataset] = Lease(sync_id, time.time() + self.lease_seconds)

    def refresh_full_sync(self, dataset: str, sync_id: str) -> None:
        lease = self._lease(dataset)
        if lease is None:
            raise Gone(f"no full sync of {dataset} is running")
        if lease.sync_id != sync_id:
            raise Conflict(f"another full sync of {dataset} is running")
        lease.until = time.time() + self.lease_seconds

    def end_full_sync(self, dataset: str, sync_id: str, seen: DataFrame) -> int:
        """Deletes the live entities that the sync did not deliver; how many."""
        self.refresh_full_sync(dataset, sync_id)
        n = self.transaction(mutation.full_sync_deletions(self._changes_of(dataset), seen, dataset))
        del self._leases[dataset]
        return n

    def full_sync(self, dataset: str, entities: DataFrame) -> int:
        """A whole delivery: appends its changes and deletes what it lacks."""
        sync_id = uuid.uuid4().hex
        self.start_full_sync(dataset, sync_id)
        n = self.store_entities(dataset, entities, sync_id=sync_id)
        return n + self.end_full_sync(dataset, sync_id, entities)

    # maintenance

    def _replace(self, old: list[dict], rows: DataFrame | None = None) -> None:
        """Replaces batches by one of their rows, or of ``rows``; the old folders are left to :meth:`sweep`."""
        live = [d["storage"] for d in self._meta["datasets"].values()]
        kept = (self._read(old) if rows is None else rows).join(self.spark.createDataFrame([(s,) for s in live], "ds string"), "ds", "left_semi")
        batch = self._write(kept)
        gone = {b["name"] for b in old}
        self._meta["batches"] = [b for b in self._meta["batches"] if b["name"] not in gone] + ([batch] if batch["rows"] else [])
        self._meta["retired"].update({n: time.time() for n in gone})
        self._commit()

    def _merge(self) -> None:
        """Merges batches of one size class (a power of ``MERGE``) once there are ``MERGE`` of them."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for b in self._meta["batches"]:
                tiers.setdefault(int(math.log(max(1, sum(b["rows"].values())), MERGE)), []).append(b)
            full = [group for group in tiers.values() if len(group) >= MERGE]
            if not full:
                return
            self._replace(full[0])

    def compact(self) -> None:
        """Drops versions that repeat the one before them, in all datasets, and folders out of use."""
        if self._meta["batches"]:
            self._replace(self._meta["batches"], maintenance.compact(self._read(self._meta["batches"]).withColumn("dataset", F.col("ds"))).drop("dataset"))
        self.sweep()

    def collect_garbage(self) -> int:
        """Forgets the rows of deleted datasets and deletes what is out of use; how many folders went.

        No row is rewritten: a dataset's rows lie in folders of their own.
        """
        live = {d["storage"] for d in self._meta["datasets"].values()}
        for b in self._meta["batches"]:
            b["rows"] = {s: n for s, n in b["rows"].items() if s in live}
        self._meta["retired"].update({b["name"]: time.time() for b in self._meta["batches"] if not b["rows"]})
        self._meta["batches"] = [b for b in self._meta["batches"] if b["rows"]]
        self._commit()
        return self.sweep()

    def sweep(self, grace_seconds: float | None = None) -> int:
        """Deletes batches and datasets' folders that the manifest has not named for the grace period; how many.

        Folders of writes that failed count from their last change.
        """
        until = time.time() - (self.grace_seconds if grace_seconds is None else grace_seconds)
        named = {b["name"] for b in self._meta["batches"]}
        found = [(f.removeprefix("batch="), changed) for f, changed in self._files.folders() if f.startswith("batch=")]
        old = [n for n, changed in found if n not in named and self._meta["retired"].get(n, changed) <= until]
        dropped = {s for s, at in self._meta["dropped"].items() if at <= until}
        inside = [f"batch={n}/{f}" for n in named for f, _ in self._files.folders(f"batch={n}") if unquote(f.removeprefix("ds=")) in dropped] if dropped else []
        for path in [*(f"batch={n}" for n in old), *inside]:
            self._files.remove_folder(path)
        here = {n for n, _ in found} - set(old)
        self._meta["retired"] = {n: at for n, at in self._meta["retired"].items() if n in here}
        self._meta["dropped"] = {s: at for s, at in self._meta["dropped"].items() if s not in dropped}
        self._commit()
        return len(old) + len(inside)
