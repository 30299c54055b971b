"""Identifiers: splitting, compressing and expanding, and the prefix table behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..identity import INLINE_NAMESPACES, first_by_ord, uri_head, uri_tail


def url_parts(uri: Column) -> Column:
    """Struct (expansion, name): split after the last ``#``, or, without one, after the last ``/``."""
    return F.struct(uri_head(uri).alias("expansion"), uri_tail(uri).alias("name"))


def local_name(curie: Column) -> Column:
    """The part of a CURIE after its first colon, the whole without one."""
    return F.regexp_replace(curie, "^[^:]*:", "")


def expand_curie(df: DataFrame, column: str, namespaces: DataFrame, out: str) -> DataFrame:
    """``df`` with the full URI of a CURIE column; unknown prefixes and URIs stay as written."""
    side = namespaces.where("prefix IS NOT NULL AND expansion IS NOT NULL").groupBy(F.col("prefix").alias("__prefix")).agg(first_by_ord("expansion").alias("__expansion"))
    prefix = F.when(F.col(column).contains(":"), F.substring_index(column, ":", 1))
    rows = df.join(side, prefix == F.col("__prefix"), "left")
    full = F.when(F.col("__expansion").isNotNull(), F.concat("__expansion", F.expr(f"substring(`{column}`, length(__prefix) + 2)"))).otherwise(F.col(column))
    return rows.withColumn(out, full).drop("__prefix", "__expansion")


def bounded_rows(namespaces: DataFrame, most: int = INLINE_NAMESPACES) -> Column:
    """The (prefix, expansion) rows of a namespace table as one array; more than ``most`` rows are an error."""
    rows = namespaces.select("prefix", "expansion").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} namespaces")
    one = "struct<prefix:string,expansion:string>"
    return F.array(*[F.struct(F.lit(r.prefix).alias("prefix"), F.lit(r.expansion).alias("expansion")).cast(one) for r in rows]).cast(f"array<{one}>")


def expand_names(m: Column, table: dict[str, str]) -> Column:
    """A map with its CURIE keys expanded by a small prefix table."""
    return F.transform_keys(m, lambda k, _: _expanded(k, table))


def _expanded(curie: Column, table: dict[str, str]) -> Column:
    if not table:
        return curie
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.create_map(*pairs)[F.substring_index(curie, ":", 1)]
    return F.when(curie.contains(":") & hit.isNotNull(), F.concat(hit, F.regexp_replace(curie, "^[^:]*:", ""))).otherwise(curie)


def expand_identifiers(entities: DataFrame, table: dict[str, str]) -> DataFrame:
    """Ids, property names and reference names expanded, and the targets of list references;
    a single reference value stays as it is. Columns as of ``functions.entity.typed``."""
    refs = F.transform_values("refs", lambda k, v: F.when(F.col("ref_is_list")[k], F.transform(v, lambda t: _expanded(t, table))).otherwise(v))
    flags = expand_names(F.col("ref_is_list"), table)
    return entities.withColumns({"entity_id": _expanded(F.col("entity_id"), table), "props": expand_names(F.col("props"), table), "refs": expand_names(refs, table), "ref_is_list": flags})


class PrefixTable:
    """The driver-side table of namespaces: prefixes ``ns0, ns1, ...`` in order of first use."""

    def __init__(self, rows: list[tuple[str, str]] = ()):
        self._by_prefix: dict[str, str] = dict(rows)
        self._by_expansion: dict[str, str] = {}
        for p, e in self._by_prefix.items():
            self._by_expansion.setdefault(e, p)

    def prefix(self, expansion: str) -> str | None:
        return self._by_expansion.get(expansion)

    def assert_prefix(self, expansion: str) -> str:
        """The prefix of an expansion, given now if it has none."""
        found = self._by_expansion.get(expansion)
        if found is None:
            n = len(self._by_prefix)
            while f"ns{n}" in self._by_prefix:
                n += 1
            found = f"ns{n}"
            self._by_prefix[found] = expansion
            self._by_expansion[expansion] = found
        return found

    def rows(self) -> list[tuple[str, str, int]]:
        return [(p, e, i) for i, (p, e) in enumerate(self._by_prefix.items())]

    def context(self, public: list[str] | None = None, strict: bool = False) -> dict:
        """The ``@context`` object; only public expansions if a list is given, and if
        ``strict`` only expansions that end in ``#`` or ``/``."""
        shown = {p: e for p, e in self._by_prefix.items() if (not public or e in public) and (not strict or e[-1:] in ("#", "/"))}
        return {"id": "@context", "namespaces": shown}

    def canonical(self, name: str, local: dict[str, str]) -> str:
        """An identifier of a document in this table's spelling; ``local`` is the document's context.

        Full URIs are split and their expansion asserted; a name without a colon needs the
        document's default namespace ``_``; any other prefix must be in its context.
        """
        if not name:
            raise ValueError("empty identifier")
        if name.startswith(("http://", "https://")):
            sep = "#" if "#" in name else "/"
            head, tail = name.rsplit(sep, 1)
            return f"{self.assert_prefix(head + sep)}:{tail}"
        prefix, colon, tail = name.partition(":")
        if not colon:
            prefix, tail = "_", name
        if prefix not in local:
            raise ValueError(f"no expansion for prefix {prefix} of {name}")
        return f"{self.assert_prefix(local[prefix])}:{tail}"
