"""Spelling of ids: one canonical CURIE per identifier."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many namespaces are compiled into the expression; more are joined.
INLINE_NAMESPACES = 256


def uri_tail(uri: Column) -> Column:
    """The part after the last ``#``, or, without one, after the last ``/``."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def uri_head(uri: Column) -> Column:
    """Everything up to and including the separator that :func:`uri_tail` splits at; ``''`` without one."""
    return F.left(uri, F.length(uri) - F.length(uri_tail(uri)))


def first_by_ord(column: str) -> Column:
    """Of a group's values the one of the lowest ``ord``, null ones last, then the smallest value."""
    return F.min(F.struct(F.col("ord").isNull(), F.col("ord"), F.col(column).alias("value")))["value"]


class Namespaces:
    """Compresses URIs to CURIEs with a ``(prefix, expansion, ord)`` table.

    A value whose head is no known expansion stays as written, null stays null. If an
    expansion has several prefixes the one of the lowest ``ord`` counts, null ones last,
    then the smallest prefix. Small tables (at most ``inline`` rows, checked) become part
    of the expression, so no join is planned; larger ones are joined on the head. Both
    ways give the same spelling.
    """

    def __init__(self, table: DataFrame, inline: int = INLINE_NAMESPACES):
        self._table = table.where("prefix IS NOT NULL AND expansion IS NOT NULL").select("prefix", "expansion", "ord")
        rows = self._table.limit(inline + 1).collect()
        self._inline: dict[str, str] | None = None
        if len(rows) <= inline:
            self._inline = {}
            for row in sorted(rows, key=lambda r: (r.ord is None, r.ord, r.prefix)):
                self._inline.setdefault(row.expansion, row.prefix)

    def compress(self, df: DataFrame, *names: str) -> DataFrame:
        """``df`` with the named string columns replaced by their canonical spelling."""
        if self._inline is not None:
            return df.withColumns({n: self.column(F.col(n)) for n in names})
        lookup = self._table.groupBy("expansion").agg(first_by_ord("prefix").alias("__prefix"))
        for n in names:
            side = lookup.where(F.col("expansion").contains("/") | F.col("expansion").contains("#")).select(F.col("expansion").alias("__head"), "__prefix")
            hit = F.col("__prefix").isNotNull()
            df = (
                df.join(side, uri_head(F.col(n)) == F.col("__head"), "left")
                .withColumn(n, F.when(hit, F.concat("__prefix", F.lit(":"), uri_tail(F.col(n)))).otherwise(F.col(n)))
                .drop("__head", "__prefix")
            )
        return df

    def spellings(self, ids: list[str]) -> list[str]:
        """Everything that :meth:`compress` turns into one of ``ids``, so that a filter on a raw column can reach its scan."""
        prefixes = sorted({i.partition(":")[0] for i in ids if ":" in i})
        known = [(r.prefix, r.expansion) for r in self._table.where(F.col("prefix").isin(prefixes)).select("prefix", "expansion").distinct().collect()]
        return list(dict.fromkeys([*ids, *(e + i.partition(":")[2] for i in ids for p, e in known if i.startswith(p + ":"))]))

    def column(self, value: Column) -> Column:
        """The inline form of :meth:`compress` for one expression (small tables only)."""
        if self._inline is None:
            raise ValueError("too many namespaces to inline; use compress()")
        if not self._inline:
            return value
        lookup = F.create_map(*map(F.lit, chain.from_iterable(self._inline.items())))
        short = F.concat(lookup[uri_head(value)], F.lit(":"), uri_tail(value))
        return F.when(value.contains("/") | value.contains("#"), F.coalesce(short, value)).otherwise(value)
