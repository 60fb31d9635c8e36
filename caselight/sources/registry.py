"""Named tables of one data set, with the payer row filter built in."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from caselight.operators.governance import visible
from caselight.sources.tables import read_table, register_view

# Tables whose rows belong to a payer; every view above them inherits the filter.
PAYER_TABLES = frozenset(
    {
        "clinical_document",
        "authorization",
        "clinical_doc_parsed",
        "clinical_doc_structured",
        "doc_member_match_candidates",
        "doc_auth_match_candidates",
    }
)

Loader = Callable[["Registry"], DataFrame]


class Registry:
    """Resolves table names to DataFrames.

    Tables are built on first use; a ``live`` registry builds them anew on every use, so rows, files and grants
    that were stored since count.  With a ``user``, rows of payers the user
    holds no grant for are removed at the source, before any rank, share or
    mean is computed above them.
    """

    def __init__(
        self,
        spark: SparkSession,
        loaders: Mapping[str, Loader],
        user: str | None = None,
        prefix: str = "",
        live: bool = False,
    ):
        self.spark = spark
        self.live = live
        self.user = user
        self.prefix = prefix
        self._loaders = dict(loaders)
        self._raw: dict[str, DataFrame] = {}
        self._seen: dict[str, DataFrame] = {}

    @classmethod
    def from_folder(
        cls,
        spark: SparkSession,
        folder: str,
        names,
        user: str | None = None,
        prefix: str = "",
        text_dates: bool = False,
        fmt: str = "parquet",
        live: bool = False,
    ) -> Registry:
        """Tables stored as ``<folder>/<name>.<fmt>``."""
        loaders = {
            n: partial(lambda reg, name: read_table(reg.spark, folder, name, text_dates, fmt), name=n)
            for n in names
        }
        return cls(spark, loaders, user, prefix, live)

    def names(self) -> list[str]:
        return sorted(n for n in self._loaders if not n.startswith("_"))

    def raw(self, name: str) -> DataFrame:
        """Table without the row filter, for jobs that maintain it."""
        if name not in self._raw or self.live:
            if name not in self._loaders:
                raise KeyError(f"unknown table {name!r}")
            self._raw[name] = self._loaders[name](self)
        return self._raw[name]

    def table(self, name: str) -> DataFrame:
        """Table as the user may see it."""
        if self.user is None or name not in PAYER_TABLES:
            return self.raw(name)
        if name not in self._seen or self.live:
            self._seen[name] = visible(self.raw(name), self.raw("payer_access_mapping"), self.user)
        return self._seen[name]

    def put(self, name: str, df: DataFrame) -> None:
        """Add or replace a table; tables that were derived before are built anew when next asked for."""
        self._loaders[name] = lambda _reg: df
        self._raw.clear()
        self._seen.clear()

    def as_user(self, user: str | None) -> Registry:
        """The same tables for another user; a later ``put`` on either registry leaves the other as it is."""
        other = Registry(self.spark, self._loaders, user, self.prefix, self.live)
        other._raw = dict(self._raw)
        return other

    def copy(self) -> Registry:
        """A registry whose tables start as these and can be replaced on their own."""
        loaders = {n: (lambda _reg, name=n: self.raw(name)) for n in self._loaders}
        return Registry(self.spark, loaders, self.user, self.prefix, self.live)

    def publish(self, names=None) -> list[str]:
        """Register tables as temp views under the prefix."""
        return [register_view(self.table(n), n, self.prefix) for n in (names or self.names())]
