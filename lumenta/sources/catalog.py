"""Registered sources: what admission may read, with what a crawl last saw of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lumenta.sources import tables


@dataclass
class Source:
    name: str
    kind: str
    path: str
    options: dict = field(default_factory=dict)
    frame: DataFrame | None = None
    state: str = "not probed"
    rows: int | None = None
    version: int = 0


class Catalog:
    """Sources by lower-case name. A frame is opened once and kept; a crawl opens all anew, so that changed files and schemas are seen."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sources = spark, {}

    def register(self, name: str, kind: str, path: str, **options) -> Source:
        own = self.sources[name.lower()] = Source(name.lower(), kind, path, options)
        return own

    def remove(self, name: str) -> None:
        self.sources.pop(name.lower(), None)

    def open(self, name: str) -> DataFrame:
        """The source's frame; an unreachable one raises with its state."""
        own = self.sources[name.lower()]
        if own.frame is None:
            own.frame, own.state = tables.source(self.spark, own.kind, own.path, **own.options)
            own.version += 1
        if own.frame is None:
            raise ConnectionError(f"{own.name}: {own.state}")
        return own.frame

    def crawl(self) -> DataFrame:
        """table_name, column_name, data_type, nullable, role of all sources that answer; their row estimates and states are kept."""
        found = {}
        for name, own in self.sources.items():
            own.frame = None
            try:
                found[name] = self.open(name)
            except ConnectionError:
                continue
            own.rows = tables.approx_rows(found[name]).first().approx_rows
        if not found:
            return self.spark.createDataFrame([], tables.CRAWLED)
        return tables.crawled(found)

    def views(self) -> dict[str, DataFrame]:
        """Frames by name, for admission: of the sources that answer."""
        out = {}
        for name in self.sources:
            try:
                out[name] = self.open(name)
            except ConnectionError:
                continue
        return out

    def sizes(self) -> dict[str, int]:
        return {name: own.rows for name, own in self.sources.items() if own.rows is not None}
