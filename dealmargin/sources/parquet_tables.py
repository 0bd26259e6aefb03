"""Tables kept as parquet folders: the read side of every plan and the local read/write store."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from dealmargin.sources.schemas import ALL
from dealmargin.sources.versions import Version, VersionedFolder


class ParquetTables(Mapping[str, DataFrame]):
    """The tables under one folder, each read with its stated schema.

    A table that was saved here is read in its newest version, any other as a
    plain folder of parquet files.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark = spark
        self._folder = folder.rstrip("/")

    def versions(self, name: str) -> VersionedFolder:
        return VersionedFolder(self._spark, f"{self._folder}/{name}")

    def __getitem__(self, name: str) -> DataFrame:
        return self.at(name, self.versions(name).current())

    def at(self, name: str, version: Version) -> DataFrame:
        """A table as of a version, or as plain files where it has none."""
        if not version.number:
            return self._spark.read.schema(ALL[name]).parquet(f"{self._folder}/{name}")
        return self.versions(name).read(ALL[name], version=version)

    def __iter__(self) -> Iterator[str]:
        return iter(ALL)

    def __len__(self) -> int:
        return len(ALL)

    def save(self, name: str, rows: DataFrame, base: Version | None = None) -> Version:
        """Replace a table by rows of its stated columns and types, as its next version.

        base is the version that the rows were derived from, the newest one by
        default. ConcurrentChange if the table has got a newer one meanwhile;
        then, or if a job dies on the way, the table stays as it was.
        """
        fields = ALL[name].fields
        table = self.versions(name)
        base = table.current() if base is None else base
        fitting = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in fields])
        return table.commit(base, table.add(base, fitting))
