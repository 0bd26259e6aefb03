"""Stored partial sums of the purchases, which take in new purchases without the old ones.

The profit and loss of all dates needs of the purchases only sums per contract
and payment date. Such sums add up, so they are kept as versions of a folder:
sums of the whole, and of each delta that came after. Reading adds them up; the
purchases themselves are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, LongType, StructField, StructType

from dealmargin.operators.joins import settle
from dealmargin.plans import contract_pnl as one
from dealmargin.sources.versions import Version, VersionedFolder

KEYS = ("id", "date_payment")


def measures() -> dict[str, Column]:
    """What a purchase adds to each sum of its contract and date."""
    return {**one.purchase_measures(), "sum_remain": F.col("amount_remain")}


def sums_by_date(purchases: DataFrame) -> DataFrame:
    """Every purchase sum per contract and payment date, undated purchases under no date.

    n counts the purchases. Sums have the decimals of the amounts.
    """
    scale = one.purchase_scale(purchases)
    return (
        purchases.where(F.col("contract_doc_id").isNotNull())
        .groupBy(F.col("contract_doc_id").alias("id"), "date_payment")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[one.won_sum(value, scale).alias(name) for name, value in measures().items()],
        )
    )


def merged(sums: DataFrame) -> DataFrame:
    """Sums of the same contract and date added up; those whose purchases are all gone left out."""
    added = [F.sum(c).alias(c) for c in sums.columns if c not in KEYS]
    kinds = {f.name: f.dataType for f in sums.schema.fields}
    return (
        sums.groupBy(*KEYS)
        .agg(*added)
        .where("n > 0")
        .select(*[F.col(c).cast(kinds[c]).alias(c) for c in sums.columns])
    )


def _negated(sums: DataFrame) -> DataFrame:
    return sums.select(*[F.col(c) if c in KEYS else (-F.col(c)).alias(c) for c in sums.columns])


class PurchaseSums:
    """The stored sums of one purchase table, whose amounts have scale decimals."""

    def __init__(self, spark: SparkSession, path: str, scale: int = 0) -> None:
        self._folder = VersionedFolder(spark, path)
        amount: DataType = DecimalType(38, scale) if scale else LongType()
        self._schema = StructType(
            [
                StructField("id", LongType()),
                StructField("date_payment", DateType()),
                StructField("n", LongType()),
                *[StructField(name, amount) for name in measures()],
            ]
        )

    def version(self) -> Version:
        return self._folder.current()

    def _add(self, base: Version, sums: DataFrame, onto: dict[str, str]) -> Version:
        fitting = sums.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema.fields]
        )
        folder = self._folder.add(base, fitting)[""]
        return self._folder.commit(base, {**onto, folder: folder})

    def rebuild(self, purchases: DataFrame) -> Version:
        """Start anew from all purchases."""
        return self._add(self.version(), sums_by_date(purchases), {})

    def apply(
        self, added: DataFrame, removed: DataFrame | None = None, base: Version | None = None
    ) -> Version:
        """Take in purchases that came and, if given, ones that went; a changed one is both.

        Only these are read, and their sums are committed beside the earlier
        ones. ConcurrentChange if the sums are no longer those of base, so that
        a delta given twice from one version counts once.
        """
        base = self.version() if base is None else base
        delta = sums_by_date(added)
        if removed is not None:
            delta = delta.unionByName(_negated(sums_by_date(removed)))
            sums = [F.sum(c).alias(c) for c in delta.columns if c not in KEYS]
            delta = delta.groupBy(*KEYS).agg(*sums)
        return self._add(base, delta, dict(base.parts))

    def compact(self) -> Version:
        """Replace the sums of the whole and of the deltas by one."""
        base = self.version()
        return self._add(base, merged(self._folder.read(self._schema, version=base)), {})

    def by_date(self) -> DataFrame:
        """What sums_by_date gives for all purchases up to now, settled."""
        return settle(merged(self._folder.read(self._schema))).rows
