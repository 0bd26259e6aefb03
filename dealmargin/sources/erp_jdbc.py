"""Reading the ERP database over JDBC. There is deliberately nothing here that writes."""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dealmargin.sources.schemas import ERP


class ErpNotConfigured(RuntimeError):
    """Host, user or database name of the ERP database is missing."""


class UnslicedFact(RuntimeError):
    """A large table would be read through one connection into one task."""


# Fixed value: the tables that grow with the business.
FACTS = (
    "approval_approval", "approval_approval_contract", "revenue_sale", "revenue_purchase",
    "delivery_order", "delivery_order_line", "purchase_order_line", "sale_order",
    "sale_order_line",
)


@dataclass(frozen=True)
class ErpSettings:
    host: str = ""
    port: int = 5432
    user: str = ""
    password: str = ""
    dbname: str = ""
    connect_timeout_s: int = 5
    statement_timeout_ms: int = 5000
    max_connections: int = 5

    @property
    def is_configured(self) -> bool:
        return bool(self.host and self.user and self.dbname)

    def options(self) -> dict[str, str]:
        """Options of a JDBC read. queryTimeout takes whole seconds, so the exact
        statement timeout is set in the session as well."""
        if not self.is_configured:
            raise ErpNotConfigured("set host, user and dbname of the ERP database first")
        return {
            "url": f"jdbc:postgresql://{self.host}:{self.port}/{self.dbname}",
            "driver": "org.postgresql.Driver",
            "user": self.user,
            "password": self.password,
            "connectTimeout": str(self.connect_timeout_s),
            "queryTimeout": str(-(-self.statement_timeout_ms // 1000)),
            "sessionInitStatement": f"SET statement_timeout = {self.statement_timeout_ms}",
            "readOnly": "true",
            "fetchsize": "10000",
            "pushDownPredicate": "true",
        }


@dataclass(frozen=True)
class KeyRange:
    """Bounds by which a table is read in parallel slices of a number, date or time column."""

    column: str
    low: int | datetime.date
    high: int | datetime.date


def read_options(settings: ErpSettings, table: str, slices: KeyRange | None) -> dict[str, str]:
    options = {**settings.options(), "dbtable": table}
    if slices is not None:
        options |= {
            "partitionColumn": slices.column,
            "lowerBound": str(slices.low),
            "upperBound": str(slices.high),
            "numPartitions": str(settings.max_connections),
        }
    return options


class ErpTables(Mapping[str, DataFrame]):
    """The ERP tables as lazily read DataFrames, in the columns and types the plans expect.

    Slices say how a table is read in parallel: a KeyRange of one of its
    columns, or a list of SQL predicates that split its rows. A slice that
    cannot be used is an error, and so is a fact without one, unless it is
    named in whole. Nothing is connected before a table is asked for. Each scan
    of a table opens at most max_connections connections at a time; tables
    scanned by the same job add up.
    """

    def __init__(
        self,
        spark: SparkSession,
        settings: ErpSettings,
        slices: Mapping[str, KeyRange | Sequence[str]] | None = None,
        whole: Sequence[str] = (),
    ) -> None:
        self._spark = spark
        self._settings = settings
        self._slices = dict(slices or {})
        self._whole = frozenset(whole)
        for name, each in self._slices.items():
            check_slices(name, each, settings.max_connections)

    def __getitem__(self, name: str) -> DataFrame:
        schema = ERP[name]
        slices = self._slices.get(name)
        self._settings.options()
        if slices is None and name in FACTS and name not in self._whole:
            raise UnslicedFact(f"give a key range or predicates for {name}, or name it in whole")
        if slices is None or isinstance(slices, KeyRange):
            options = read_options(self._settings, name, slices)
            rows = self._spark.read.format("jdbc").options(**options).load()
        else:
            options = read_options(self._settings, name, None)
            rows = self._spark.read.jdbc(
                options.pop("url"), options.pop("dbtable"),
                predicates=list(slices), properties=options,
            )
        return select_typed(rows, schema.fields)

    def __iter__(self) -> Iterator[str]:
        return iter(ERP)

    def __len__(self) -> int:
        return len(ERP)


def check_slices(table: str, slices: KeyRange | Sequence[str], max_connections: int) -> None:
    """ValueError for a slice the table cannot be read by."""
    if table not in ERP:
        raise ValueError(f"no such table: {table}")
    if not isinstance(slices, KeyRange):
        if not slices or isinstance(slices, str) or len(slices) > max_connections:
            raise ValueError(f"{table}: give a list of 1 to {max_connections} predicates")
        return
    known = {f.name: f.dataType for f in ERP[table].fields}
    kind = known.get(slices.column)
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampNTZType)):
        raise ValueError(f"{table} cannot be sliced by {slices.column}")
    if not slices.low < slices.high:
        raise ValueError(f"{table}: the range of {slices.column} is empty")


def exact_type(found: T.DataType, stated: T.DataType) -> T.DataType:
    """The stated type, or for decimals one that holds the decimals that were found."""
    if not isinstance(stated, T.DecimalType):
        return stated
    if isinstance(found, (T.FloatType, T.DoubleType)):
        raise TypeError(f"a floating-point column cannot be read as {stated.simpleString()}")
    more = max(0, getattr(found, "scale", 0) - stated.scale)
    return T.DecimalType(min(38, stated.precision + more), stated.scale + more)


def select_typed(rows: DataFrame, fields: Sequence) -> DataFrame:
    """The stated columns in their types. Amounts keep all their decimals; one with too many
    digits before the point raises when it is read."""
    kinds = {f.name: exact_type(rows.schema[f.name].dataType, f.dataType) for f in fields}
    return rows.select(*[rows[name].cast(kind).alias(name) for name, kind in kinds.items()])
