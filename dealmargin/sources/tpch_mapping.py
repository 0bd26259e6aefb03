"""ERP-shaped tables derived from TPC-H-like parquet tables.

Each table is a deterministic projection, so the same content can be stated in
SQL for checking. A table is written to the scratch folder when first asked for
and read back from there: lineitem is grouped once, not once per reference, and
every query then starts from plain parquet scans, as it would on real tables.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Iterator, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealmargin.functions.dates import closing_date
from dealmargin.session import scratch_dir
from dealmargin.sources.schemas import ALL


def _won(value: Column) -> Column:
    return F.round(value, 0).cast("decimal(15,0)")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(15,2)")


def _half(key: Column) -> Column:
    return F.floor(key / 2).cast("long")


def _opportunity(order_key: Column) -> Column:
    return F.when(order_key % 7 != 0, _half(order_key))


def _price_times(total: Column, factor: str) -> Column:
    return _won(total * F.lit(factor).cast("decimal(3,2)"))


# The flags that the tables tell apart, in order. A flag's place among them, even for one of
# them, keeps the order of the texts, so that the least place tells what the least text is.
_FLAGS = ("A", "N", "R")


def _flag_place(flag: Column) -> Column:
    """A number for a flag that an aggregate can keep in place, which it cannot a text."""
    after = sum(
        ((flag >= F.lit(f)).cast("int") + (flag > F.lit(f)).cast("int") for f in _FLAGS), F.lit(0)
    )
    return F.when(flag.isNotNull(), after)


def _flag_at(place: Column) -> Column:
    """The flag at a place; other flags, which nothing asks for, come back empty."""
    known = F.when(place == 1, _FLAGS[0])
    for number, flag in enumerate(_FLAGS[1:], 1):
        known = known.when(place == 2 * number + 1, flag)
    return known.when(place.isNotNull(), "")


def _hundredths(name: str) -> Column:
    return (_exact(name) * F.lit(100)).cast("long")


def _from_hundredths(total: Column) -> Column:
    return total.cast("decimal(19,0)") * F.lit(Decimal("0.01"))


def _lines(t: MappedTables) -> DataFrame:
    """lineitem reduced to one row per (order, line number), which repeat in the source.

    Hardly a row has a second, so nothing is gained by reducing before the shuffle: rows are
    dealt out as they are and summed as longs, in hash aggregates. No split of the input is
    sorted, however large it is; the reduced rows are, as neighbours in order take less room in
    every table made of them.
    """
    narrow = t.source("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_shipdate").cast("date").alias("shipdate"),
        _flag_place(F.col("l_returnflag")).alias("flag"),
        _hundredths("l_quantity").alias("qty"),
        _hundredths("l_extendedprice").alias("price"),
    )
    return (
        narrow.repartition("l_orderkey", "l_linenumber")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("partkey").alias("partkey"),
            F.min("suppkey").alias("suppkey"),
            F.min("shipdate").alias("shipdate"),
            _flag_at(F.min("flag")).alias("flag"),
            _won(_from_hundredths(F.sum("qty"))).alias("qty"),
            _won(_from_hundredths(F.sum("price"))).alias("price"),
        )
        .withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
        .sortWithinPartitions("l_orderkey", "l_linenumber")
    )


def _numbered(t: MappedTables, *numbers: int) -> DataFrame:
    return t["lines"].where(F.col("l_linenumber").isin(*numbers))


def _by_flag(returned: Column | None, accepted: Column | None, none: Column | None) -> Column:
    choices = F.when(F.col("flag") == "R", F.lit(None) if returned is None else returned)
    choices = choices.when(F.col("flag") == "A", F.lit(None) if accepted is None else accepted)
    return choices if none is None else choices.otherwise(none)


def _approvals(t: MappedTables) -> DataFrame:
    key = F.col("o_orderkey")
    finished = F.col("o_orderstatus") == "F"
    return t.source("orders").select(
        key.alias("id"),
        F.concat(F.lit("DOC-"), key.cast("string")).alias("doc_id"),
        F.concat(F.lit("Project "), F.col("o_custkey").cast("string")).alias("name"),
        (key % 6).alias("doc_type"),
        F.when(finished, "complete")
        .when(F.col("o_orderstatus") == "O", "progress")
        .otherwise("draft")
        .alias("progress"),
        (key % 11).alias("applier"),
        F.when(finished & (key % 13 != 0), F.col("o_orderdate").cast("date")).alias(
            "date_complete"
        ),
        F.when(key % 19 != 0, _won(_exact("o_totalprice"))).alias("amount"),
        (F.col("o_orderpriority") == "5-LOW").alias("biz_done"),
        F.when(key % 4 == 1, "")
        .when(key % 4 > 1, F.concat(F.lit("Note "), (key % 10).cast("string")))
        .alias("biz_note"),
        _opportunity(key).alias("opportunity_id"),
    )


def _contract_terms(t: MappedTables) -> DataFrame:
    key, total = F.col("o_orderkey"), _exact("o_totalprice")
    orders = t.source("orders")
    usual = orders.where(key % 5 != 0).select(
        key.alias("approval_id"),
        F.when(key % 3 == 0, "tax_include").when(key % 3 == 1, "tax_exclude").alias("amount_type"),
        _price_times(total, "0.10").alias("cost_thr"),
        _price_times(total, "0.05").alias("cost_for"),
    )
    second = orders.where(key % 23 == 1).select(
        key.alias("approval_id"),
        F.lit("tax_include").alias("amount_type"),
        _price_times(total, "0.02").alias("cost_thr"),
        _price_times(total, "0.01").alias("cost_for"),
    )
    return usual.unionByName(second)


def _revenue_sale(t: MappedTables) -> DataFrame:
    price, zero = F.col("price"), F.lit(0)
    return _numbered(t, 1, 2).select(
        F.col("l_orderkey").alias("contract_doc_id"),
        "price",
        _by_flag(price, zero, None).alias("amount_collected"),
        F.when(F.col("flag") == "R", zero).otherwise(price).alias("amount_remain"),
    )


def _revenue_purchase(t: MappedTables) -> DataFrame:
    """Clustered by payment date, so that a date filter skips whole row groups."""
    price, zero, supplier = F.col("price"), F.lit(0), F.col("suppkey")
    rows = _numbered(t, 2, 3, 4).select(
        F.col("l_orderkey").alias("contract_doc_id"),
        closing_date(F.col("shipdate")).alias("date_payment"),
        "price",
        (F.col("partkey") % 6 + 27).cast("int").alias("purchase_type_two"),
        F.when(supplier % 4 == 1, 0).when(supplier % 4 != 0, supplier).alias("purchase_order_id"),
        F.when(F.col("flag") == "R", price).otherwise(zero).alias("amount_payment"),
        _by_flag(zero, price, None).alias("amount_remain"),
    )
    return rows.repartitionByRange("date_payment").sortWithinPartitions("date_payment")


def _delivery_order(t: MappedTables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.source("orders").select(
        key.alias("id"),
        F.when(key % 4 == 0, "return").otherwise("delivery").alias("type"),
        _opportunity(key).alias("opportunity_id"),
    )


def _delivery_order_line(t: MappedTables) -> DataFrame:
    order, supplier = F.col("l_orderkey"), F.col("suppkey")
    moved = (F.col("l_linenumber") == 5) & (supplier % 7 == 2)
    return _numbered(t, 4, 5, 6).select(
        "id",
        order.alias("order_id"),
        F.col("partkey").alias("product_id"),
        F.when(order % 17 != 0, F.col("qty")).alias("quantity"),
        (_opportunity(order) + F.when(moved, 1).otherwise(0)).alias("opportunity_id"),
        F.when(supplier % 5 == 0, "third").when(supplier % 5 != 1, "own").alias("contract_cat"),
    )


def _purchase_order_line(t: MappedTables) -> DataFrame:
    each = F.col("price").cast("double") / F.col("qty").cast("double")
    return t["lines"].select(
        "id",
        F.col("partkey").alias("product_id"),
        F.when(F.col("suppkey") % 6 != 0, _won(each)).alias("price_unit"),
        F.when(F.col("flag") == "N", "draft").otherwise("purchase").alias("state"),
        F.when(F.col("suppkey") % 37 != 0, F.col("shipdate").cast("timestamp_ntz")).alias(
            "create_date"
        ),
        F.when(F.col("l_linenumber").isin(5, 6), F.col("id")).alias("delivery_order_line_id"),
        F.col("id").alias("order_id"),
    )


def _sale_order_line(t: MappedTables) -> DataFrame:
    return _numbered(t, 4, 5, 7).select(
        "id",
        F.col("l_orderkey").alias("order_id"),
        F.col("partkey").alias("product_id"),
        (F.col("id") - F.when(F.col("l_linenumber") == 7, 3).otherwise(0)).alias(
            "delivery_order_line_id"
        ),
        F.col("qty").alias("product_uom_qty"),
        _by_flag(F.col("qty"), F.lit(0), None).alias("qty_delivered"),
        F.when(F.col("suppkey") % 8 == 0, "cancel")
        .when(F.col("suppkey") % 8 != 1, "sale")
        .alias("state"),
    )


def _login_history(t: MappedTables) -> DataFrame:
    login = F.col("ts")
    return (
        t.source("events").select(
            F.col("event_id").alias("id"),
            "user_id",
            login.alias("login_at"),
            F.when(F.col("event_id") % 3 != 0, login + F.expr("INTERVAL 30 MINUTES")).alias(
                "logout_at"
            ),
            F.lit(None).cast("string").alias("ip_address"),
            F.lit(None).cast("string").alias("session_id"),
        )
    )


def _role_changes(t: MappedTables) -> DataFrame:
    kind = F.col("event_type")
    return (
        t.source("events").select(
            F.when(F.col("event_id") % 97 != 0, F.col("event_id")).alias("seq"),
            F.when(F.col("event_id") % 89 != 0, F.col("user_id") + 20).alias("user_id"),
            F.when(kind == "signup", "admin")
            .when(kind == "error", "root")
            .otherwise("user")
            .alias("role"),
        )
    )


def _padded(key: Column, width: int) -> Column:
    return F.lpad((key % 10**width).cast("string"), width, "0")


def _vendors(t: MappedTables) -> DataFrame:
    key = F.col("s_suppkey")
    return t.source("supplier").select(
        F.concat(F.lit("V"), key.cast("string")).alias("vendor_code"),
        F.col("s_name").alias("vendor_name"),
        F.concat_ws("-", _padded(key, 3), _padded(key, 2), _padded(key, 5)).alias("biz_no"),
        F.lit("").alias("ceo_name"),
        F.lit("").alias("address"),
        F.when(F.col("s_acctbal") < 2000, "N").otherwise("Y").alias("use_yn"),
    )


def _tax_invoices(t: MappedTables) -> DataFrame:
    supplier = t.source("supplier").select(F.col("s_suppkey").alias("suppkey"), "s_name")
    return (
        _numbered(t, 1)
        .join(supplier, "suppkey")
        .select(
            F.col("shipdate").alias("issue_date"),
            F.col("s_name").alias("vendor_name"),
            _by_flag(F.lit("영세"), F.lit("면세"), F.lit("과세")).alias("tax_type"),
            F.col("price").alias("supply_amount"),
            _by_flag(F.lit(0), F.lit(0), _price_times(F.col("price"), "0.10")).alias("tax_amount"),
        )
    )


def _voucher_no(key: str) -> Column:
    return F.concat(F.lit("FI"), F.col(key).cast("string")).alias("voucher_no")


def _vouchers(t: MappedTables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.source("orders").select(
        _voucher_no("o_orderkey"),
        F.col("o_orderdate").cast("date").alias("acc_date"),
        (F.col("o_orderkey") % 7).cast("string").alias("dept"),
        F.col("o_custkey").cast("string").alias("writer"),
        F.col("o_orderpriority").alias("memo"),
        _won(_exact("o_totalprice")).alias("amount"),
        F.when(status == "F", "승인").when(status == "O", "미결").otherwise("반려").alias("status"),
    )


def _account() -> tuple[Column, Column]:
    code = (F.col("partkey") % 50 * 100 + 10100).cast("string")
    return code, F.concat(F.lit("Account "), code)


def _voucher_lines(t: MappedTables) -> DataFrame:
    code, name = _account()
    return t["lines"].select(
        _voucher_no("l_orderkey"),
        F.col("l_linenumber").cast("int").alias("line_no"),
        F.when(F.col("l_linenumber") % 2 == 0, "차변").otherwise("대변").alias("side"),
        code.alias("account_code"),
        name.alias("account_name"),
        F.lit("").alias("memo_name"),
        F.col("price").alias("amount"),
        F.lit("").alias("vendor_name"),
    )


def _accounts(t: MappedTables) -> DataFrame:
    code, name = _account()
    group = F.col("partkey") % 50 % 3
    return (
        t["lines"]
        .select(
            code.alias("account_code"),
            name.alias("account_name"),
            F.when(group == 0, "자산").when(group == 1, "부채").otherwise("수익").alias(
                "account_type"
            ),
        )
        .distinct()
    )



_BUILDERS: dict[str, Callable[["MappedTables"], DataFrame]] = {
    "lines": _lines,
    "hr_employee": lambda t: t.source("supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 9 != 4, F.col("s_nationkey")).alias("subdepartment_id"),
    ),
    "approval_subdepartment": lambda t: t.source("nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")
    ),
    "approval_doctype": lambda t: t.source("region").select(
        F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")
    ),
    "approval_approval": _approvals,
    "approval_approval_contract": _contract_terms,
    "revenue_sale": _revenue_sale,
    "revenue_purchase": _revenue_purchase,
    "delivery_order": _delivery_order,
    "delivery_order_line": _delivery_order_line,
    "purchase_order": lambda t: _numbered(t, 6).where(F.col("suppkey") % 2 == 0).select("id"),
    "purchase_order_line": _purchase_order_line,
    "product_product": lambda t: t.source("part")
    .where(F.col("p_partkey") % 29 != 0)
    .select(
        F.col("p_partkey").alias("id"), _half(F.col("p_partkey")).alias("product_tmpl_id")
    ),
    "product_template": lambda t: t.source("part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 3 == 0, True)
        .when(F.col("p_partkey") % 3 == 1, False)
        .alias("purchase_ok"),
        _won(F.col("p_retailprice")).alias("list_price"),
    ),
    "sale_order": lambda t: _numbered(t, 7).select(
        F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("contract_doc_id")
    ),
    "sale_order_line": _sale_order_line,
    "users": lambda t: t.source("customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias(
            "email"
        ),
        F.lit("x").alias("password"),
        F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("user").alias("role"),
    ),
    "user_login_history": _login_history,
    "role_changes": _role_changes,
    "vendors": _vendors,
    "tax_invoices": _tax_invoices,
    "vouchers": _vouchers,
    "voucher_lines": _voucher_lines,
    "accounts": _accounts,
}


class MappedTables(Mapping[str, DataFrame]):
    """The mapped tables of one source folder, written on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self._folder = folder.rstrip("/")
        digest = hashlib.sha256(self._folder.encode()).hexdigest()[:16]
        self.root = f"{scratch_dir(spark)}/{digest}"
        self._frames: dict[str, DataFrame] = {}
        self._written: set[str] = set()
        # Plans settle independent selections in threads; a table is still written once.
        self._lock = threading.RLock()

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def stored(self, name: str, write: Callable[[str], None]) -> str:
        """Path of something derived from these tables, written on first use."""
        path = f"{self.root}/{name}"
        with self._lock:
            if name not in self._written:
                write(path)
                self._written.add(name)
        return path

    def __getitem__(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._frames:
                self._frames[name] = self._write(name)
            return self._frames[name]

    def _write(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        rows = _BUILDERS[name](self)
        reader = self.spark.read
        if name in ALL:
            rows = rows.select(
                *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ALL[name].fields]
            )
            reader = reader.schema(ALL[name])
        rows.write.mode("overwrite").parquet(path)
        return reader.parquet(path)

    def __iter__(self) -> Iterator[str]:
        return iter(_BUILDERS)

    def __len__(self) -> int:
        return len(_BUILDERS)


_open: dict[tuple[str, str], MappedTables] = {}


def mapped_tables(spark: SparkSession, folder: str) -> MappedTables:
    """The mapped tables of a folder, shared by all queries of one application."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _open:
        _open[key] = MappedTables(spark, folder)
    return _open[key]
