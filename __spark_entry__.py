
from __future__ import annotations

import datetime
from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealmargin.functions import dates, display, rules
from dealmargin.operators import export, grid, joins, search
from dealmargin.operators.grid import Both, Condition, Either
from dealmargin.plans import all_dates, approvals, purchase_sums, requests, snapshot, users
from dealmargin.plans import contract_pnl as pnl
from dealmargin.sources.parquet_tables import ParquetTables
from dealmargin.sources.tpch_mapping import MappedTables, mapped_tables
from oracles.queries import oracle_sql as _oracle_sql

ENTRY_FOLDER = "/root/testdata/sf0.001"
ENTRY_DATE = datetime.date(1995, 12, 29)
DATE = datetime.date(1995, 8, 10)

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Contract profit and loss of one payment date."""
    return pnl.contract_pnl(mapped_tables(spark, ENTRY_FOLDER), ENTRY_DATE)


# --- steps of the profit and loss on one date --------------------------------------


def _headers(t: MappedTables) -> joins.Settled:
    return pnl.date_headers(t, DATE)


def _delivery_orders(t: MappedTables) -> DataFrame:
    opportunities = pnl.wanted_opportunities(_headers(t).rows).distinct()
    return pnl.delivery_orders(t["delivery_order"], opportunities)


def _expected(t: MappedTables) -> DataFrame:
    lines, _ = pnl.date_lines(t, _headers(t))
    return pnl.expected_product_amounts(lines, pnl.settled_prices(t))


def _delivered(t: MappedTables) -> DataFrame:
    lines, line_ids = pnl.date_lines(t, _headers(t))
    return pnl.delivery_amounts(t, lines, pnl.settled_prices(t), line_ids)


def _sale_orders(t: MappedTables) -> DataFrame:
    orders = pnl.contract_sale_orders(t["sale_order"], _headers(t).hinted("id"))
    return pnl.sale_order_amounts(t["sale_order_line"], orders, pnl.settled_prices(t))


def _purchases(t: MappedTables, headers: joins.Settled) -> DataFrame:
    return pnl.purchase_sums(t["revenue_purchase"], DATE, headers.hinted("id"))


def _sales(t: MappedTables, headers: joins.Settled) -> DataFrame:
    return pnl.sale_sums(t["revenue_sale"], headers.hinted("id"))


def _gain(t: MappedTables) -> DataFrame:
    headers = _headers(t)
    joined = headers.rows.join(_purchases(t, headers), "id").join(_sales(t, headers), "id", "left")
    return joined.select(
        "id",
        pnl.money(pnl.won("sale_collected")).alias("sale_collected"),
        "sum_payment",
        "sum_remain",
        pnl.money(pnl.gain()).alias("gain"),
    )


def _remain_sale(t: MappedTables) -> DataFrame:
    headers = _headers(t)
    return headers.rows.join(_sales(t, headers), "id", "left").select(
        "id",
        "expected_sale",
        pnl.money(pnl.won("total_sale")).alias("total_sale"),
        pnl.money(pnl.remain_sale()).alias("remain_sale"),
    )


def _etc_purchase(t: MappedTables) -> DataFrame:
    headers = _headers(t)
    return headers.rows.join(_purchases(t, headers), "id").select(
        "id",
        "purchase_total",
        *rules.PURCHASE_BUCKETS,
        pnl.money(pnl.etc_purchase()).alias("etc_purchase"),
    )


def _main(t: MappedTables) -> DataFrame:
    derived = ("total_cost", "profit", "profit_rate")
    names = [c for c in pnl.PNL_COLUMNS if c.rstrip("2") not in derived]
    return pnl.pnl_main(t, DATE).select(*names)


def _core(*columns: str) -> Callable[[MappedTables], DataFrame]:
    def query(t: MappedTables) -> DataFrame:
        core = pnl.pnl_core(pnl.payment_scope(t, DATE), t, DATE)
        return pnl.with_profit(core).select("id", *columns)

    return query


def _grid(t: MappedTables) -> DataFrame:
    return pnl.contract_pnl_grid(pnl.contract_pnl(t, DATE))


def _export_csv(t: MappedTables) -> DataFrame:
    shown = _grid(t)
    path = t.stored("grid_csv", lambda p: export.export_csv(shown, p))
    return export.read_csv(t.spark, path, shown.schema)


# --- the snapshot and the grid over it ---------------------------------------------


def _snapshot(t: MappedTables) -> DataFrame:
    path = t.stored(
        "local_profit_data",
        lambda p: snapshot.write_snapshot(
            snapshot.snapshot_rows(all_dates.contract_pnl_all_dates(t)), p
        ),
    )
    return snapshot.read_snapshot(t.spark, path)


def _stale_snapshot(t: MappedTables) -> DataFrame:
    """An older state: July not there yet, first days with other costs, and days that vanish."""
    rows = _snapshot(t)
    day, cost = F.col("criteria_date"), F.col("total_cost")
    known = rows.where(F.month(day) != 7).withColumn(
        "total_cost", F.when(F.dayofmonth(day) == 1, cost + 1).otherwise(cost).cast("decimal(15,0)")
    )
    vanishing = rows.where(F.month(day) == 12).withColumn("criteria_date", F.date_add(day, 10000))
    return known.unionByName(vanishing)


def _synced_snapshot(t: MappedTables) -> DataFrame:
    def write(path: str) -> None:
        snapshot.sync_snapshot(_stale_snapshot(t), path)
        snapshot.sync_snapshot(_snapshot(t), path)

    return snapshot.read_snapshot(t.spark, t.stored("followed_profit_data", write))


def _sums_after_deltas(t: MappedTables) -> DataFrame:
    """Purchase sums begun with the purchases up to a date, some of them twice, and then completed."""
    purchases, due = t["revenue_purchase"], F.col("date_payment")
    early = F.coalesce(due < datetime.date(1996, 1, 1), F.lit(True))
    twice = purchases.where(early & (F.col("purchase_type_two") == 28))

    def write(path: str) -> None:
        sums = purchase_sums.PurchaseSums(t.spark, path)
        sums.rebuild(purchases.where(early).unionByName(twice))
        sums.apply(purchases.where(~early & (F.year(due) < 1997)), removed=twice)
        sums.apply(purchases.where(~early & (F.year(due) >= 1997)))

    return purchase_sums.PurchaseSums(t.spark, t.stored("purchase_sums", write)).by_date()


def _filter_text(t: MappedTables) -> DataFrame:
    return grid.grid_filter(
        _snapshot(t),
        {
            "doc_name": Both(
                (
                    Condition("contains", "project 1"),
                    Condition("startsWith", "PRO"),
                    Condition("endsWith", "4"),
                )
            ),
            "doc_id": Both((Condition("notContains", "7"), Condition("notEqual", "doc-1"))),
            "biz_note": Both((Condition("notBlank"), Condition("contains", "NOTE"))),
        },
    )


def _filter_number(t: MappedTables) -> DataFrame:
    return grid.grid_filter(
        _snapshot(t),
        {
            "expected_sale": Condition("inRange", 100000, 300000),
            "occurred_sale": Condition("greaterThan", 0),
            "uncollected_sale": Condition("lessThanOrEqual", 200000),
            "profit": Condition("notEqual", 0),
            "profit_rate": Condition("notBlank"),
            "biz_note": Condition("blank"),
        },
    )


def _filter_and_or(t: MappedTables) -> DataFrame:
    return grid.grid_filter(
        t["tax_invoices"],
        {
            "vendor_name": Either((Condition("endsWith", "1"), Condition("contains", "00"))),
            "supply_amount": Both(
                (Condition("greaterThan", 20000), Condition("lessThan", 90000))
            ),
        },
    )


def _stored_roles(t: MappedTables) -> DataFrame:
    """The role changes written to a user table of its own, and that table read back."""
    path = t.stored("users_changed", lambda p: _store_users(t, p))
    return ParquetTables(t.spark, path)["users"].select(*users.PUBLIC_COLUMNS)


def _store_users(t: MappedTables, path: str) -> None:
    store = ParquetTables(t.spark, path)
    store.save("users", t["users"])
    users.store_role_changes(store, t["role_changes"])


def _update_row(t: MappedTables) -> DataFrame:
    changes = t["role_changes"].withColumnRenamed("user_id", "id")
    return grid.update_rows(t["users"], changes, "id", "seq")


def _update_fields(t: MappedTables) -> DataFrame:
    """Changes that send a role, an e-mail address, both or none; some send no address as NULL."""
    seq = F.col("seq")
    changes = t["role_changes"].select(
        F.col("user_id").alias("id"),
        "seq",
        "role",
        (seq % 2 == 0).alias("has_role"),
        F.when(seq % 2 == 0, F.concat(F.lit("new"), seq.cast("string"))).alias("email"),
        (seq % 3 == 0).alias("has_email"),
    )
    sent = {"role": "has_role", "email": "has_email"}
    return grid.update_rows(t["users"], changes, "id", "seq", sent)


# --- date functions over the orders' dates -----------------------------------------


def _thirds() -> Column:
    """An order's price in thousandths and ten-thousandths, so that rounding shows."""
    return (F.col("o_totalprice").cast("decimal(15,2)") / 80).cast("decimal(18,4)")


def _days(t: MappedTables) -> DataFrame:
    return t.source("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


def _requests(t: MappedTables) -> DataFrame:
    """Texts as typed into a date field: several shapes, some naming no day, some missing."""
    key, day = F.col("o_orderkey"), F.col("day")
    return _days(t).select(
        key.alias("request_id"),
        F.when(key % 43 == 0, F.lit(None).cast("string"))
        .when(key % 41 == 0, "no digits")
        .when(key % 37 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" and 345")))
        .when(key % 31 == 0, F.concat(F.date_format(day, "yyyyMMdd"), F.lit("1")))
        .when(key % 5 == 0, F.date_format(day, "yyyyMMdd"))
        .when(key % 5 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 5 == 2, F.concat(F.date_format(day, "yyyyMM"), F.lit("31")))
        .when(key % 5 == 3, F.concat(F.date_format(day, "yyyy/MM"), F.lit("/29 (paid)")))
        .otherwise(F.substring(F.date_format(day, "yyyyMMdd"), 1, 7))
        .alias("raw"),
    )


def _digits(t: MappedTables) -> DataFrame:
    raw = F.coalesce(F.col("raw"), F.lit(""))
    return _requests(t).select("request_id", dates.digits_only(raw).alias("digits"))


_QUERIES: dict[str, Callable[[MappedTables], DataFrame]] = {
    # contract profit and loss on one date
    "pnl_contracts": lambda t: pnl.pnl_contracts(t, DATE),
    "pnl_vat_exclusive": lambda t: pnl.vat_exclusive(t, DATE),
    "pnl_sale_sum": lambda t: _sales(t, _headers(t)),
    "pnl_purchase_sum": lambda t: _purchases(t, _headers(t)),
    "pnl_delivery_orders": _delivery_orders,
    "latest_purchase_price": lambda t: pnl.latest_purchase_price(t["purchase_order_line"]),
    "pnl_expected_product_amount": _expected,
    "latest_po_line_per_delivery_line": lambda t: pnl.latest_po_lines(t["purchase_order_line"]),
    "pnl_delivery_amounts": _delivered,
    "pnl_sale_order_amounts": _sale_orders,
    "pnl_main": _main,
    "pnl_gain": _gain,
    "pnl_remain_sale": _remain_sale,
    "pnl_etc_purchase": _etc_purchase,
    "pnl_product_value": _core("product_value", "product_value2"),
    "pnl_profit": _core("total_cost", "profit", "total_cost2", "profit2"),
    "pnl_profit_rate": _core("profit_rate", "profit_rate2"),
    "pnl_ordered": lambda t: pnl.contract_pnl(t, DATE).select("team", "doc_id", "id"),
    "contract_pnl": lambda t: pnl.contract_pnl(t, DATE),
    "contract_pnl_grid": _grid,
    # all dates
    "contract_pnl_all_dates": all_dates.contract_pnl_all_dates,
    "pnl_by_team": all_dates.pnl_by_team,
    "all_dates_after_deltas": lambda t: all_dates.contract_pnl_all_dates(
        t, _sums_after_deltas(t)
    ),
    # snapshot
    "write_snapshot": _snapshot,
    "synced_snapshot": _synced_snapshot,
    "snapshot_changes": lambda t: snapshot.snapshot_changes(_stale_snapshot(t), _snapshot(t)),
    "snapshot_rejects": lambda t: snapshot.snapshot_rejects(all_dates.contract_pnl_all_dates(t)),
    "snapshot_by_date": lambda t: snapshot.snapshot_by_date(_snapshot(t), DATE),
    # approvals and users
    "completed_approvals": lambda t: approvals.completed_approvals(
        t, datetime.date(1996, 6, 30)
    ),
    "recent_completed_approvals": lambda t: approvals.recent_completed_approvals(
        t, as_of=datetime.date(1998, 12, 31)
    ),
    "user_by_email": lambda t: users.user_by_email(t["users"], "\t user42@example.com \n"),
    "user_list": lambda t: users.user_list(t["users"]),
    "user_detail": lambda t: users.user_detail(t["users"], 42),
    "apply_role_changes": lambda t: users.apply_role_changes(
        t["users"].select(*users.PUBLIC_COLUMNS), t["role_changes"]
    ),
    "stored_role_changes": _stored_roles,
    "role_change_rejects": lambda t: users.role_change_rejects(t["role_changes"]),
    "role_allowed": lambda t: t["role_changes"].select(
        "seq", "role", rules.role_allowed(F.col("role")).alias("allowed")
    ),
    "current_logins": lambda t: users.current_logins(t["users"], t["user_login_history"]),
    "last_login": lambda t: users.last_login(t["users"], t["user_login_history"]),
    # results and exports
    "fetch_all": lambda t: grid.fetch_all(t["approval_doctype"], ["id", "name"]),
    "fetch_one": lambda t: grid.fetch_one(users.user_detail(t["users"], 42)),
    "row_count": lambda t: grid.row_count(t["tax_invoices"]),
    "preview": lambda t: grid.preview(t["vouchers"].orderBy("voucher_no")),
    "result_json": lambda t: export.result_json(t["tax_invoices"]),
    "export_csv": _export_csv,
    # declared searches
    "purchases_of_contract": lambda t: search.purchases_of_contract(t["revenue_purchase"], 42),
    "search_vouchers": lambda t: search.apply_conditions(
        t["vouchers"], search.VOUCHERS,
        {"date_range": "1996/08/01 - 1996/12/26", "status": "승인", "unit": ""},
    ),
    "search_accounts": lambda t: search.apply_conditions(
        t["accounts"], search.ACCOUNTS, {"account_code": "12", "account_name": "ACCOUNT"}
    ),
    "search_vendors_bizno": lambda t: search.apply_conditions(
        t["vendors"], search.VENDORS_BIZNO, {"vendor_name": "supplier", "biz_no": "0-0"}
    ).select("vendor_name", "biz_no", "ceo_name", "address"),
    "search_tax_invoices": lambda t: search.apply_conditions(
        t["tax_invoices"], search.TAX_INVOICES,
        {"date_range": "1996/08/01 - 1997/08/26", "tax_type": "과세", "vendor_name": "#00"},
    ),
    "search_vendor_info": lambda t: search.apply_conditions(
        t["vendors"], search.VENDOR_INFO,
        {"vendor_name": "supplier", "vendor_code": "v", "use_yn": search.ANY},
    ).select("vendor_code", "vendor_name", "biz_no", "use_yn"),
    "search_keyword": lambda t: search.search_keyword(t["vendors"], "07"),
    "apply_conditions": lambda t: search.apply_conditions(
        t["accounts"], search.ACCOUNTS, {"account_code": "", "account_name": "1010"}
    ),
    "header_detail": lambda t: search.header_detail(
        t["vouchers"], t["voucher_lines"], "voucher_no"
    ),
    # grid
    "grid_filter_text": _filter_text,
    "grid_filter_number": _filter_number,
    "grid_filter_and_or": _filter_and_or,
    "grid_sort": lambda t: grid.apply_sort(
        t["vouchers"], [("status", "asc"), ("amount", "desc"), ("memo", "none")]
    ),
    "grid_totals": lambda t: grid.grid_totals(t["voucher_lines"], ["amount"], "side"),
    "grid_update_row": _update_row,
    "grid_update_fields": _update_fields,
    "grid_update_rejects": lambda t: grid.update_rejects(t["role_changes"], "user_id", "seq"),
    # dates and display
    "closing_date": lambda t: _days(t).withColumn(
        "closing_date", dates.closing_date(F.col("day"))
    ),
    "is_valid_ymd": lambda t: _digits(t).withColumn(
        "valid", dates.is_valid_ymd(F.col("digits"))
    ),
    "format_ymd": lambda t: _digits(t).select(
        "request_id", dates.format_ymd(F.col("digits")).alias("formatted")
    ),
    "digits_only": lambda t: _requests(t).withColumn("digits", dates.digits_only(F.col("raw"))),
    "is_iso_date": lambda t: _requests(t).select(
        "request_id", dates.is_iso_date(F.col("raw")).alias("iso")
    ),
    "today_ymd": lambda t: _days(t).select("o_orderkey", dates.as_ymd(F.col("day")).alias("ymd")),
    "days_before": lambda t: _days(t).select(
        "o_orderkey", dates.days_before(F.col("day"), 365).alias("since")
    ),
    "validate_inputs": lambda t: requests.validate_inputs(_requests(t), "raw"),
    "input_rejects": lambda t: requests.input_rejects(_requests(t), "raw"),
    "fmt_currency": lambda t: t.source("orders").select(
        "o_orderkey", display.fmt_currency(_thirds()).alias("shown")
    ),
    "fmt_date": lambda t: t["approval_approval"].select(
        "id", display.fmt_date(F.col("date_complete")).alias("shown")
    ),
    "fmt_percent": lambda t: _snapshot(t).select(
        "criteria_date", "doc_id", display.fmt_percent(F.col("profit_rate")).alias("shown")
    ),
}


def _over_folder(query: Callable[[MappedTables], DataFrame]) -> Query:
    return lambda spark, folder: query(mapped_tables(spark, folder))


def _installed(module: str) -> bool:
    try:
        return find_spec(module) is not None
    except ModuleNotFoundError:  # of the package that would hold it
        return False


def _llm_part(name: str) -> dict:
    """What the training-data subpackage and its pipeline register, where they are installed."""
    if not _installed("dealmargin.llm.registry"):
        return {}
    from dealmargin.llm import registry

    part = dict(getattr(registry, name))
    if _installed("corpus_pipeline"):
        import corpus_pipeline

        if name == "QUERIES":
            part["pipeline"] = corpus_pipeline.run
        elif corpus_pipeline.ORACLE_SQL is not None:
            part["pipeline"] = corpus_pipeline.ORACLE_SQL
    return part


def core_queries() -> dict[str, Query]:
    """The registered queries outside the training-data subpackage."""
    return {name: _over_folder(query) for name, query in _QUERIES.items()}


def queries() -> dict[str, Query]:
    """Every registered query, each taking a session and the folder of the test tables."""
    return core_queries() | _llm_part("QUERIES")


def oracle_sql() -> dict[str, str]:
    """The same queries as SQL over the same tables."""
    return _oracle_sql() | _llm_part("ORACLES")
