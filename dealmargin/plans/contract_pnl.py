"""Contract profit and loss for one payment date, piece by piece.

Every function takes and returns DataFrames. Facts are aggregated first and
then matched with the wanted contracts: Catalyst moves the semi join below the
aggregate when the contract set is small enough to broadcast, and otherwise the
map-side partial sums have already removed any hot key from the shuffle.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from dealmargin.functions import rules
from dealmargin.functions.dates import parse_date
from dealmargin.operators.joins import Settled, settle, spread_join
from dealmargin.operators.latest import latest_by
from dealmargin.sources.schemas import AMOUNT, RATE

Tables = Mapping[str, DataFrame]

# Output columns in the order the result promises.
PNL_COLUMNS = (
    "id", "doc_id", "doc_name", "team", "user", "expected_sale", "occurred_sale",
    "uncollected_sale", "gain", "remain_sale", "biz_done", "biz_note", "purchase_total",
    "sum_product", "sum_construction", "con_construct", "sum_fee", "con_fee", "sum_agency",
    "etc_purchase", "opportunity_id", "sum_remain", "total_qty_delivered_amount",
    "total_dol_quantity_amount", "product_value", "total_dol_amount_all",
    "total_so_delivered_amount", "total_so_price_amount", "product_value2", "sum_po_account",
    "total_cost", "profit", "profit_rate", "total_cost2", "profit2", "profit_rate2",
)
GRID_COLUMNS = (
    "doc_id", "doc_name", "biz_done", "expected_sale", "occurred_sale", "uncollected_sale",
    "profit", "profit_rate", "total_cost", "product_value", "sum_product", "sum_construction",
    "sum_fee", "sum_agency", "etc_purchase", "biz_note",
)
_QUANTITY = "decimal(19,4)"  # times a unit price of decimal(18,4) stays exact in 38 digits


def money_scale(rows: DataFrame, *columns: str) -> int:
    """The most decimals that any of these columns, or else any decimal column, has."""
    kinds = [rows.schema[c].dataType for c in columns] or [f.dataType for f in rows.schema]
    return max([k.scale for k in kinds if isinstance(k, DecimalType)], default=0)


def money(column: Column, scale: int = 0) -> Column:
    return column.cast(DecimalType(AMOUNT.precision + scale, scale))


def or_zero(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))


def won(column: Column | str, scale: int = 0) -> Column:
    """Money to compute with, NULL as zero: a long where it is whole, else a decimal.

    Sums and differences of whole amounts are formed on longs: as exact as
    decimals, while decimals of more than 18 digits are objects to Spark. The
    scale comes from the column's type, so nothing is cut.
    """
    value = or_zero(F.col(column) if isinstance(column, str) else column)
    return value.cast("long") if scale == 0 else money(value, scale)


def exact(column: Column | str, scale: int = 0) -> Column:
    """Money to sum up, NULL left as it is, so that a sum of unknown amounts stays unknown."""
    amount = F.col(column) if isinstance(column, str) else column
    return amount.cast("long") if scale == 0 else amount


def won_sum(value: Column | str, scale: int = 0) -> Column:
    return or_zero(F.sum(exact(value, scale)))


# --- which contracts ---------------------------------------------------------------


def payment_contracts(purchases: DataFrame, date: datetime.date) -> DataFrame:
    """Ids of the contracts having a purchase on the payment date."""
    return (
        purchases.where(
            (F.col("date_payment") == F.lit(date)) & F.col("contract_doc_id").isNotNull()
        )
        .select(F.col("contract_doc_id").alias("id"))
        .distinct()
    )


def appliers(tables: Tables) -> DataFrame:
    """People with their team, where it exists."""
    team = tables["approval_subdepartment"].select(
        F.col("id").alias("subdepartment_id"), F.col("name").alias("team")
    )
    return (
        tables["hr_employee"]
        .join(team, "subdepartment_id")
        .select(F.col("id").alias("applier"), F.col("name").alias("user"), "team")
    )


def contract_headers(
    tables: Tables, ids: DataFrame | None = None, people: DataFrame | None = None
) -> DataFrame:
    """One row per wanted contract whose applier and the applier's team both exist.

    people are the appliers, where a caller has them with a hint: few people apply
    for very many contracts, which had better not be shuffled by their applier.
    """
    if people is None:
        people = appliers(tables)
    contracts = tables["approval_approval"]
    if ids is not None:
        contracts = contracts.join(ids, "id", "left_semi")
    return contracts.join(people, "applier").select(
        "id",
        "doc_id",
        F.col("name").alias("doc_name"),
        "team",
        "user",
        money(rules.without_vat(F.col("amount"))).alias("expected_sale"),
        "biz_done",
        "biz_note",
        "opportunity_id",
    )


def contract_terms(terms: DataFrame, contracts: DataFrame) -> DataFrame:
    """Cost terms net of VAT: a row per terms row, or one empty row for a contract without.

    Holding the empty rows too makes the later join to the contracts an inner
    one, whose either side can be split when one contract has very many terms.
    """
    taxed = F.col("amount_type") == rules.TAX_INCLUDED
    scale = money_scale(terms, "cost_thr", "cost_for")

    def net(cost: str) -> Column:
        amount = F.col(cost)
        kept = F.when(taxed, rules.without_vat(amount)).otherwise(amount)
        return money(kept, scale).alias(
            {"cost_thr": "con_construct", "cost_for": "con_fee"}[cost]
        )

    own = terms.where(F.col("approval_id").isNotNull()).withColumnRenamed("approval_id", "id")
    none = contracts.join(own.select("id").distinct(), "id", "left_anti").select(
        "id",
        money(F.lit(None), scale).alias("con_construct"),
        money(F.lit(None), scale).alias("con_fee"),
    )
    return own.select("id", net("cost_thr"), net("cost_for")).unionByName(none)


def terms_of(terms: DataFrame, ids: DataFrame) -> DataFrame:
    """The terms rows of the wanted contracts, still in the table's shape."""
    wanted = ids.withColumnRenamed("id", "approval_id")
    return spread_join(terms, wanted, ["approval_id"], "left_semi")


def pnl_contracts(tables: Tables, date: datetime.date) -> DataFrame:
    """The contracts of a payment date, repeated once per terms row where they have several."""
    headers = date_headers(tables, date)
    ids = headers.hinted("id")
    terms = terms_of(tables["approval_approval_contract"], ids)
    return with_terms(headers.rows, contract_terms(terms, ids))


def with_terms(contracts: DataFrame, terms: DataFrame) -> DataFrame:
    """The contracts' rows repeated for each of their terms rows."""
    return spread_join(terms, contracts, ["id"], "inner")


def vat_exclusive(tables: Tables, date: datetime.date) -> DataFrame:
    return pnl_contracts(tables, date).select("id", "expected_sale", "con_construct", "con_fee")


# --- sums per contract -------------------------------------------------------------


def _wanted(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows of the wanted ids. Rows are either unique on id or matched with a broadcast set."""
    return rows if ids is None else rows.join(ids, "id", "left_semi")


def sale_sums(sales: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    scale = money_scale(sales, "price", "amount_collected", "amount_remain")
    sums = (
        sales.where(F.col("contract_doc_id").isNotNull())
        .groupBy(F.col("contract_doc_id").alias("id"))
        .agg(
            money(won_sum("price", scale), scale).alias("total_sale"),
            money(won_sum("amount_collected", scale), scale).alias("sale_collected"),
            money(won_sum("amount_remain", scale), scale).alias("sale_remain"),
        )
    )
    return _wanted(sums, ids)


def _purchase_sums(purchases: DataFrame, measures: dict[str, Column]) -> DataFrame:
    scale = purchase_scale(purchases)
    return (
        purchases.where(F.col("contract_doc_id").isNotNull())
        .groupBy(F.col("contract_doc_id").alias("id"))
        .agg(*[money(won_sum(v, scale), scale).alias(name) for name, v in measures.items()])
    )


def purchase_scale(purchases: DataFrame) -> int:
    return money_scale(purchases, "price", "amount_payment", "amount_remain")


def purchase_measures() -> dict[str, Column]:
    """What a purchase row adds to each sum over all its contract's dates."""
    price, kind = F.col("price"), F.col("purchase_type_two")
    return {
        "purchase_total": price,
        **{name: F.when(kind == code, price) for name, code in rules.PURCHASE_BUCKETS.items()},
        "sum_po_account": F.when(F.col("purchase_order_id") > 0, price),
        "sum_payment": F.col("amount_payment"),
    }


def purchase_sums(
    purchases: DataFrame, date: datetime.date, ids: DataFrame | None = None
) -> DataFrame:
    """Purchases per contract over all dates, and what remains on the given date only."""
    on_date = F.when(F.col("date_payment") == F.lit(date), F.col("amount_remain"))
    measures = {**purchase_measures(), "sum_remain": on_date}
    return _wanted(_purchase_sums(purchases, measures), ids)


# --- prices ------------------------------------------------------------------------


def latest_purchase_price(purchase_lines: DataFrame) -> DataFrame:
    """Unit price of the newest confirmed purchase line of each product, over all contracts."""
    confirmed = purchase_lines.where(
        (F.col("state") == rules.CONFIRMED_PURCHASE) & F.col("product_id").isNotNull()
    )
    return latest_by(confirmed, "product_id", "create_date", "id", "price_unit")


def unit_prices(tables: Tables) -> DataFrame:
    """What one unit of a product counts for: the newest purchase price where the
    product is bought in, else the list price. NULL where that price is unknown."""
    template = tables["product_template"].withColumnRenamed("id", "product_tmpl_id")
    return (
        tables["product_product"]
        .withColumnRenamed("id", "product_id")
        .join(template, "product_tmpl_id", "left")
        .join(latest_purchase_price(tables["purchase_order_line"]), "product_id", "left")
        .select(
            "product_id",
            F.when(F.col("purchase_ok"), F.col("price_unit"))
            .otherwise(F.col("list_price"))
            .alias("unit"),
        )
    )


def settled_prices(tables: Tables) -> Settled:
    """The unit prices computed once for every join of a plan that needs them."""
    return settle(unit_prices(tables))


def priced(rows: DataFrame, prices: Settled) -> DataFrame:
    """The rows with the unit price of their product, NULL where there is none."""
    if prices.small:
        return rows.join(prices.hinted(), "product_id", "left")
    return spread_join(rows, prices.rows, ["product_id"], "left", F.col("id"))


# --- deliveries --------------------------------------------------------------------


def wanted_opportunities(headers: DataFrame) -> DataFrame:
    return headers.where(F.col("opportunity_id").isNotNull()).select("opportunity_id")


def delivery_orders(orders: DataFrame, opportunities: DataFrame | None = None) -> DataFrame:
    """Delivery-type orders of an opportunity, of the wanted opportunities if given."""
    chosen = orders.where(
        (F.col("type") == rules.DELIVERY) & F.col("opportunity_id").isNotNull()
    ).select("id", "opportunity_id")
    if opportunities is None:
        return chosen
    return spread_join(chosen, opportunities, ["opportunity_id"], "left_semi")


def latest_po_lines(purchase_lines: DataFrame, line_ids: DataFrame | None = None) -> DataFrame:
    """Newest confirmed purchase line of each delivery line, with the order it belongs to."""
    confirmed = purchase_lines.where(
        (F.col("state") == rules.CONFIRMED_PURCHASE)
        & F.col("delivery_order_line_id").isNotNull()
    )
    if line_ids is not None:
        wanted = line_ids.withColumnRenamed("id", "delivery_order_line_id")
        confirmed = confirmed.join(wanted, "delivery_order_line_id", "left_semi")
    return latest_by(confirmed, "delivery_order_line_id", "create_date", "id", "order_id")


def own_lines(tables: Tables, orders: DataFrame) -> DataFrame:
    """Delivery lines of the orders, third-party ones out, with the order's opportunity."""
    lines = tables["delivery_order_line"].where(rules.not_third_party(F.col("contract_cat")))
    order = orders.select(
        F.col("id").alias("order_id"), F.col("opportunity_id").alias("order_opportunity_id")
    )
    return lines.join(order, "order_id").drop("contract_cat")


def expected_lines(lines: DataFrame, prices: Settled) -> DataFrame:
    return priced(lines, prices).withColumn("expected", or_zero("quantity") * or_zero("unit"))


def delivered_lines(
    tables: Tables, lines: DataFrame, prices: Settled, line_ids: DataFrame | None = None
) -> DataFrame:
    """The lines with their expected, delivered and ordered amounts.

    The last two are NULL on a line covered by an existing purchase order. A
    line with several live sale lines counts its quantity once for each; the
    sale lines are summed and counted per delivery line beforehand, so nothing
    multiplies and no sale-side key can be hot. A broadcast set of the lines'
    ids, where they are few, keeps the other facts from being shuffled whole.
    """
    kept_orders = tables["purchase_order"].select(F.col("id").alias("order_id"))
    covered = (
        latest_po_lines(tables["purchase_order_line"], line_ids)
        .join(kept_orders, "order_id", "left_semi")
        .select(F.col("delivery_order_line_id").alias("id"), F.lit(True).alias("covered"))
    )
    live = (
        tables["sale_order_line"]
        .where(
            rules.not_cancelled(F.col("state")) & F.col("delivery_order_line_id").isNotNull()
        )
        .select(F.col("delivery_order_line_id").alias("id"), "qty_delivered")
    )
    sale_lines = _wanted(live, line_ids).groupBy("id").agg(
        F.sum("qty_delivered").alias("delivered"), F.count(F.lit(1)).alias("copies")
    )
    joined = lines.join(covered, "id", "left").join(sale_lines, "id", "left")
    still_open = F.col("covered").isNull()
    delivered = or_zero("delivered").cast(_QUANTITY)
    counted = (
        or_zero("quantity") * F.coalesce("copies", F.lit(1)).cast("decimal(18,0)")
    ).cast(_QUANTITY)
    return expected_lines(joined, prices).withColumns(
        {
            "delivered_amount": F.when(still_open, delivered * or_zero("unit")),
            "quantity_amount": F.when(still_open, counted * or_zero("unit")),
        }
    )


def _rounded(total: str) -> Column:
    return money(F.round(F.sum(total), 0))


def expected_product_amounts(lines: DataFrame, prices: Settled) -> DataFrame:
    """Expected amount per opportunity of the line, which need not be that of its order."""
    return (
        expected_lines(lines, prices)
        .groupBy("opportunity_id")
        .agg(_rounded("expected").alias("total_dol_amount_all"))
    )


def delivery_amounts(
    tables: Tables, lines: DataFrame, prices: Settled, line_ids: DataFrame | None = None
) -> DataFrame:
    """Delivered and ordered amounts of the lines no existing purchase order covers."""
    return (
        delivered_lines(tables, lines, prices, line_ids)
        .where(F.col("covered").isNull())
        .groupBy("opportunity_id")
        .agg(
            _rounded("delivered_amount").alias("total_qty_delivered_amount"),
            _rounded("quantity_amount").alias("total_dol_quantity_amount"),
        )
    )


LINE_TOTALS = {
    "expected": "total_dol_amount_all",
    "delivered_amount": "total_qty_delivered_amount",
    "quantity_amount": "total_dol_quantity_amount",
}


def rounded_totals() -> list[Column]:
    return [_rounded(amount).alias(name) for amount, name in LINE_TOTALS.items()]


def opportunity_amounts(
    tables: Tables, lines: DataFrame, prices: Settled, line_ids: DataFrame | None = None
) -> DataFrame:
    """Expected and delivered amounts per opportunity from a single pass over the lines."""
    return (
        delivered_lines(tables, lines, prices, line_ids)
        .where(F.col("opportunity_id").isNotNull())
        .groupBy("opportunity_id")
        .agg(*rounded_totals())
    )


# --- sale orders -------------------------------------------------------------------


def contract_sale_orders(sale_orders: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Sale orders with their contract, of the wanted contracts if given."""
    orders = sale_orders.where(F.col("contract_doc_id").isNotNull()).select(
        F.col("id").alias("order_id"), F.col("contract_doc_id").alias("contract_id")
    )
    if ids is None:
        return orders
    wanted = ids.withColumnRenamed("id", "contract_id")
    return spread_join(orders, wanted, ["contract_id"], "left_semi")


def sale_order_amounts(sale_lines: DataFrame, orders: DataFrame, prices: Settled) -> DataFrame:
    """Ordered and delivered amounts per contract over its live sale lines.

    Here an unknown factor drops its line, and a contract whose every line is
    dropped gets NULL.
    """
    lines = sale_lines.where(rules.not_cancelled(F.col("state"))).join(orders, "order_id")
    unit = F.col("unit")
    return (
        priced(lines, prices)
        .groupBy(F.col("contract_id").alias("id"))
        .agg(
            money(F.round(F.sum(F.col("product_uom_qty") * unit), 0)).alias("so_price_amount"),
            money(F.round(F.sum(F.col("qty_delivered") * unit), 0)).alias("so_delivered_amount"),
        )
    )


# --- derived columns ---------------------------------------------------------------


def gain(scale: int = 0) -> Column:
    return won("sale_collected", scale) - (won("sum_payment", scale) + won("sum_remain", scale))


def remain_sale(scale: int = 0) -> Column:
    return won("expected_sale", scale) - won("total_sale", scale)


def etc_purchase(scale: int = 0) -> Column:
    return won("purchase_total", scale) - reduce(
        lambda a, b: a + b, [won(name, scale) for name in rules.PURCHASE_BUCKETS]
    )


def product_value() -> Column:
    return won("total_qty_delivered_amount")


def product_value2(scale: int = 0) -> Column:
    """Zero, not minus the bucket, where the contract has no sale-order amount."""
    delivered, bucket = F.col("so_delivered_amount"), F.col("sum_po_account")
    return or_zero(
        delivered.cast("long") - bucket.cast("long") if scale == 0 else delivered - bucket
    )


def with_main_columns(core: DataFrame, scale: int | None = None) -> DataFrame:
    """The columns up to sum_po_account, from contracts joined with their sums.

    scale is that of the sums, to be told where core holds other amounts too.
    """
    scale = money_scale(core) if scale is None else scale
    main = {
        "occurred_sale": won("total_sale", scale),
        "uncollected_sale": won("sale_remain", scale),
        "gain": gain(scale),
        "remain_sale": remain_sale(scale),
        "etc_purchase": etc_purchase(scale),
        "total_qty_delivered_amount": won("total_qty_delivered_amount"),
        "total_dol_quantity_amount": won("total_dol_quantity_amount"),
        "product_value": product_value(),
        "total_so_delivered_amount": won("so_delivered_amount"),
        "total_so_price_amount": won("so_price_amount"),
        "product_value2": product_value2(scale),
    }
    return core.withColumns({name: money(value, scale) for name, value in main.items()})


def with_profit(main: DataFrame) -> DataFrame:
    scale = money_scale(main, "occurred_sale", "purchase_total")
    sold = won("occurred_sale", scale)
    derived = {}
    for suffix in ("", "2"):
        cost = won("purchase_total", scale) + won(f"product_value{suffix}", scale)
        derived[f"total_cost{suffix}"] = money(cost, scale)
        derived[f"profit{suffix}"] = money(sold - cost, scale)
        derived[f"profit_rate{suffix}"] = rules.percent_of(sold - cost, sold, scale).cast(RATE)
    return main.withColumns(derived)


def pnl_order() -> list[Column]:
    """By team downwards, then document; the id only settles ties."""
    return [F.coalesce("team", F.lit("")).desc(), F.col("doc_id").asc_nulls_last(), F.col("id")]


# --- the whole ---------------------------------------------------------------------


class PaymentScope(NamedTuple):
    """What one payment date selects, computed step by step from the date's purchases."""

    headers: Settled
    sale_orders: Settled
    lines: DataFrame
    line_ids: DataFrame | None
    prices: Settled

    @property
    def ids(self) -> DataFrame:
        return self.headers.hinted("id")


def date_headers(tables: Tables, date: datetime.date) -> Settled:
    ids = settle(payment_contracts(tables["revenue_purchase"], date))
    return settle(contract_headers(tables, ids.hinted()))


def date_lines(tables: Tables, headers: Settled) -> tuple[DataFrame, DataFrame | None]:
    """Delivery lines of the orders of the contracts' opportunities, and their ids if few.

    While the selections are small each is settled and broadcast to the next
    fact, which is then read once and not shuffled. Beyond that size the facts
    are joined by plain shuffles.
    """
    opportunities = wanted_opportunities(headers.rows)
    if not headers.small:
        orders = delivery_orders(tables["delivery_order"], opportunities.distinct())
        return own_lines(tables, orders), None
    orders = settle(delivery_orders(tables["delivery_order"], F.broadcast(opportunities)))
    lines = own_lines(tables, orders.hinted())
    if not orders.small:
        return lines, None
    kept = settle(lines)
    return kept.rows, kept.hinted("id") if kept.small else None


def payment_scope(tables: Tables, date: datetime.date) -> PaymentScope:
    """The selections of a payment date; those that do not build on each other run together.

    Threads take over the caller's job tags, so that a deadline reaches their jobs.
    """
    inheriting = inheritable_thread_target(tables["revenue_purchase"].sparkSession)
    with ThreadPoolExecutor(max_workers=2) as pool:
        prices = pool.submit(inheriting(settled_prices), tables)
        headers = date_headers(tables, date)
        sale_orders = pool.submit(
            inheriting(
                lambda: settle(contract_sale_orders(tables["sale_order"], headers.hinted("id")))
            )
        )
        lines, line_ids = date_lines(tables, headers)
        return PaymentScope(headers, sale_orders.result(), lines, line_ids, prices.result())


def pnl_core(scope: PaymentScope, tables: Tables, date: datetime.date) -> DataFrame:
    """One row per contract of a payment date with its main columns, terms left out.

    Sums per contract are as few as the contracts, sums per opportunity as few
    as the lines, so counts already taken say what may be broadcast. Otherwise
    the joins on the contract id come first, between sides unique on it. The
    opportunity join, and the fan-out over terms a caller may add, have keys
    that repeat without bound; each follows a shuffle of its own and can be
    split.
    """
    so_amounts = sale_order_amounts(
        tables["sale_order_line"], scope.sale_orders.hinted(), scope.prices
    )
    sums = [
        purchase_sums(tables["revenue_purchase"], date, scope.ids),
        sale_sums(tables["revenue_sale"], scope.ids),
        so_amounts,
    ]
    core = scope.headers.rows
    for each in sums:
        core = core.join(F.broadcast(each) if scope.headers.few else each, "id", "left")
    per_opportunity = opportunity_amounts(tables, scope.lines, scope.prices, scope.line_ids)
    if scope.line_ids is not None:
        core = core.join(F.broadcast(per_opportunity), "opportunity_id", "left")
    else:
        core = spread_join(core, per_opportunity, ["opportunity_id"], "left", F.col("id"))
    return with_main_columns(core)


def pnl_main(tables: Tables, date: datetime.date) -> DataFrame:
    """The core repeated for each terms row of its contract."""
    scope = payment_scope(tables, date)
    core = pnl_core(scope, tables, date)
    terms = contract_terms(
        terms_of(tables["approval_approval_contract"], scope.ids), scope.ids
    )
    # No hint: a contract's terms have no bound, nor has its free text. Few rows are shuffled
    # sooner than a job of their own would settle and count them.
    return with_terms(core, terms)


def contract_pnl(tables: Tables, date: datetime.date | str) -> DataFrame:
    """Profit and loss of every contract with a purchase on the payment date, in order.

    A text must be a real day as YYYY-MM-DD; ValueError otherwise, before any job runs.
    """
    main = pnl_main(tables, parse_date(date))
    return with_profit(main).select(*PNL_COLUMNS).orderBy(*pnl_order())


def contract_pnl_grid(pnl: DataFrame) -> DataFrame:
    """The columns the result screen shows."""
    return pnl.select(*GRID_COLUMNS)
