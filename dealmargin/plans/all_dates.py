"""Contract profit and loss of every payment date in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmargin.functions import rules
from dealmargin.operators.joins import settle, spread_join
from dealmargin.plans import contract_pnl as one
from dealmargin.plans.contract_pnl import Tables
from dealmargin.plans.purchase_sums import sums_by_date
from dealmargin.sources.schemas import RATE


def purchases_by_date(purchases: DataFrame) -> DataFrame:
    """Every purchase sum per contract and payment date, settled.

    The one pass over the purchases: totals per contract, what remains on each
    date, and the dates themselves all come from its rows.
    """
    return settle(sums_by_date(purchases)).rows


def totals_of(by_date: DataFrame) -> DataFrame:
    """Purchases per contract over all dates."""
    scale = one.money_scale(by_date)
    return by_date.groupBy("id").agg(
        *[one.money(F.sum(name), scale).alias(name) for name in one.purchase_measures()]
    )


def dues_of(by_date: DataFrame) -> DataFrame:
    """What remains to be paid per contract and payment date."""
    return by_date.where(F.col("date_payment").isNotNull()).select(
        "id",
        "date_payment",
        one.money(F.col("sum_remain"), one.money_scale(by_date)).alias("sum_remain"),
    )


def dated_opportunities(by_date: DataFrame, headers: DataFrame) -> DataFrame:
    """What remains to be paid per contract and payment date, with the contract's opportunity."""
    chosen = headers.where(F.col("id").isNotNull()).select("id", "opportunity_id")
    # The shuffle that the join needs, told beforehand: else the aggregate makes one more.
    return dues_of(by_date).join(chosen.repartition("id").distinct(), "id")


def opportunities_by_date(dues: DataFrame) -> DataFrame:
    """The opportunities whose contracts have a purchase on each payment date."""
    chosen = dues.where(F.col("opportunity_id").isNotNull())
    return chosen.select("date_payment", "opportunity_id").distinct()


def amounts_by_date(tables: Tables, prices: one.Settled, dated: DataFrame) -> DataFrame:
    """Delivery amounts per payment date and opportunity of the line.

    A line counts on a date when the opportunity of its order is chosen that
    day, which matters where line and order name different opportunities. So
    lines are summed per pair of the two first, once for all dates, and dates
    are attached to the pairs, not to the lines.
    """
    orders = one.delivery_orders(tables["delivery_order"])
    pairs = (
        one.delivered_lines(tables, one.own_lines(tables, orders), prices)
        .where(F.col("opportunity_id").isNotNull())
        .groupBy("opportunity_id", "order_opportunity_id")
        .agg(*[F.sum(amount).alias(amount) for amount in one.LINE_TOTALS])
    )
    order_side = dated.withColumnRenamed("opportunity_id", "order_opportunity_id")
    candidates = dated.join(pairs, "opportunity_id")
    keys = ["date_payment", "order_opportunity_id"]
    return (
        spread_join(candidates, order_side, keys, "left_semi")
        .groupBy("date_payment", "opportunity_id")
        .agg(*one.rounded_totals())
    )


def dated_contracts(tables: Tables, by_date: DataFrame | None = None) -> DataFrame:
    """Main columns and profit of each contract on each of its payment dates, terms left out.

    by_date are sums of the purchases kept by PurchaseSums, which save reading them.
    """
    return one.with_profit(one.with_main_columns(_dated_core(tables, by_date)))


def _dated_core(tables: Tables, by_date: DataFrame | None) -> DataFrame:
    """Each contract on each of its payment dates, with the sums its columns are made of.

    Contracts are shuffled by their id alone. What depends on the date finds its
    opportunity's amounts in narrow rows and meets the contracts' texts and sums last.
    """
    prices = one.settled_prices(tables)
    people = settle(one.appliers(tables))
    headers = one.contract_headers(
        tables, people=F.broadcast(people.rows) if people.light else people.rows
    )
    so_amounts = one.sale_order_amounts(
        tables["sale_order_line"], one.contract_sale_orders(tables["sale_order"]), prices
    )
    if by_date is None:
        by_date = purchases_by_date(tables["revenue_purchase"])
    per_contract = (
        headers.join(totals_of(by_date), "id")
        .join(one.sale_sums(tables["revenue_sale"]), "id", "left")
        .join(so_amounts, "id", "left")
    )
    dues = dated_opportunities(by_date, headers)
    dated = settle(opportunities_by_date(dues)).rows
    amounts = amounts_by_date(tables, prices, dated)
    keys = ["date_payment", "opportunity_id"]
    costs = spread_join(dues, amounts, keys, "left", F.col("id")).withColumnsRenamed(
        {"id": "_id", "opportunity_id": "_opportunity"}
    )
    # Only contracts whose id repeats differ in their opportunity; as no key of the join it
    # needs no shuffle of its own.
    own, other = F.col("opportunity_id"), F.col("_opportunity")
    same = F.coalesce(own == other, own.isNull() & other.isNull())
    core = per_contract.join(costs, (F.col("id") == F.col("_id")) & same)
    return core.drop("_id", "_opportunity")


def contract_pnl_all_dates(tables: Tables, by_date: DataFrame | None = None) -> DataFrame:
    """The rows of contract_pnl for every payment date, with that date in front."""
    contracts = tables["approval_approval"].select("id")
    terms = one.contract_terms(tables["approval_approval_contract"], contracts)
    # Terms repeat the sums, not the columns derived from them, which would be shuffled as well.
    core = _dated_core(tables, by_date)
    whole = one.with_profit(
        one.with_main_columns(one.with_terms(core, terms), one.money_scale(core))
    )
    return whole.select("date_payment", *one.PNL_COLUMNS)


_ADDITIVE = (
    "expected_sale", "occurred_sale", "uncollected_sale", "gain", "remain_sale", "purchase_total",
    *rules.PURCHASE_BUCKETS, "etc_purchase", "sum_remain",
)


def pnl_by_team(tables: Tables, by_date: DataFrame | None = None) -> DataFrame:
    """Profit and loss per payment date and team.

    A contract counts once, whatever number of terms rows it has. An
    opportunity's delivery amount, which every contract sharing it repeats,
    counts once per team and date, so team costs are no plain sum of contract
    costs.
    """
    contracts = dated_contracts(tables, by_date)
    scale = one.money_scale(contracts, *_ADDITIVE)
    per_opportunity = (
        contracts.groupBy("date_payment", "team", "opportunity_id")
        .agg(
            F.count(F.lit(1)).alias("contracts"),
            F.max("product_value").alias("product_value"),
            *[F.sum(one.exact(name, scale)).alias(name) for name in _ADDITIVE],
        )
    )
    summed = per_opportunity.groupBy("date_payment", "team").agg(
        F.sum("contracts").alias("contracts"),
        *[one.money(F.sum(name), scale).alias(name) for name in _ADDITIVE],
        one.money(one.won_sum("product_value", scale), scale).alias("product_value"),
    )
    cost = one.won("purchase_total", scale) + one.won("product_value", scale)
    profit = one.won("occurred_sale", scale) - cost
    return summed.withColumns(
        {
            "total_cost": one.money(cost, scale),
            "profit": one.money(profit, scale),
            "profit_rate": rules.percent_of(profit, F.col("occurred_sale"), scale).cast(RATE),
        }
    )
