"""Coded values of the ERP tables and the predicates built on them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Fixed values of the ERP's coded columns.
PURCHASE_BUCKETS = {
    "sum_product": 27,
    "sum_construction": 28,
    "sum_fee": 29,
    "sum_agency": 30,
}
TAX_INCLUDED = "tax_include"
COMPLETE = "complete"
DELIVERY = "delivery"
THIRD_PARTY = "third"
CONFIRMED_PURCHASE = "purchase"
CANCELLED_SALE = "cancel"
ROLES = ("admin", "user")
VAT_DIVISOR = Decimal("1.1")


def without_vat(amount: Column) -> Column:
    """A tax-included amount net of VAT, rounded half away from zero to whole won."""
    return F.round(amount / F.lit(VAT_DIVISOR), 0)


def not_third_party(category: Column) -> Column:
    """Everything but third-party lines; an empty category stays."""
    return ~category.eqNullSafe(F.lit(THIRD_PARTY))


def not_cancelled(state: Column) -> Column:
    """Neither cancelled nor of unknown state: a NULL state is dropped as well."""
    return state != CANCELLED_SALE


def role_allowed(role: Column) -> Column:
    return F.coalesce(role.isin(*ROLES), F.lit(False))


def percent_of(part: Column, whole: Column, scale: int = 0) -> Column:
    """part / whole * 100 to one decimal, NULL unless whole is positive.

    The casts keep eighteen decimals through the division, less the amounts' own;
    wider inputs would make Spark trade decimals for integer digits.
    """
    ratio = part.cast(DecimalType(20 + scale, scale)) / whole.cast(DecimalType(18 + scale, scale))
    return F.when(whole > 0, F.round(ratio * 100, 1))
