"""Column types of every table the plans read. Types are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, TEXT, FLAG, DAY = T.LongType(), T.StringType(), T.BooleanType(), T.DateType()
WON = T.DecimalType(15, 0)  # stored money, whole won
UNIT = T.DecimalType(18, 4)  # unit prices and quantities
AMOUNT = T.DecimalType(18, 0)  # computed money
RATE = T.DecimalType(18, 1)  # computed percentages
STORED_RATE = T.DecimalType(5, 1)  # the percentage column of the snapshot
CLOCK = T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ERP = {
    "approval_approval": _table(
        id=LONG, doc_id=TEXT, name=TEXT, doc_type=LONG, progress=TEXT, applier=LONG,
        date_complete=DAY, amount=WON, biz_done=FLAG, biz_note=TEXT, opportunity_id=LONG,
    ),
    "approval_doctype": _table(id=LONG, name=TEXT),
    "hr_employee": _table(id=LONG, name=TEXT, subdepartment_id=LONG),
    "approval_subdepartment": _table(id=LONG, name=TEXT),
    "approval_approval_contract": _table(
        approval_id=LONG, amount_type=TEXT, cost_thr=WON, cost_for=WON
    ),
    "revenue_sale": _table(
        contract_doc_id=LONG, price=WON, amount_collected=WON, amount_remain=WON
    ),
    "revenue_purchase": _table(
        contract_doc_id=LONG, date_payment=DAY, price=WON, purchase_type_two=T.IntegerType(),
        purchase_order_id=LONG, amount_payment=WON, amount_remain=WON,
    ),
    "delivery_order": _table(id=LONG, type=TEXT, opportunity_id=LONG),
    "delivery_order_line": _table(
        id=LONG, order_id=LONG, product_id=LONG, quantity=UNIT, opportunity_id=LONG,
        contract_cat=TEXT,
    ),
    "product_product": _table(id=LONG, product_tmpl_id=LONG),
    "product_template": _table(id=LONG, purchase_ok=FLAG, list_price=UNIT),
    "purchase_order": _table(id=LONG),
    "purchase_order_line": _table(
        id=LONG, product_id=LONG, price_unit=UNIT, state=TEXT, create_date=CLOCK,
        delivery_order_line_id=LONG, order_id=LONG,
    ),
    "sale_order": _table(id=LONG, contract_doc_id=LONG),
    "sale_order_line": _table(
        id=LONG, order_id=LONG, product_id=LONG, delivery_order_line_id=LONG,
        product_uom_qty=UNIT, qty_delivered=UNIT, state=TEXT,
    ),
}

# The primary keys the plans rely on being unique.
PRIMARY_KEYS = {
    name: "id"
    for name in ERP
    if name not in ("approval_approval_contract", "revenue_sale", "revenue_purchase")
}

SNAPSHOT = _table(
    doc_id=TEXT, doc_name=TEXT, biz_done=FLAG, expected_sale=WON, occurred_sale=WON,
    uncollected_sale=WON, profit=WON, profit_rate=STORED_RATE, total_cost=WON, biz_note=TEXT,
    criteria_date=DAY,
)

LOCAL = {
    "users": _table(id=LONG, email=TEXT, password=TEXT, role=TEXT),
    "role_changes": _table(seq=LONG, user_id=LONG, role=TEXT),
    "user_login_history": _table(
        id=LONG, user_id=LONG, login_at=CLOCK, logout_at=CLOCK, ip_address=TEXT, session_id=TEXT
    ),
}

SCREEN = {
    "accounts": _table(account_code=TEXT, account_name=TEXT, account_type=TEXT),
    "vouchers": _table(
        voucher_no=TEXT, acc_date=DAY, dept=TEXT, writer=TEXT, memo=TEXT, amount=WON, status=TEXT
    ),
    "voucher_lines": _table(
        voucher_no=TEXT, line_no=T.IntegerType(), side=TEXT, account_code=TEXT, account_name=TEXT,
        memo_name=TEXT, amount=WON, vendor_name=TEXT,
    ),
    "vendors": _table(vendor_code=TEXT, vendor_name=TEXT, biz_no=TEXT, ceo_name=TEXT,
                      address=TEXT, use_yn=TEXT),
    "tax_invoices": _table(
        issue_date=DAY, vendor_name=TEXT, tax_type=TEXT, supply_amount=WON, tax_amount=WON
    ),
}

ALL = {**ERP, **LOCAL, **SCREEN}
