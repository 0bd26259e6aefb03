"""The queries restated as plain DuckDB SQL, to check the Spark plans against."""

from __future__ import annotations

import re

from oracles.mapping import TABLES, closing_date


def m(value: str) -> str:
    return f"CAST({value} AS DECIMAL(18,0))"


def z(value: str) -> str:
    return f"COALESCE({value}, 0)"


def rate(part: str, whole: str) -> str:
    """Tenths of a percent by whole-number division, half away from zero, then /10."""
    p, q = f"CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)"
    tenths = f"sign({part}) * ((2000 * abs({p}) + {q}) // (2 * {q}))"
    return f"CASE WHEN {whole} > 0 THEN CAST({tenths} / 10.0 AS DECIMAL(18,1)) END"


NET = "ROUND(CAST({} AS DECIMAL(18,0)) / 1.1)"

# Steps of the profit and loss for all payment dates, or for one where dated() limits the first.
STEPS: dict[str, str] = {
    "picked": """
        SELECT DISTINCT date_payment AS d, contract_doc_id AS id
        FROM revenue_purchase WHERE date_payment IS NOT NULL""",
    "heads": f"""
        SELECT d, a.id, doc_id, a.name AS doc_name, t.name AS team, e.name AS applier_name,
               {m(NET.format('amount'))} AS expected_sale, biz_done, biz_note, opportunity_id
        FROM picked JOIN approval_approval a USING (id)
        JOIN hr_employee e ON e.id = a.applier
        JOIN approval_subdepartment t ON t.id = e.subdepartment_id""",
    "terms": f"""
        SELECT approval_id,
               {m(f"CASE WHEN amount_type = 'tax_include' THEN {NET.format('cost_thr')} ELSE cost_thr END")}
                   AS con_construct,
               {m(f"CASE WHEN amount_type = 'tax_include' THEN {NET.format('cost_for')} ELSE cost_for END")}
                   AS con_fee
        FROM approval_approval_contract""",
    "sold": f"""
        SELECT contract_doc_id AS id, {m(z('sum(price)'))} AS total_sale,
               {m(z('sum(amount_collected)'))} AS sale_collected,
               {m(z('sum(amount_remain)'))} AS sale_remain
        FROM revenue_sale WHERE contract_doc_id IN (SELECT id FROM heads) GROUP BY 1""",
    "bought": f"""
        SELECT contract_doc_id AS id, {m(z('sum(price)'))} AS purchase_total,
               {m(z('sum(price) FILTER (purchase_type_two = 27)'))} AS sum_product,
               {m(z('sum(price) FILTER (purchase_type_two = 28)'))} AS sum_construction,
               {m(z('sum(price) FILTER (purchase_type_two = 29)'))} AS sum_fee,
               {m(z('sum(price) FILTER (purchase_type_two = 30)'))} AS sum_agency,
               {m(z('sum(price) FILTER (purchase_order_id > 0)'))} AS sum_po_account,
               {m(z('sum(amount_payment)'))} AS sum_payment
        FROM revenue_purchase WHERE contract_doc_id IN (SELECT id FROM heads) GROUP BY 1""",
    "due": f"""
        SELECT date_payment AS d, contract_doc_id AS id, {m(z('sum(amount_remain)'))} AS sum_remain
        FROM revenue_purchase GROUP BY 1, 2""",
    "opened": """
        SELECT DISTINCT d, opportunity_id FROM heads WHERE opportunity_id IS NOT NULL""",
    "orders_of_day": """
        SELECT opened.d, o.id, o.opportunity_id
        FROM delivery_order o JOIN opened USING (opportunity_id) WHERE o.type = 'delivery'""",
    "newest_price": """
        SELECT product_id, price_unit FROM purchase_order_line WHERE state = 'purchase'
        QUALIFY row_number() OVER (
            PARTITION BY product_id ORDER BY create_date DESC NULLS FIRST, id DESC) = 1""",
    "newest_line": """
        SELECT delivery_order_line_id, order_id FROM purchase_order_line
        WHERE state = 'purchase' AND delivery_order_line_id IS NOT NULL
        QUALIFY row_number() OVER (
            PARTITION BY delivery_order_line_id
            ORDER BY create_date DESC NULLS FIRST, id DESC) = 1""",
    "prices": """
        SELECT p.id AS product_id,
               CASE WHEN t.purchase_ok IS TRUE THEN n.price_unit ELSE t.list_price END AS unit
        FROM product_product p LEFT JOIN product_template t ON t.id = p.product_tmpl_id
        LEFT JOIN newest_price n ON n.product_id = p.id""",
    "lines_of_day": """
        SELECT o.d, l.id, l.product_id, l.quantity, l.opportunity_id
        FROM delivery_order_line l JOIN orders_of_day o ON o.id = l.order_id
        WHERE l.contract_cat IS DISTINCT FROM 'third'""",
    "expected": f"""
        SELECT d, opportunity_id,
               {m(f"ROUND(sum({z('quantity')} * {z('unit')}))")} AS total_dol_amount_all
        FROM lines_of_day LEFT JOIN prices USING (product_id) GROUP BY 1, 2""",
    "delivered": f"""
        SELECT l.d, l.opportunity_id,
               {m(f"ROUND(sum({z('s.qty_delivered')} * {z('unit')}))")} AS total_qty_delivered_amount,
               {m(f"ROUND(sum({z('l.quantity')} * {z('unit')}))")} AS total_dol_quantity_amount
        FROM lines_of_day l LEFT JOIN prices USING (product_id)
        LEFT JOIN (SELECT delivery_order_line_id, qty_delivered FROM sale_order_line
                   WHERE state <> 'cancel') s ON s.delivery_order_line_id = l.id
        WHERE NOT EXISTS (
            SELECT 1 FROM newest_line n JOIN purchase_order po ON po.id = n.order_id
            WHERE n.delivery_order_line_id = l.id)
        GROUP BY 1, 2""",
    "so_sums": f"""
        SELECT o.contract_doc_id AS id,
               {m("ROUND(sum(product_uom_qty * unit))")} AS so_price_amount,
               {m("ROUND(sum(qty_delivered * unit))")} AS so_delivered_amount
        FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id
        LEFT JOIN prices USING (product_id)
        WHERE l.state <> 'cancel' AND o.contract_doc_id IN (SELECT id FROM heads) GROUP BY 1""",
    "core": f"""
        SELECT h.d, h.id, doc_id, doc_name, team, applier_name AS "user", expected_sale,
               {m(z('total_sale'))} AS occurred_sale, {m(z('sale_remain'))} AS uncollected_sale,
               {m(f"{z('sale_collected')} - sum_payment - sum_remain")} AS gain,
               {m(f"{z('expected_sale')} - {z('total_sale')}")} AS remain_sale,
               biz_done, biz_note, purchase_total, sum_product, sum_construction, sum_fee,
               sum_agency,
               {m("purchase_total - sum_product - sum_construction - sum_fee - sum_agency")}
                   AS etc_purchase,
               h.opportunity_id, sum_remain,
               {m(z('total_qty_delivered_amount'))} AS total_qty_delivered_amount,
               {m(z('total_dol_quantity_amount'))} AS total_dol_quantity_amount,
               {m(z('total_qty_delivered_amount'))} AS product_value, total_dol_amount_all,
               {m(z('so_delivered_amount'))} AS total_so_delivered_amount,
               {m(z('so_price_amount'))} AS total_so_price_amount,
               {m(z('so_delivered_amount - sum_po_account'))} AS product_value2, sum_po_account
        FROM heads h JOIN bought USING (id) JOIN due ON due.id = h.id AND due.d = h.d
        LEFT JOIN sold ON sold.id = h.id LEFT JOIN so_sums ON so_sums.id = h.id
        LEFT JOIN expected x ON x.d = h.d AND x.opportunity_id = h.opportunity_id
        LEFT JOIN delivered y ON y.d = h.d AND y.opportunity_id = h.opportunity_id""",
    "valued": f"""
        SELECT *, {m('purchase_total + product_value')} AS total_cost,
               {m('occurred_sale - purchase_total - product_value')} AS profit,
               {rate('occurred_sale - purchase_total - product_value', 'occurred_sale')}
                   AS profit_rate,
               {m('purchase_total + product_value2')} AS total_cost2,
               {m('occurred_sale - purchase_total - product_value2')} AS profit2,
               {rate('occurred_sale - purchase_total - product_value2', 'occurred_sale')}
                   AS profit_rate2
        FROM core""",
    "pnl": """
        SELECT valued.*, con_construct, con_fee
        FROM valued LEFT JOIN terms ON terms.approval_id = valued.id""",
    "judged": """
        SELECT *, concat_ws('; ',
                   CASE WHEN length(doc_id) > 50 THEN 'doc_id too long' END,
                   CASE WHEN length(doc_name) > 200 THEN 'doc_name too long' END,
                   CASE WHEN abs(expected_sale) > 999999999999999
                        THEN 'expected_sale out of range' END,
                   CASE WHEN abs(occurred_sale) > 999999999999999
                        THEN 'occurred_sale out of range' END,
                   CASE WHEN abs(uncollected_sale) > 999999999999999
                        THEN 'uncollected_sale out of range' END,
                   CASE WHEN abs(profit) > 999999999999999 THEN 'profit out of range' END,
                   CASE WHEN abs(profit_rate) > 9999.9 THEN 'profit_rate out of range' END,
                   CASE WHEN abs(total_cost) > 999999999999999
                        THEN 'total_cost out of range' END) AS reason
        FROM pnl""",
    "snapshot": """
        SELECT doc_id, doc_name, biz_done, CAST(expected_sale AS DECIMAL(15,0)) AS expected_sale,
               CAST(occurred_sale AS DECIMAL(15,0)) AS occurred_sale,
               CAST(uncollected_sale AS DECIMAL(15,0)) AS uncollected_sale,
               CAST(profit AS DECIMAL(15,0)) AS profit,
               CAST(profit_rate AS DECIMAL(5,1)) AS profit_rate,
               CAST(total_cost AS DECIMAL(15,0)) AS total_cost, biz_note, d AS criteria_date
        FROM judged WHERE reason = ''""",
    "role_last": """
        SELECT user_id, role FROM role_changes
        WHERE role IN ('admin', 'user') AND user_id IS NOT NULL AND seq IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""",
    "newest_login": """
        SELECT * FROM user_login_history
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY login_at DESC, id DESC) = 1""",
    "request_digits": """
        SELECT request_id, raw,
               substr(regexp_replace(COALESCE(raw, ''), '[^0-9]', '', 'g'), 1, 8) AS digits
        FROM date_requests""",
    "request_all_digits": """
        SELECT request_id, raw, regexp_replace(COALESCE(raw, ''), '[^0-9]', '', 'g') AS digits
        FROM date_requests""",
    "request_checked": """
        SELECT *, CASE WHEN digits = '' THEN 'empty'
                       WHEN length(digits) <> 8 THEN 'not eight digits'
                       WHEN try_strptime(digits, '%Y%m%d') IS NULL
                            OR substr(digits, 1, 4) < '0100' THEN 'no such date' END AS reason
        FROM request_all_digits""",
}


def statement(select: str, date: str | None = None) -> str:
    """The select with every step and mapped table it needs in front of it."""
    known = {**TABLES, **STEPS}
    if date is not None:
        known["picked"] = known["picked"] + f" AND date_payment = DATE '{date}'"
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+\(?(\w+)", text)):
            if word in known and word not in needed:
                visit(known[word])
                needed.append(word)

    visit(select)
    if not needed:
        return select
    parts = ",\n".join(f"{name} AS ({known[name]}\n)" for name in needed)
    own = select.lstrip()
    if own.startswith("WITH "):
        return f"WITH {parts},\n{own[5:]}"
    return f"WITH {parts}\n{select}"


CLOSING = closing_date("CAST(o_orderdate AS DATE)")
