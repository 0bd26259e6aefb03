"""DuckDB SQL of every checked query, under the names the queries are registered by."""

from __future__ import annotations

from oracles.statements import CLOSING, m, statement, z

DATE = "1995-08-10"
_BUCKETS = "purchase_total, sum_product, sum_construction, sum_fee, sum_agency"
_MAIN = (
    'id, doc_id, doc_name, team, "user", expected_sale, occurred_sale, uncollected_sale, gain, '
    "remain_sale, biz_done, biz_note, purchase_total, sum_product, sum_construction, "
    "con_construct, sum_fee, con_fee, sum_agency, etc_purchase, opportunity_id, sum_remain, "
    "total_qty_delivered_amount, total_dol_quantity_amount, product_value, "
    "total_dol_amount_all, total_so_delivered_amount, total_so_price_amount, product_value2, "
    "sum_po_account"
)
_PNL = _MAIN + ", total_cost, profit, profit_rate, total_cost2, profit2, profit_rate2"
_GRID = (
    "doc_id, doc_name, biz_done, expected_sale, occurred_sale, uncollected_sale, profit, "
    "profit_rate, total_cost, product_value, sum_product, sum_construction, sum_fee, sum_agency, "
    "etc_purchase, biz_note"
)
_LOOKUP = (
    "doc_id, doc_name, biz_done, expected_sale, occurred_sale, uncollected_sale, profit, "
    "profit_rate, total_cost, biz_note"
)
_APPROVED = """
    SELECT a.name, a.doc_id, t.name AS doc_type_name, a.progress, e.name AS applier_name,
           a.date_complete
    FROM approval_approval a LEFT JOIN approval_doctype t ON t.id = a.doc_type
    LEFT JOIN hr_employee e ON e.id = a.applier
    WHERE a.progress = 'complete' AND a.date_complete >= DATE '{}'"""
_CONTRACTS = """
    SELECT h.id, doc_id, doc_name, team, applier_name AS "user", expected_sale, biz_done,
           biz_note, opportunity_id, con_construct, con_fee
    FROM heads h LEFT JOIN terms ON terms.approval_id = h.id"""
_SUMMED = (
    "expected_sale", "occurred_sale", "uncollected_sale", "gain", "remain_sale",
    "purchase_total", "sum_product", "sum_construction", "sum_fee", "sum_agency",
    "etc_purchase", "sum_remain",
)
_TEAM_SUMS = ", ".join(f"{m(f'sum({name})')} AS {name}" for name in _SUMMED)

ON_DATE = {
    "pnl_contracts": _CONTRACTS,
    "pnl_vat_exclusive": f"SELECT id, expected_sale, con_construct, con_fee FROM ({_CONTRACTS}) q",
    "pnl_sale_sum": "SELECT * FROM sold",
    "pnl_purchase_sum": """
        SELECT bought.*, sum_remain FROM bought JOIN due USING (id)
        JOIN heads ON heads.id = due.id AND heads.d = due.d""",
    "pnl_delivery_orders": "SELECT id, opportunity_id FROM orders_of_day",
    "pnl_expected_product_amount": "SELECT opportunity_id, total_dol_amount_all FROM expected",
    "pnl_delivery_amounts": """
        SELECT opportunity_id, total_qty_delivered_amount, total_dol_quantity_amount
        FROM delivered""",
    "pnl_sale_order_amounts": "SELECT id, so_price_amount, so_delivered_amount FROM so_sums",
    "pnl_main": f"SELECT {_MAIN} FROM pnl",
    "pnl_gain": f"""
        SELECT h.id, {m(z('sale_collected'))} AS sale_collected, sum_payment, sum_remain,
               {m(f"{z('sale_collected')} - (sum_payment + sum_remain)")} AS gain
        FROM heads h JOIN bought USING (id) JOIN due ON due.id = h.id AND due.d = h.d
        LEFT JOIN sold ON sold.id = h.id""",
    "pnl_remain_sale": f"""
        SELECT h.id, expected_sale, {m(z('total_sale'))} AS total_sale,
               {m(f"{z('expected_sale')} - {z('total_sale')}")} AS remain_sale
        FROM heads h LEFT JOIN sold ON sold.id = h.id""",
    "pnl_etc_purchase": f"""
        SELECT h.id, {_BUCKETS},
               {m("purchase_total - sum_product - sum_construction - sum_fee - sum_agency")}
                   AS etc_purchase
        FROM heads h JOIN bought USING (id)""",
    "pnl_product_value": "SELECT id, product_value, product_value2 FROM core",
    "pnl_profit": "SELECT id, total_cost, profit, total_cost2, profit2 FROM valued",
    "pnl_profit_rate": "SELECT id, profit_rate, profit_rate2 FROM valued",
    "pnl_ordered": "SELECT team, doc_id, id FROM pnl ORDER BY COALESCE(team, '') DESC, doc_id",
    "contract_pnl": f"SELECT {_PNL} FROM pnl",
    "contract_pnl_grid": f"SELECT {_GRID} FROM pnl",
    "export_csv": f"SELECT {_GRID} FROM pnl",
}

OVER_ALL = {
    "latest_purchase_price": """
        SELECT product_id, CAST(price_unit AS DECIMAL(18,4)) AS price_unit FROM newest_price""",
    "latest_po_line_per_delivery_line": "SELECT delivery_order_line_id, order_id FROM newest_line",
    "contract_pnl_all_dates": f"SELECT d AS date_payment, {_PNL} FROM pnl",
    "all_dates_after_deltas": f"SELECT d AS date_payment, {_PNL} FROM pnl",
    "pnl_by_team": f"""
        WITH by_opportunity AS (
            SELECT d, team, opportunity_id, count(*) AS contracts,
                   max(product_value) AS product_value,
                   {", ".join(f"sum({name}) AS {name}" for name in _SUMMED)}
            FROM valued GROUP BY ALL),
        summed AS (
            SELECT d AS date_payment, team, CAST(sum(contracts) AS BIGINT) AS contracts,
                   {m('sum(product_value)')} AS product_value, {_TEAM_SUMS}
            FROM by_opportunity GROUP BY ALL)
        SELECT *, {m('purchase_total + product_value')} AS total_cost,
               {m('occurred_sale - purchase_total - product_value')} AS profit,
               CASE WHEN occurred_sale > 0 THEN CAST(
                   sign(occurred_sale - purchase_total - product_value)
                   * ((2000 * abs(CAST(occurred_sale - purchase_total - product_value AS HUGEINT))
                       + CAST(occurred_sale AS HUGEINT)) // (2 * CAST(occurred_sale AS HUGEINT)))
                   / 10.0 AS DECIMAL(18,1)) END AS profit_rate
        FROM summed""",
    "write_snapshot": "SELECT * FROM snapshot",
    "synced_snapshot": "SELECT * FROM snapshot",
    "snapshot_changes": """
        WITH stale AS (
            SELECT * REPLACE (CASE WHEN day(criteria_date) = 1 THEN total_cost + 1
                              ELSE total_cost END AS total_cost)
            FROM snapshot WHERE month(criteria_date) <> 7
            UNION ALL
            SELECT * REPLACE (criteria_date + 10000 AS criteria_date)
            FROM snapshot WHERE month(criteria_date) = 12),
        old_state AS (
            SELECT criteria_date, doc_id, list(CAST(stale AS VARCHAR) ORDER BY CAST(stale AS VARCHAR)) AS own
            FROM stale GROUP BY ALL),
        new_state AS (
            SELECT criteria_date, doc_id,
                   list(CAST(snapshot AS VARCHAR) ORDER BY CAST(snapshot AS VARCHAR)) AS own
            FROM snapshot GROUP BY ALL)
        SELECT criteria_date, doc_id,
               CASE WHEN o.own IS NULL THEN 'added' WHEN n.own IS NULL THEN 'removed'
                    ELSE 'changed' END AS change
        FROM old_state o FULL JOIN new_state n USING (criteria_date, doc_id)
        WHERE o.own IS DISTINCT FROM n.own""",
    "snapshot_rejects": f"""
        SELECT {_LOOKUP}, d AS criteria_date, reason FROM judged WHERE reason <> ''""",
    "snapshot_by_date": f"""
        SELECT {_LOOKUP} FROM snapshot WHERE criteria_date = DATE '{DATE}' ORDER BY doc_id""",
    "completed_approvals": _APPROVED.format("1996-06-30"),
    "recent_completed_approvals": _APPROVED.format("1997-12-31"),
    "user_by_email": """
        SELECT id, email, password, role FROM users WHERE email = 'user42@example.com'""",
    "user_list": "SELECT id, email, role FROM users ORDER BY id",
    "user_detail": "SELECT id, email, role FROM users WHERE id = 42",
    "fetch_all": "SELECT code.id, code.name FROM approval_doctype code",
    "fetch_one": "SELECT id, email, role FROM users WHERE id = 42",
    "purchases_of_contract": "SELECT * FROM revenue_purchase WHERE contract_doc_id = 42",
    "search_vouchers": """
        SELECT * FROM vouchers WHERE status = '승인'
        AND acc_date BETWEEN DATE '1996-08-01' AND DATE '1996-12-26'""",
    "search_accounts": """
        SELECT * FROM accounts WHERE account_code LIKE '%12%' AND account_name ILIKE '%ACCOUNT%'""",
    "search_vendors_bizno": """
        SELECT vendor_name, biz_no, ceo_name, address FROM vendors
        WHERE vendor_name ILIKE '%supplier%' AND biz_no LIKE '%0-0%'""",
    "search_tax_invoices": """
        SELECT * FROM tax_invoices WHERE tax_type = '과세' AND vendor_name ILIKE '%#00%'
        AND issue_date BETWEEN DATE '1996-08-01' AND DATE '1997-08-26'""",
    "search_vendor_info": """
        SELECT vendor_code, vendor_name, biz_no, use_yn FROM vendors
        WHERE vendor_code ILIKE '%v%' AND vendor_name ILIKE '%supplier%'""",
    "search_keyword": """
        SELECT * FROM vendors
        WHERE concat_ws(chr(10), vendor_code, vendor_name, biz_no, ceo_name, address, use_yn)
              ILIKE '%07%'""",
    "apply_conditions": """
        SELECT * FROM accounts WHERE account_name ILIKE '%1010%'""",
    "header_detail": f"""
        SELECT v.*, {z('n')} AS detail_count, CAST({z('s')} AS DECIMAL(25,0)) AS detail_amount
        FROM vouchers v LEFT JOIN (
            SELECT voucher_no, count(*) AS n, sum(amount) AS s FROM voucher_lines GROUP BY 1) q
        USING (voucher_no)""",
    "closing_date": f"""
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {CLOSING} AS closing_date
        FROM orders""",
    "is_valid_ymd": """
        SELECT request_id, digits, length(digits) = 8 AND substr(digits, 1, 4) >= '0100'
               AND try_strptime(digits, '%Y%m%d') IS NOT NULL AS valid
        FROM request_digits""",
    "format_ymd": """
        SELECT request_id, CASE WHEN length(digits) = 8 THEN substr(digits, 1, 4) || '-'
               || substr(digits, 5, 2) || '-' || substr(digits, 7, 2) END AS formatted
        FROM request_digits""",
    "digits_only": """
        SELECT request_id, raw,
               substr(regexp_replace(raw, '[^0-9]', '', 'g'), 1, 8) AS digits
        FROM date_requests""",
    "is_iso_date": """
        SELECT request_id, regexp_full_match(COALESCE(raw, ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}')
               AS iso
        FROM date_requests""",
    "today_ymd": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS ymd FROM orders",
    "days_before": """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) - 365 AS since FROM orders""",
    "validate_inputs": """
        SELECT request_id, raw, substr(digits, 1, 4) || '-' || substr(digits, 5, 2) || '-'
               || substr(digits, 7, 2) AS request_date
        FROM request_checked WHERE reason IS NULL""",
    "input_rejects": """
        SELECT request_id, raw, reason FROM request_checked WHERE reason IS NOT NULL""",
    "fmt_currency": """
        WITH priced AS (
            SELECT o_orderkey,
                   round(CAST(o_totalprice AS DECIMAL(15,2)) * 125, 0)::BIGINT AS tenthousandths
            FROM orders),
        shown AS (SELECT o_orderkey, (tenthousandths + 5) // 10 AS k FROM priced)
        SELECT o_orderkey, format('{:,}', k // 1000)
               || CASE WHEN k % 1000 = 0 THEN ''
                  ELSE '.' || rtrim(lpad(CAST(k % 1000 AS VARCHAR), 3, '0'), '0') END AS shown
        FROM shown""",
    "fmt_date": """
        SELECT id, COALESCE(strftime(date_complete, '%Y-%m-%d'), '') AS shown
        FROM approval_approval""",
    "fmt_percent": """
        SELECT criteria_date, doc_id, COALESCE(CAST(profit_rate AS VARCHAR) || '%', '') AS shown
        FROM snapshot""",
    "role_allowed": """
        SELECT seq, role, role IN ('admin', 'user') AS allowed FROM role_changes""",
    "apply_role_changes": """
        SELECT u.id, email, COALESCE(r.role, u.role) AS role
        FROM users u LEFT JOIN role_last r ON r.user_id = u.id""",
    "role_change_rejects": """
        SELECT seq, user_id, role, CASE WHEN role NOT IN ('admin', 'user') THEN 'role not allowed'
                   WHEN user_id IS NULL THEN 'no user' ELSE 'no sequence' END AS reason
        FROM role_changes
        WHERE role NOT IN ('admin', 'user') OR user_id IS NULL OR seq IS NULL""",
    "stored_role_changes": """
        SELECT u.id, email, COALESCE(r.role, u.role) AS role
        FROM users u LEFT JOIN role_last r ON r.user_id = u.id""",
    "current_logins": """
        SELECT u.id, email, login_at FROM newest_login n JOIN users u ON u.id = n.user_id
        WHERE n.logout_at IS NULL""",
    "last_login": """
        SELECT u.id, email, max(login_at) AS last_login_at
        FROM users u LEFT JOIN user_login_history h ON h.user_id = u.id GROUP BY 1, 2""",
    "grid_filter_text": """
        SELECT * FROM snapshot
        WHERE doc_name ILIKE '%project 1%' AND doc_id NOT ILIKE '%7%' AND biz_note ILIKE '%note%'
              AND doc_id <> 'DOC-1' AND doc_name ILIKE 'PRO%' AND doc_name ILIKE '%4'""",
    "grid_filter_number": """
        SELECT * FROM snapshot
        WHERE expected_sale BETWEEN 100000 AND 300000 AND occurred_sale > 0
              AND uncollected_sale <= 200000 AND profit <> 0 AND profit_rate IS NOT NULL
              AND COALESCE(biz_note, '') = ''""",
    "grid_filter_and_or": """
        SELECT * FROM tax_invoices
        WHERE (vendor_name ILIKE '%1' OR vendor_name ILIKE '%00%')
              AND supply_amount > 20000 AND supply_amount < 90000""",
    "grid_sort": """
        SELECT * FROM vouchers ORDER BY status ASC NULLS FIRST, amount DESC NULLS LAST""",
    "grid_totals": """
        SELECT voucher_no, line_no, side, account_code, account_name, memo_name,
               CAST(amount AS DECIMAL(25,0)) AS amount, vendor_name
        FROM voucher_lines
        UNION ALL
        SELECT '', NULL, '합계', '', '', '', CAST(sum(amount) AS DECIMAL(25,0)), ''
        FROM voucher_lines""",
    "grid_update_row": """
        SELECT u.id, email, password, COALESCE(r.role, u.role) AS role
        FROM users u LEFT JOIN (
            SELECT user_id, role FROM role_changes WHERE seq IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1) r
        ON r.user_id = u.id""",
    "grid_update_fields": """
        WITH roles AS (
            SELECT user_id, role FROM role_changes WHERE seq % 2 = 0
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1),
        emails AS (
            SELECT user_id, CASE WHEN seq % 2 = 0 THEN 'new' || seq END AS email
            FROM role_changes WHERE seq % 3 = 0
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1)
        SELECT u.id, CASE WHEN e.user_id IS NULL THEN u.email ELSE e.email END AS email, password,
               CASE WHEN r.user_id IS NULL THEN u.role ELSE r.role END AS role
        FROM users u LEFT JOIN roles r ON r.user_id = u.id LEFT JOIN emails e ON e.user_id = u.id""",
    "grid_update_rejects": """
        SELECT *, CASE WHEN user_id IS NULL THEN 'no key' ELSE 'no sequence' END AS reason
        FROM role_changes WHERE user_id IS NULL OR seq IS NULL""",
    "row_count": "SELECT count(*) AS row_count FROM tax_invoices",
    "preview": "SELECT * FROM vouchers ORDER BY voucher_no LIMIT 5",
    "result_json": """
        SELECT CAST(to_json(struct_pack(
                   issue_date := CAST(issue_date AS VARCHAR), vendor_name := vendor_name,
                   tax_type := tax_type, supply_amount := CAST(supply_amount AS VARCHAR),
                   tax_amount := CAST(CAST(tax_amount AS DECIMAL(15,0)) AS VARCHAR))) AS VARCHAR)
               AS json
        FROM tax_invoices""",
}


def oracle_sql() -> dict[str, str]:
    checked = {name: statement(text, DATE) for name, text in ON_DATE.items()}
    for name, text in OVER_ALL.items():
        checked[name] = statement(text)
    return checked
