"""The mapped ERP tables as DuckDB common table expressions over the parquet views."""

from __future__ import annotations


def won(value: str) -> str:
    return f"CAST(ROUND({value}) AS DECIMAL(15,0))"


def exact(column: str) -> str:
    return f"CAST({column} AS DECIMAL(15,2))"


def half(key: str) -> str:
    return f"CAST(FLOOR({key} / 2) AS BIGINT)"


def opportunity(key: str) -> str:
    return f"CASE WHEN {key} % 7 <> 0 THEN {half(key)} END"


def _moved(day: str, saturday: int, sunday: int) -> str:
    return (
        f"({day} + CASE isodow({day}) WHEN 6 THEN {saturday} WHEN 7 THEN {sunday} ELSE 0 END)"
    )


def closing_date(day: str) -> str:
    first = f"CAST(date_trunc('month', {day}) AS DATE)"
    return (
        f"CAST(CASE WHEN day({day}) <= 10 THEN {_moved(f'({first} + 9)', 2, 1)} "
        f"WHEN day({day}) <= 20 THEN CASE WHEN isodow({first} + 10) = 1 "
        f"OR isodow({first} + 11) = 1 THEN {first} + 9 "
        f"ELSE {_moved(f'({first} + 19)', 2, 1)} END "
        f"ELSE {_moved(f'last_day({day})', -1, -2)} END AS DATE)"
    )


_TOTAL = exact("o_totalprice")

TABLES: dict[str, str] = {
    "li": f"""
        SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS id,
               min(l_partkey) AS partkey, min(l_suppkey) AS suppkey,
               CAST(min(l_shipdate) AS DATE) AS shipdate, min(l_returnflag) AS rf,
               {won(f"sum({exact('l_quantity')})")} AS qty,
               {won(f"sum({exact('l_extendedprice')})")} AS price
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "hr_employee": """
        SELECT s_suppkey AS id, s_name AS name,
               CASE WHEN s_suppkey % 9 <> 4 THEN s_nationkey END AS subdepartment_id
        FROM supplier""",
    "approval_subdepartment": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "approval_doctype": "SELECT r_regionkey AS id, r_name AS name FROM region",
    "approval_approval": f"""
        SELECT o_orderkey AS id, 'DOC-' || o_orderkey AS doc_id, 'Project ' || o_custkey AS name,
               o_orderkey % 6 AS doc_type, o_orderkey % 11 AS applier,
               CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'progress'
                    ELSE 'draft' END AS progress,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 13 <> 0
                    THEN CAST(o_orderdate AS DATE) END AS date_complete,
               CASE WHEN o_orderkey % 19 <> 0 THEN {won(_TOTAL)} END AS amount,
               o_orderpriority = '5-LOW' AS biz_done,
               CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
                    ELSE 'Note ' || o_orderkey % 10 END AS biz_note,
               {opportunity('o_orderkey')} AS opportunity_id
        FROM orders""",
    "approval_approval_contract": f"""
        SELECT o_orderkey AS approval_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'tax_include' WHEN 1 THEN 'tax_exclude' END
                   AS amount_type,
               {won(f"{_TOTAL} * 0.10")} AS cost_thr, {won(f"{_TOTAL} * 0.05")} AS cost_for
        FROM orders WHERE o_orderkey % 5 <> 0
        UNION ALL
        SELECT o_orderkey, 'tax_include', {won(f"{_TOTAL} * 0.02")}, {won(f"{_TOTAL} * 0.01")}
        FROM orders WHERE o_orderkey % 23 = 1""",
    "revenue_sale": """
        SELECT l_orderkey AS contract_doc_id, price,
               CASE rf WHEN 'R' THEN price WHEN 'A' THEN 0 END AS amount_collected,
               CASE rf WHEN 'R' THEN 0 ELSE price END AS amount_remain
        FROM li WHERE l_linenumber IN (1, 2)""",
    "revenue_purchase": f"""
        SELECT l_orderkey AS contract_doc_id, {closing_date('shipdate')} AS date_payment, price,
               27 + partkey % 6 AS purchase_type_two,
               CASE suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE suppkey END
                   AS purchase_order_id,
               CASE rf WHEN 'R' THEN price ELSE 0 END AS amount_payment,
               CASE rf WHEN 'R' THEN 0 WHEN 'A' THEN price END AS amount_remain
        FROM li WHERE l_linenumber IN (2, 3, 4)""",
    "delivery_order": f"""
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 4 = 0 THEN 'return' ELSE 'delivery' END AS type,
               {opportunity('o_orderkey')} AS opportunity_id
        FROM orders""",
    "delivery_order_line": f"""
        SELECT id, l_orderkey AS order_id, partkey AS product_id,
               CASE WHEN l_orderkey % 17 <> 0 THEN qty END AS quantity,
               {opportunity('l_orderkey')}
                   + CASE WHEN l_linenumber = 5 AND suppkey % 7 = 2 THEN 1 ELSE 0 END
                   AS opportunity_id,
               CASE suppkey % 5 WHEN 0 THEN 'third' WHEN 1 THEN NULL ELSE 'own' END
                   AS contract_cat
        FROM li WHERE l_linenumber IN (4, 5, 6)""",
    "purchase_order": "SELECT id FROM li WHERE l_linenumber = 6 AND suppkey % 2 = 0",
    "purchase_order_line": f"""
        SELECT id, partkey AS product_id,
               CASE WHEN suppkey % 6 <> 0
                    THEN {won("CAST(price AS DOUBLE) / CAST(qty AS DOUBLE)")} END AS price_unit,
               CASE rf WHEN 'N' THEN 'draft' ELSE 'purchase' END AS state,
               CASE WHEN suppkey % 37 <> 0 THEN shipdate END AS create_date,
               CASE WHEN l_linenumber IN (5, 6) THEN id END AS delivery_order_line_id,
               id AS order_id
        FROM li""",
    "product_product": f"""
        SELECT p_partkey AS id, {half('p_partkey')} AS product_tmpl_id
        FROM part WHERE p_partkey % 29 <> 0""",
    "product_template": f"""
        SELECT p_partkey AS id,
               CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS purchase_ok,
               {won('p_retailprice')} AS list_price
        FROM part""",
    "sale_order": """
        SELECT l_orderkey AS id, l_orderkey AS contract_doc_id FROM li WHERE l_linenumber = 7""",
    "sale_order_line": """
        SELECT id, l_orderkey AS order_id, partkey AS product_id,
               CASE WHEN l_linenumber = 7 THEN id - 3 ELSE id END AS delivery_order_line_id,
               qty AS product_uom_qty,
               CASE rf WHEN 'R' THEN qty WHEN 'A' THEN 0 END AS qty_delivered,
               CASE suppkey % 8 WHEN 0 THEN 'cancel' WHEN 1 THEN NULL ELSE 'sale' END AS state
        FROM li WHERE l_linenumber IN (4, 5, 7)""",
    "users": """
        SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email, 'x' AS password,
               CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role
        FROM customer""",
    "role_changes": """
        SELECT CASE WHEN event_id % 97 <> 0 THEN event_id END AS seq,
               CASE WHEN event_id % 89 <> 0 THEN user_id + 20 END AS user_id,
               CASE event_type WHEN 'signup' THEN 'admin' WHEN 'error' THEN 'root'
                    ELSE 'user' END AS role
        FROM events""",
    "user_login_history": """
        SELECT event_id AS id, user_id, ts AS login_at,
               CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 30 MINUTE END AS logout_at
        FROM events""",
    "vendors": """
        SELECT 'V' || s_suppkey AS vendor_code, s_name AS vendor_name,
               lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') || '-'
                   || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || '-'
                   || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') AS biz_no,
               '' AS ceo_name, '' AS address,
               CASE WHEN s_acctbal < 2000 THEN 'N' ELSE 'Y' END AS use_yn
        FROM supplier""",
    "tax_invoices": f"""
        SELECT shipdate AS issue_date, s_name AS vendor_name,
               CASE rf WHEN 'N' THEN '과세' WHEN 'R' THEN '영세' ELSE '면세' END AS tax_type,
               price AS supply_amount,
               CASE rf WHEN 'N' THEN {won('price * 0.10')} ELSE 0 END AS tax_amount
        FROM li JOIN supplier ON s_suppkey = suppkey WHERE l_linenumber = 1""",
    "vouchers": f"""
        SELECT 'FI' || o_orderkey AS voucher_no, CAST(o_orderdate AS DATE) AS acc_date,
               CAST(o_orderkey % 7 AS VARCHAR) AS dept, CAST(o_custkey AS VARCHAR) AS writer,
               o_orderpriority AS memo, {won(_TOTAL)} AS amount,
               CASE o_orderstatus WHEN 'F' THEN '승인' WHEN 'O' THEN '미결' ELSE '반려' END AS status
        FROM orders""",
    "voucher_lines": """
        SELECT 'FI' || l_orderkey AS voucher_no, CAST(l_linenumber AS INTEGER) AS line_no,
               CASE WHEN l_linenumber % 2 = 0 THEN '차변' ELSE '대변' END AS side,
               CAST(10100 + 100 * (partkey % 50) AS VARCHAR) AS account_code,
               'Account ' || (10100 + 100 * (partkey % 50)) AS account_name,
               '' AS memo_name, price AS amount, '' AS vendor_name
        FROM li""",
    "accounts": """
        SELECT DISTINCT CAST(10100 + 100 * (partkey % 50) AS VARCHAR) AS account_code,
               'Account ' || (10100 + 100 * (partkey % 50)) AS account_name,
               CASE partkey % 50 % 3 WHEN 0 THEN '자산' WHEN 1 THEN '부채' ELSE '수익' END
                   AS account_type
        FROM li""",
    # Texts as typed into a date field: several shapes, some naming no day, some missing.
    "date_requests": """
        SELECT o_orderkey AS request_id,
               CASE WHEN o_orderkey % 43 = 0 THEN NULL
                    WHEN o_orderkey % 41 = 0 THEN 'no digits'
                    WHEN o_orderkey % 37 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' and 345'
                    WHEN o_orderkey % 31 = 0 THEN strftime(o_orderdate, '%Y%m%d') || '1'
                    WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y%m%d')
                    WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y-%m-%d')
                    WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y%m') || '31'
                    WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y/%m') || '/29 (paid)'
                    ELSE substr(strftime(o_orderdate, '%Y%m%d'), 1, 7) END AS raw
        FROM orders""",
}
