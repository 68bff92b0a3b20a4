"""Application tables derived from the given tables.

The same SQL text defines each view for Spark and for the independent engine, so a
comparison starts from identical rows. Braces name other tables or views.
"""

from __future__ import annotations

import re

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "v_department": """
        SELECT CAST(n.n_nationkey AS STRING) AS id, n.n_name AS name, CAST(m.mgr AS STRING) AS manager_id,
               CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at
        FROM {nation} n
        LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS mgr FROM {customer} GROUP BY c_nationkey) m
          ON m.c_nationkey = n.n_nationkey""",
    "v_user": """
        SELECT CAST(c.c_custkey AS STRING) AS id, c.c_name AS name,
               'u' || CAST(c.c_custkey % 1400 AS STRING) || '@example.com' AS email,
               CASE WHEN c.c_custkey % 97 = 0 THEN NULL ELSE CAST(c.c_nationkey AS STRING) END AS department_id,
               CASE WHEN c.c_custkey = 0 THEN 'ADMIN' WHEN c.c_custkey = m.mgr THEN 'MANAGER' ELSE 'STAFF' END AS role,
               c.c_custkey % 53 = 0 AS is_deleted,
               CAST('2024-01-' || lpad(CAST(c.c_custkey % 28 + 1 AS STRING), 2, '0') || ' 00:00:00' AS TIMESTAMP) AS created_at
        FROM {customer} c
        LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS mgr FROM {customer} GROUP BY c_nationkey) m
          ON m.c_nationkey = c.c_nationkey""",
    "v_document": """
        SELECT CAST(o.o_orderkey AS STRING) AS id,
               CASE WHEN o.o_orderkey % 89 = 0 THEN NULL
                    ELSE 'doc_' || CAST(o.o_orderkey % 500 AS STRING) || '.pdf' END AS name,
               o.o_orderdate AS uploaded_at,
               CASE o.o_orderkey % 3 WHEN 0 THEN 'CONTRACT' WHEN 1 THEN 'PAY_SLIP' ELSE 'BALANCE_SHEET' END AS type,
               CASE o.o_orderkey % 6 WHEN 0 THEN 'PDF' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'CSV' WHEN 3 THEN 'PNG'
                    WHEN 4 THEN 'JPG' ELSE 'JPEG' END AS format,
               CAST(floor(o.o_totalprice * 10) AS BIGINT) AS byte_size,
               CAST(o.o_custkey AS STRING) AS uploader_id,
               CASE WHEN c.c_custkey % 97 = 0 THEN NULL ELSE CAST(c.c_nationkey AS STRING) END AS department_id,
               o.o_orderkey % 11 = 0 AS is_deleted,
               CASE o.o_orderstatus WHEN 'F' THEN 'CLEAN' WHEN 'O' THEN NULL ELSE 'INFECTED' END AS scan_status,
               CASE WHEN o.o_orderkey % 4 = 0 THEN 'message ' || CAST(o.o_orderkey AS STRING) END AS scan_message,
               CASE WHEN o.o_orderkey % 8 <> 0 THEN o.o_orderdate END AS scanned_at,
               'store/' || CAST(o.o_orderkey % 5000 AS STRING) AS document_link,
               CASE WHEN o.o_orderkey % 2 = 0 THEN 'ocr' WHEN o.o_orderkey % 7 <> 0 THEN 'text_native' END AS processing_path,
               CASE o.o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NOT_STARTED' WHEN 2 THEN 'GENERATING'
                    WHEN 3 THEN 'READY' ELSE 'FAILED' END AS redacted_preview_status,
               CAST(o.o_orderkey % 13 AS INT) AS n_items,
               o.o_custkey AS custkey, o.o_orderkey AS orderkey
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    "v_notification": """
        SELECT 'n' || d.id AS id, d.uploaded_at AS created_at, d.id AS triggered_document_id,
               u.name || ' uploaded a new document: ' || d.name AS content, p.manager_id AS receiver_id,
               d.orderkey % 4 <> 0 AS has_read
        FROM {v_document} d JOIN {v_user} u ON u.id = d.uploader_id
        JOIN {v_department} p ON p.id = u.department_id
        WHERE p.manager_id IS NOT NULL AND p.manager_id <> u.id AND d.name IS NOT NULL""",
    "v_audit": """
        SELECT ts, event_id AS seq, CAST(user_id AS STRING) AS user_id, 'User ' || CAST(user_id AS STRING) AS name,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'u' || CAST(user_id AS STRING) || '@example.com' END AS email,
               CASE event_id % 3 WHEN 0 THEN 'ROLE_ADMIN' WHEN 1 THEN 'ROLE_MANAGER' ELSE 'ROLE_STAFF' END AS role,
               CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' WHEN 'signup' THEN 'POST'
                    WHEN 'purchase' THEN 'PUT' ELSE 'DELETE' END AS method,
               '/documents/' || CAST(event_id % 50 AS STRING) AS path,
               event_type || ' document ' || CAST(event_id % 50 AS STRING) AS action,
               CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
               CAST(floor(value * 10) AS BIGINT) AS duration_ms,
               CASE WHEN event_id % 7 = 0 THEN '0:0:0:0:0:0:0:1' ELSE '10.0.' || CAST(user_id % 256 AS STRING) || '.1' END AS client_ip,
               CASE WHEN event_type = 'error' THEN 'Timeout: no reply' END AS error,
               event_type, event_id
        FROM {events}""",
    "v_payslip_values": """
        SELECT CAST(o.o_orderkey AS STRING) AS doc_id, o.o_orderkey AS k, c.c_custkey AS custkey,
               CASE WHEN c.c_custkey % 97 = 0 THEN NULL ELSE CAST(c.c_nationkey AS STRING) END AS department_id,
               CASE WHEN o.o_orderkey % 10 = 0 THEN '<insert employee name>' ELSE c.c_name END AS employee,
               'Acme ' || CAST(c.c_nationkey AS STRING) || ' Pty Ltd' AS employer,
               CAST(10 + o.o_orderkey % 90 AS STRING) || ' ' || CAST(100 + o.o_orderkey % 900 AS STRING) || ' ' ||
               CAST(100 + c.c_custkey % 900 AS STRING) || ' ' || CAST(100 + (o.o_orderkey + c.c_custkey) % 900 AS STRING) AS abn,
               CAST(1 + o.o_orderkey % 300 AS STRING) || ' High Rd, Town VIC ' || CAST(3000 + o.o_orderkey % 900 AS STRING) AS address,
               CAST(100 + c.c_custkey % 900 AS STRING) || '-' || CAST(100 + o.o_orderkey % 900 AS STRING) AS bsb,
               CAST(1000 + o.o_orderkey % 9000 AS STRING) || ' ' || CAST(1000 + c.c_custkey % 9000 AS STRING) AS account,
               CAST(10000000 + o.o_orderkey % 9000000 AS STRING) AS phone_digits,
               CASE o.o_orderkey % 4 WHEN 0 THEN '07/07/2026' WHEN 1 THEN '15/07/2026' WHEN 2 THEN '31/07/2026'
                    ELSE '12/07/2026' END AS period_end,
               CASE o.o_orderkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 14 WHEN 2 THEN 30 ELSE 11 END AS period_days,
               30 + o.o_orderkey % 120 AS annual_k,
               CAST(floor(o.o_totalprice) AS BIGINT) % 90000 + 100 AS pay,
               CASE WHEN o.o_orderkey % 7 = 0 THEN 'net' ELSE 'gross' END AS basis,
               CAST(500 + o.o_orderkey % 2000 AS DOUBLE) AS repayment
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    "v_payslip": """
        SELECT doc_id, k, custkey, department_id, repayment,
               '*Employer: ' || employer || chr(10) || '*ABN: ' || abn || chr(10) || '*Employee: ' || employee || chr(10) ||
               'Employee Address: ' || address || chr(10) || 'BSB: ' || bsb || chr(10) ||
               'Account: ' || account || ' [This is the amount paid]' || chr(10) ||
               CASE WHEN k % 6 = 0 THEN 'Phone: 04' || phone_digits || chr(10) ELSE '' END ||
               '*Pay period: 01/07/2026 to ' || period_end || chr(10) ||
               CASE WHEN k % 5 = 0 THEN '*Annual salary: [if applicable] $' || CAST(annual_k AS STRING) || ',000' || chr(10) ELSE '' END ||
               CASE WHEN basis = 'net' THEN 'NET PAY: $' ELSE 'Total gross payment: $' END ||
               CASE WHEN pay >= 1000 THEN CAST(CAST(floor(pay / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(pay % 1000 AS STRING), 3, '0')
                    ELSE CAST(pay AS STRING) END || '.50' AS text
        FROM {v_payslip_values}""",
    "v_payslip_truth": """
        SELECT doc_id, 'name' AS field, employee AS expected, CAST(NULL AS STRING) AS expected_basis FROM {v_payslip_values} WHERE k % 10 <> 0
        UNION ALL SELECT doc_id, 'bsb', bsb, CAST(NULL AS STRING) FROM {v_payslip_values}
        UNION ALL SELECT doc_id, 'abn', abn, CAST(NULL AS STRING) FROM {v_payslip_values}
        UNION ALL SELECT doc_id, 'income', CASE WHEN k % 9 = 0 THEN '$1.00' ELSE '$' || CAST(pay AS STRING) || '.50' END, 'gross' FROM {v_payslip_values}""",
    "v_balance": """
        SELECT CAST(l_orderkey AS STRING) AS doc_id, l_orderkey AS k,
               CAST(floor(round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END), 2)) AS BIGINT) AS current_assets,
               CAST(floor(round(sum(l_extendedprice), 2)) AS BIGINT) AS assets,
               CAST(floor(round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2)) AS BIGINT) AS current_liabilities,
               CAST(floor(round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END), 2)) AS BIGINT) AS liabilities
        FROM {lineitem} GROUP BY l_orderkey""",
}

# rows of a printed balance sheet: (page, row, cells separated by a bar). Page 1 carries on
# what page 0 opens.
_BALANCE_LINES = [
    (0, 0, "CASE k % 3 WHEN 0 THEN '|Year 1|Year 2' WHEN 1 THEN '|CURRENT YEAR|PRIOR YEAR' ELSE '|Amount|Share' END"),
    (0, 1, "'Current assets||'"),
    (0, 2, "'Total|$' || CAST(current_assets AS STRING) || '|$' || CAST(current_assets + 7 AS STRING)"),
    (0, 3, "'TOTAL ASSETS|$' || CAST(assets AS STRING) || '|$' || CAST(assets + 7 AS STRING)"),
    (0, 4, "'Current/short-term liabilities||'"),
    (1, 0, "'Total|$' || CAST(current_liabilities AS STRING) || '|$' || CAST(current_liabilities + 7 AS STRING)"),
    (1, 1, "CASE WHEN k % 4 = 0 THEN 'Total Liabililies' ELSE 'TOTAL LIABILITIES' END || '|$' || CAST(liabilities AS STRING) || '|$' || CAST(liabilities + 7 AS STRING)"),
    (1, 2, "'NET ASSETS (NET WORTH)|'"),
    (1, 3, "'||'"),
    (1, 4, "'$' || CAST(assets AS STRING) || '|$3'"),
]
VIEWS["v_balance_lines"] = " UNION ALL ".join(
    f"SELECT doc_id, k, {page} AS page, {row} AS row_idx, {line} AS line FROM {{v_balance}}" for page, row, line in _BALANCE_LINES
)
# the same rows in one pass over the totals
SPARK_VIEWS = {
    **VIEWS,
    "v_balance_lines": "SELECT doc_id, k, page, row_idx, line FROM {v_balance} LATERAL VIEW inline(array("
    + ", ".join(f"named_struct('page', {page}, 'row_idx', {row}, 'line', {line})" for page, row, line in _BALANCE_LINES)
    + ")) r",
}


def spark_sql_text(text: str) -> str:
    return re.sub(r"AS TIMESTAMP\)", "AS TIMESTAMP_NTZ)", text)


def _needed(text: str, done: list[str]) -> None:
    for name in VIEWS:
        if "{" + name + "}" in text and name not in done:
            _needed(VIEWS[name], done)
            done.append(name)


def with_views(sql: str) -> str:
    """A query over view names in braces as one self-contained SQL text."""
    order: list[str] = []
    _needed(sql, order)
    names = {n: n for n in [*BASE_TABLES, *VIEWS]}

    def plain(text: str) -> str:
        for n in names:
            text = text.replace("{" + n + "}", n)
        return text.replace("{{", "{").replace("}}", "}")

    body = plain(sql.strip())
    if not order:
        return body
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n]).strip()})" for n in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
