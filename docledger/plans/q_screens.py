"""Queries behind the screens: lists, search, sorting, paging, access, display."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import display as D
from ..operators import access, audit, document_list, integrity, listing, views
from .registry import query



def _view(t):
    return views.document_view(t["v_document"], t["v_user"], t["v_department"])


@query("fil1_live_by_department", "SELECT department_id, count(*) AS n FROM {v_document} WHERE NOT is_deleted AND department_id IS NOT NULL GROUP BY 1")
def _(t):
    return views.live(t["v_document"]).filter(F.col("department_id").isNotNull()).groupBy("department_id").agg(F.count("*").alias("n"))


@query("fil1_live_by_uploader", "SELECT id, name FROM {v_document} WHERE NOT is_deleted AND uploader_id = '7'")
def _(t):
    return views.by_uploader(views.live(t["v_document"]), "7").select("id", "name")


@query("fil1_live_by_id", "SELECT id, name, uploader_id FROM {v_document} WHERE NOT is_deleted AND id = '25'")
def _(t):
    return views.by_id(views.live(t["v_document"]), "25").select("id", "name", "uploader_id")


@query(
    "fil2_search_documents",
    """SELECT d.id, d.name, d.type, u.name AS uploader_name FROM {v_document} d JOIN {v_user} u ON u.id = d.uploader_id
       WHERE contains(lower(d.name), 'slip') OR contains(lower(d.type), 'slip') OR contains(lower(u.name), 'slip')""",
)
def _(t):
    return views.search_documents(_view(t), "SLIP").select("id", "name", "type", "uploader_name")


@query(
    "fil2_search_documents_blank",
    """SELECT d.type, count(*) AS n FROM {v_document} d JOIN {v_user} u ON u.id = d.uploader_id GROUP BY 1""",
)
def _(t):
    return views.search_documents(_view(t), "").groupBy("type").agg(F.count("*").alias("n"))


@query(
    "fil3_search_audit",
    """SELECT seq, action FROM {v_audit} WHERE contains(lower(email), '50') OR contains(lower(action), '50') OR contains(lower(role), '50')
       OR contains(lower(path), '50') OR contains(lower(client_ip), '50') OR contains(CAST(status AS VARCHAR), '50')""",
)
def _(t):
    return views.search_audit(t["v_audit"], "50").select("seq", "action")


@query(
    "fil4_search_any",
    """SELECT id, email FROM {v_user} WHERE contains(lower(coalesce(id, '')), '12') OR contains(lower(coalesce(name, '')), '12')
       OR contains(lower(coalesce(email, '')), '12') OR contains(lower(coalesce(department_id, '')), '12') OR contains(lower(role), '12')""",
)
def _(t):
    return views.search_any(t["v_user"], "12", ["id", "name", "email", "department_id", "role"]).select("id", "email")


@query(
    "fil5_query_audit",
    """SELECT seq, user_id, path FROM {v_audit} WHERE upper(method) = 'GET' AND contains(path, '/documents/1')
       AND CAST(ts AS DATE) = DATE '2024-01-02' ORDER BY ts DESC, seq DESC LIMIT 1000""",
)
def _(t):
    return audit.query_audit(t["v_audit"], method="get", path="/documents/1", date="2024-01-02", limit=5000).select("seq", "user_id", "path")


@query("fil6_mine", "SELECT id FROM {v_document} WHERE uploader_id = '25'")
def _(t):
    return views.mine(t["v_document"], "25").select("id")


@query(
    "fil8_scored_pages",
    """SELECT type, count(*) AS pages FROM (SELECT d.type, CAST(l.l_linenumber - 1 AS INT) AS page FROM {lineitem} l JOIN {v_document} d
       ON d.orderkey = l.l_orderkey) p WHERE NOT (type = 'PAY_SLIP' AND page < 2) GROUP BY 1""",
)
def _(t):
    lines = t["lineitem"].select(F.col("l_orderkey").alias("orderkey"), (F.col("l_linenumber") - 1).alias("page"))
    return views.skip_pages(lines.join(t["v_document"].select("orderkey", "type"), "orderkey")).groupBy("type").agg(F.count("*").alias("pages"))


# --- joins ---------------------------------------------------------------------------
@query(
    "joi1_document_view",
    """SELECT d.id, d.name, d.type, d.format, d.byte_size, u.name AS uploader_name, p.name AS department_name
       FROM {v_document} d JOIN {v_user} u ON u.id = d.uploader_id LEFT JOIN {v_department} p ON p.id = d.department_id""",
)
def _(t):
    return _view(t).select("id", "name", "type", "format", "byte_size", "uploader_name", "department_name")


@query(
    "joi2_user_view",
    """SELECT u.id, u.email, u.role, p.name AS department_name, p.manager_id, m.name AS manager_name FROM {v_user} u
       LEFT JOIN {v_department} p ON p.id = u.department_id LEFT JOIN {v_user} m ON m.id = p.manager_id""",
)
def _(t):
    return views.user_view(t["v_user"], t["v_department"]).select("id", "email", "role", "department_name", "manager_id", "manager_name")


@query(
    "joi3_department_view",
    "SELECT p.id, p.name, p.manager_id, m.name AS manager_name FROM {v_department} p LEFT JOIN {v_user} m ON m.id = p.manager_id",
)
def _(t):
    return views.department_view(t["v_department"], t["v_user"]).select("id", "name", "manager_id", "manager_name")


@query(
    "joi4_notification_view",
    """SELECT n.id, n.content, d.name AS document_name, u.name AS receiver_name, n.has_read FROM {v_notification} n
       JOIN {v_document} d ON d.id = n.triggered_document_id JOIN {v_user} u ON u.id = n.receiver_id""",
)
def _(t):
    return views.notification_view(t["v_notification"], t["v_document"], t["v_user"]).select("id", "content", "document_name", "receiver_name", "has_read")


@query(
    "joi5_route_notifications",
    """SELECT d.id AS triggered_document_id, p.manager_id AS receiver_id, u.name || ' uploaded a new document: ' || d.name AS content
       FROM {v_document} d JOIN {v_user} u ON u.id = d.uploader_id JOIN {v_department} p ON p.id = u.department_id
       WHERE p.manager_id IS NOT NULL AND p.manager_id <> u.id""",
)
def _(t):
    return views.route_notifications(t["v_document"], t["v_user"], t["v_department"])


_TEMPLATE = {
    0: "Viewed {documentId}", 1: "Changed {userId} in {departmentId}", 2: "Listed documents", 3: "Moved {documentId} to {departmentId}",
}


@query(
    "joi6_resolve_actions",
    """SELECT a.seq, CASE a.event_id % 4
         WHEN 0 THEN 'Viewed ' || coalesce(d.name || ' [' || d.id || ']', a.doc, 'null')
         WHEN 1 THEN 'Changed ' || coalesce(u.name || ' [' || u.id || ']', a.usr, 'null') || ' in ' || coalesce(p.name || ' [' || p.id || ']', a.dep, 'null')
         WHEN 2 THEN 'Listed documents'
         ELSE 'Moved ' || coalesce(d.name || ' [' || d.id || ']', a.doc, 'null') || ' to ' || coalesce(p.name || ' [' || p.id || ']', a.dep, 'null') END AS action
       FROM (SELECT seq, event_id, CAST(event_id * 3 AS VARCHAR) AS doc, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 2000 AS VARCHAR) END AS usr,
                    CAST(event_id % 30 AS VARCHAR) AS dep FROM {v_audit}) a
       LEFT JOIN {v_document} d ON d.id = a.doc LEFT JOIN {v_user} u ON u.id = a.usr LEFT JOIN {v_department} p ON p.id = a.dep""",
)
def _(t):
    e = F.col("event_id")
    template = F.element_at(F.array(*[F.lit(_TEMPLATE[i]) for i in range(4)]), (e % 4 + 1).cast("int"))
    entries = t["v_audit"].select(
        "seq", template.alias("template"), (e * 3).cast("string").alias("document_id"),
        F.when(e % 5 != 0, (e % 2000).cast("string")).alias("target_user_id"), (e % 30).cast("string").alias("department_id"),
    )
    return views.resolve_actions(entries, t["v_document"], t["v_user"], t["v_department"]).select("seq", "action")


@query(
    "joi14_org_violations",
    """SELECT 'manager_without_manager_role' AS rule, p.id AS subject_id, p.manager_id AS related_id FROM {v_department} p JOIN {v_user} u ON u.id = p.manager_id WHERE u.role NOT IN ('MANAGER', 'ADMIN')
       UNION ALL SELECT 'admin_as_manager', p.id, p.manager_id FROM {v_department} p JOIN {v_user} u ON u.id = p.manager_id WHERE u.role = 'ADMIN'
       UNION ALL SELECT 'manager_in_other_department', p.id, p.manager_id FROM {v_department} p JOIN {v_user} u ON u.id = p.manager_id WHERE u.department_id <> p.id
       UNION ALL SELECT 'deleted_manager_referenced', p.id, p.manager_id FROM {v_department} p JOIN {v_user} u ON u.id = p.manager_id WHERE u.is_deleted
       UNION ALL SELECT 'user_in_missing_department', u.id, u.department_id FROM {v_user} u WHERE u.department_id IS NOT NULL AND u.department_id NOT IN (SELECT id FROM {v_department} WHERE id <> '3')
       UNION ALL SELECT 'manager_without_department', u.id, u.department_id FROM {v_user} u WHERE u.role = 'MANAGER' AND NOT EXISTS (SELECT 1 FROM {v_department} p WHERE p.id <> '3' AND p.id = u.department_id AND p.manager_id = u.id)
       UNION ALL SELECT 'duplicate_email', email, CAST(count(*) AS VARCHAR) FROM {v_user} GROUP BY email HAVING count(*) > 1""".replace(
        "FROM {v_department} p JOIN", "FROM (SELECT * FROM {v_department} WHERE id <> '3') p JOIN"
    ),
)
def _(t):
    return integrity.org_violations(t["v_user"], t["v_department"].filter(F.col("id") != "3"))


@query(
    "agg11_email_taken",
    "SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) || '@example.com' AS email FROM {events} WHERE 'u' || CAST(user_id AS VARCHAR) || '@example.com' IN (SELECT email FROM {v_user})",
)
def _(t):
    asked = t["events"].select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email")).distinct()
    return integrity.email_taken(asked, t["v_user"])


# --- access --------------------------------------------------------------------------
_REQUESTS = """(SELECT CAST(e.event_id AS VARCHAR) AS doc_id, CAST(e.user_id AS VARCHAR) AS user_id FROM {events} e)"""


def _requests(t):
    return t["events"].select(F.col("event_id").cast("string").alias("doc_id"), F.col("user_id").cast("string").alias("user_id"))


@query(
    "acl1_can_delete",
    f"""SELECT r.doc_id, r.user_id, CASE u.role WHEN 'STAFF' THEN d.uploader_id = u.id
         WHEN 'MANAGER' THEN coalesce(d.department_id = u.department_id, false) ELSE true END AS allowed
       FROM {_REQUESTS} r JOIN {{v_document}} d ON d.id = r.doc_id JOIN {{v_user}} u ON u.id = r.user_id""",
)
def _(t):
    return views.can_delete_requests(_requests(t), t["v_document"], t["v_user"])


@query(
    "acl1_delete_scope",
    """SELECT role, count(*) AS n FROM (
         SELECT 'STAFF' AS role FROM {v_document} d JOIN {v_user} u ON u.id = d.uploader_id WHERE u.role = 'STAFF'
         UNION ALL SELECT 'MANAGER' FROM {v_document} d JOIN {v_user} u ON u.department_id = d.department_id WHERE u.role = 'MANAGER'
         UNION ALL SELECT 'ADMIN' FROM {v_user} WHERE role = 'ADMIN') s GROUP BY 1""",
)
def _(t):
    pairs = views.can_delete(t["v_document"], t["v_user"])
    return pairs.join(t["v_user"].select(F.col("id").alias("user_id"), "role"), "user_id").groupBy("role").agg(F.count("*").alias("n"))


@query(
    "acl2_can_preview",
    f"""SELECT r.doc_id, r.user_id, d.uploader_id = u.id OR coalesce(d.department_id = u.department_id, false) AS allowed
       FROM {_REQUESTS} r JOIN {{v_document}} d ON d.id = r.doc_id JOIN {{v_user}} u ON u.id = r.user_id""",
)
def _(t):
    return views.can_preview_requests(_requests(t), t["v_document"], t["v_user"])


def _result_json(t):
    """Stored results of changing shape, built from the orders."""
    k = F.col("orderkey")
    checks = F.concat(F.lit('{"dti":{"pass":true,"value":0.'), (k % 10).cast("string"), F.lit(',"threshold":0.4}}'))
    checks = F.when(k % 12 == 0, F.lit('{"dti":5}')).when(k % 12 == 1, F.lit("7")).otherwise(checks)
    keys = F.when(k % 6 == 0, F.lit('"name"')).otherwise(F.lit('["name","income"]'))
    fields = F.when(k % 14 == 0, F.lit("null")).otherwise(
        F.concat(F.lit('{"name":"'), F.coalesce("name", F.lit("x")), F.lit('","income":'), k.cast("string"), F.lit(',"dates":["a"]}'))
    )
    whole = F.concat(
        F.lit('{"fields":'), fields, F.lit(',"sensitive_field_keys":'), keys,
        F.lit(',"redaction":{"items":[1]},"loan_readiness":{"verdict":"READY","checks":'), checks, F.lit("}}"),
    )
    return F.when(k % 9 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(k % 9 == 1, F.lit("[1]")).otherwise(whole)


_STRIPPED = """
  SELECT id, orderkey % 9 IN (0, 1) AS hidden,
         orderkey % 9 NOT IN (0, 1) AND orderkey % 6 <> 0 AND orderkey % 14 <> 0 AS has_fields,
         CASE WHEN orderkey % 9 NOT IN (0, 1) AND orderkey % 12 NOT IN (0, 1) THEN 'READY' END AS verdict
  FROM {v_document}"""


@query("acl3_strip_sensitive", f"SELECT id, hidden, has_fields, CASE WHEN has_fields THEN '[\"a\"]' END AS dates, false AS leaks FROM ({_STRIPPED}) s")
def _(t):
    shown = t.spread("v_document").select("id", access.strip_sensitive(_result_json(t)).alias("s"))
    leaks = F.coalesce(F.get_json_object("s", "$.fields.name").isNotNull() | F.get_json_object("s", "$.fields.income").isNotNull() | F.get_json_object("s", "$.redaction").isNotNull(), F.lit(False))
    return shown.select(
        "id", F.col("s").isNull().alias("hidden"),
        F.coalesce(F.get_json_object("s", "$.fields").startswith("{"), F.lit(False)).alias("has_fields"),
        F.get_json_object("s", "$.fields.dates").alias("dates"), leaks.alias("leaks"),
    )


@query(
    "acl1_delete_scopes",
    """SELECT id AS user_id, CASE role WHEN 'STAFF' THEN 'uploader' WHEN 'MANAGER' THEN 'department' ELSE 'all' END AS scope,
         CASE role WHEN 'STAFF' THEN id WHEN 'MANAGER' THEN department_id END AS key FROM {v_user} WHERE role = 'ADMIN' OR role = 'STAFF' OR department_id IS NOT NULL""",
)
def _(t):
    return views.delete_scopes(t["v_user"])


# --- the documents list ------------------------------------------------------------
_REQUESTERS = {
    "STAFF": "SELECT min(CAST(uploader_id AS BIGINT)) FROM {v_document} d JOIN {v_user} u ON u.id = d.uploader_id WHERE u.role = 'STAFF' AND NOT d.is_deleted",
    "MANAGER": "SELECT min(CAST(id AS BIGINT)) FROM {v_user} WHERE role = 'MANAGER' AND department_id IS NOT NULL",
    "ADMIN": "SELECT CAST(0 AS BIGINT)",
}


def _list_query(name: str, role: str, scope: str, term: str, sort: str, page: int | None, mine_only: bool = False):
    who = f"(SELECT CAST(({_REQUESTERS[role]}) AS VARCHAR))"
    keep = {"mine": f"d.uploader_id = {who}", "department": f"d.department_id = (SELECT department_id FROM {{v_user}} WHERE id = {who})", "all": "true"}[scope]
    if mine_only:
        keep += f" AND d.uploader_id = {who}"
    cut = f"ORDER BY {_SORTED[sort]} LIMIT 7 OFFSET {(page - 1) * 7}" if page else ""
    owner = f"d.uploader_id = {who}"
    readable = "(d.scan_status IS NULL OR d.scan_status = 'CLEAN')"

    @query(
        name,
        f"""SELECT d.id, d.name, u.name AS uploader_name, p.name AS department_name, {readable} AS accessible, {owner} AS requester_is_owner,
              CASE WHEN {readable} AND {owner} AND d.orderkey % 5000 < 4000 THEN 'https://files.example/' || d.document_link END AS signed_url,
              {owner} AS whole_result,
              CASE WHEN NOT ({owner}) AND d.orderkey % 9 NOT IN (0, 1) AND d.orderkey % 12 NOT IN (0, 1) THEN 'READY' END AS verdict
            FROM {{v_document}} d JOIN {{v_user}} u ON u.id = d.uploader_id LEFT JOIN {{v_department}} p ON p.id = d.department_id
            WHERE NOT d.is_deleted AND {keep} AND (contains(lower(d.name), '{term}') OR contains(lower(d.type), '{term}') OR contains(lower(u.name), '{term}')) {cut}""",
    )
    def _(t):
        requester = str(t.sql(_REQUESTERS[role]).first()[0])
        docs = t["v_document"].withColumn("ai_result", _result_json(t))
        links = t["v_document"].filter(F.col("orderkey") % 5000 < 4000).select("document_link", F.concat(F.lit("https://files.example/"), "document_link").alias("signed_url"))
        rows = document_list.document_list(docs, t["v_user"], t["v_department"], links, requester, scope, mine_only, term, sort, page)
        verdict = F.when(~F.col("requester_is_owner"), F.get_json_object("shown", "$.loan_readiness.verdict"))
        return rows.select(
            "id", "name", "uploader_name", "department_name", "accessible", "requester_is_owner", "signed_url",
            F.col("shown").eqNullSafe(F.col("ai_result")).alias("whole_result"), verdict.alias("verdict"),
        )


_SORTED = {"date-desc": "d.uploaded_at DESC, d.id", "date-asc": "d.uploaded_at, d.id", "id-desc": "d.id DESC"}
_list_query("list_mine", "STAFF", "mine", "", "date-desc", 1)
_list_query("list_mine_all_pages", "MANAGER", "mine", "doc_", "date-desc", None)
_list_query("list_department", "MANAGER", "department", "", "date-asc", None)
_list_query("list_department_page", "MANAGER", "department", "slip", "id-desc", 2)
_list_query("list_department_own_tab", "MANAGER", "department", "", "date-desc", 1, True)
_list_query("list_all", "ADMIN", "all", "", "date-desc", None)
_list_query("list_all_page", "ADMIN", "all", "contract", "date-desc", 3)


@query("acl4_scrub_readiness", f"SELECT id, verdict, CASE WHEN verdict IS NOT NULL THEN '0.4' END AS threshold, false AS leaks FROM ({_STRIPPED}) s")
def _(t):
    shown = t.spread("v_document").select("id", access.strip_sensitive(_result_json(t)).alias("s"))
    value = F.get_json_object("s", "$.loan_readiness.checks.dti.value")
    return shown.select(
        "id", F.get_json_object("s", "$.loan_readiness.verdict").alias("verdict"),
        F.get_json_object("s", "$.loan_readiness.checks.dti.threshold").alias("threshold"),
        F.coalesce(value.isNotNull() & (value != "null"), F.lit(False)).alias("leaks"),
    )


@query(
    "acl5_attach_links",
    """SELECT d.id, d.scan_status IS NULL OR d.scan_status = 'CLEAN' AS accessible, d.uploader_id = r.requester_id AS requester_is_owner,
         CASE WHEN (d.scan_status IS NULL OR d.scan_status = 'CLEAN') AND d.uploader_id = r.requester_id AND d.orderkey % 5000 < 4000
              THEN 'https://files.example/' || d.document_link END AS signed_url
       FROM {v_document} d JOIN (SELECT orderkey, CAST(CASE WHEN orderkey % 3 = 0 THEN custkey ELSE custkey + 1 END AS VARCHAR) AS requester_id FROM {v_document}) r ON r.orderkey = d.orderkey""",
)
def _(t):
    k, c = F.col("orderkey"), F.col("custkey")
    docs = t["v_document"].withColumn("requester_id", F.when(k % 3 == 0, c).otherwise(c + 1).cast("string"))
    links = t["v_document"].filter(k % 5000 < 4000).select("document_link", F.concat(F.lit("https://files.example/"), "document_link").alias("signed_url"))
    return views.attach_links(docs, links).select("id", "accessible", "requester_is_owner", "signed_url")


_PREVIEW = """
  SELECT id, CASE
    WHEN NOT (format IN ('PNG', 'JPG', 'JPEG') OR (format = 'PDF' AND coalesce(processing_path, '') IN ('ocr', 'text_native')) OR (format = 'DOCX' AND coalesce(processing_path, '') = 'text_native')) THEN 'NOT_IMPLEMENTED'
    WHEN n_items = 0 THEN 'UNPROCESSABLE'
    WHEN coalesce(redacted_preview_status, 'NOT_STARTED') = 'NOT_STARTED' OR (redacted_preview_status = 'FAILED' AND %s) THEN 'GENERATING'
    ELSE redacted_preview_status END AS preview_outcome FROM {v_document}"""


@query("acl6_preview_state", _PREVIEW % "false")
def _(t):
    return views.preview_state(t["v_document"]).select("id", "preview_outcome")


@query("acl6_preview_state_retry", _PREVIEW % "true")
def _(t):
    return views.preview_state(t["v_document"], retry=True).select("id", "preview_outcome")


# --- sorting and paging --------------------------------------------------------------
# names of mixed case and with accents. A reader's order compares letters first, then accents,
# then case (lower first): in SQL, three keys
_NAMES = ["apple", "Apple", "äpple", "Äpple", "banana", "Banana", "résumé", "resume", "Zebra", "zebra", "éclair"]
_MIXED_SQL = "CASE WHEN {k} % 89 = 0 THEN NULL ELSE ([" + ", ".join(f"'{n}'" for n in _NAMES) + "])[{k} % 11 + 1] || '_' || CAST({k} % 300 AS VARCHAR) || '.pdf' END"
_LETTERS = "lower(strip_accents(coalesce({n}, '')))", "coalesce({n}, '') <> strip_accents(coalesce({n}, ''))", "coalesce({n}, '') <> lower(coalesce({n}, ''))"


def _mixed(key):
    word = F.get(F.array(*[F.lit(n) for n in _NAMES]), (key % len(_NAMES)).cast("int"))
    return F.when(key % 89 != 0, F.concat(word, F.lit("_"), (key % 300).cast("string"), F.lit(".pdf")))


def _order_sql(keys: tuple[str, ...], way: str, tie: str) -> str:
    return ", ".join([f"{k} {way}" for k in keys] + [tie])


def _name_keys(name: str) -> tuple[str, ...]:
    return tuple(k.format(n=name) for k in _LETTERS)


_DOCUMENT_KEYS = {"date": ("uploaded_at",), "id": ("id",), "name": _name_keys("name")}
_AUDIT_KEYS = {"date": ("ts",), "id": ("CAST(user_id AS BIGINT)",), "name": _name_keys("name")}
_ADMIN_KEYS = {"date": ("created_at",), "id": ("CAST(id AS BIGINT)",), "name": _name_keys("name")}


def _position_query(name: str, table: str, shown: str, key: str, sort: str, keys: dict, tie: str, order):
    """Whole-table positions of one order; names are replaced by mixed ones."""
    field, way = sort.split("-")
    mixed = _MIXED_SQL.replace("{k}", key)

    @query(
        f"{name}_{field}_{way}",
        f"SELECT {shown}, row_number() OVER (ORDER BY {_order_sql(keys[field], way.upper(), tie)}) - 1 AS position "
        f"FROM (SELECT * REPLACE ({mixed} AS name) FROM {{{table}}}) s",
    )
    def _(t):
        named = t[table].withColumn("name", _mixed(F.expr(key.replace("AS BIGINT", "AS LONG"))))
        return listing.numbered(named, order(sort)).select(shown, "position")


for _field in ("date", "id", "name"):
    for _way in ("desc", "asc"):
        _s = f"{_field}-{_way}"
        _position_query("sor1_documents", "v_document", "id", "orderkey", _s, _DOCUMENT_KEYS, "id", listing.document_order)
        _position_query("sor2_audit", "v_audit", "seq", "event_id", _s, _AUDIT_KEYS, "seq", listing.audit_order)
        _position_query("sor3_users", "v_user", "id", "CAST(id AS BIGINT)", _s, _ADMIN_KEYS, "id", listing.admin_order)
        _position_query("sor3_departments", "v_department", "id", "CAST(id AS BIGINT)", _s, _ADMIN_KEYS, "id", listing.admin_order)


@query(
    "sor2_audit_by_user",
    "SELECT seq, row_number() OVER (ORDER BY CAST(user_id AS BIGINT), seq) - 1 AS position FROM {v_audit}",
)
def _(t):
    return listing.numbered(t["v_audit"], listing.audit_order("id-asc")).select("seq", "position")


@query("sor2_audit_by_date", "SELECT seq, row_number() OVER (ORDER BY ts DESC, seq) - 1 AS position FROM {v_audit}")
def _(t):
    return listing.numbered(t["v_audit"], listing.audit_order("date-desc")).select("seq", "position")


@query("sor3_users_by_date", "SELECT id, row_number() OVER (ORDER BY created_at DESC, id) - 1 AS position FROM {v_user}")
def _(t):
    return listing.numbered(t["v_user"], listing.admin_order("date-desc")).select("id", "position")


@query("sor4_feed", "SELECT id, content, created_at FROM {v_notification} WHERE receiver_id = '1'")
def _(t):
    return listing.feed(t["v_notification"], "1").select("id", "content", "created_at")


@query("sor5_clamped_limit", "SELECT seq FROM {v_audit} ORDER BY ts DESC, seq DESC LIMIT 1000")
def _(t):
    return audit.query_audit(t["v_audit"], limit=50000).select("seq")


@query("win10_newest_entries", "SELECT seq, ts, action FROM {v_audit} ORDER BY ts DESC, seq DESC LIMIT 1000")
def _(t):
    return listing.newest_n(t["v_audit"]).select("seq", "ts", "action")


@query("win11_page_three", "SELECT id, name FROM {v_document} WHERE NOT is_deleted ORDER BY uploaded_at DESC, id LIMIT 7 OFFSET 14")
def _(t):
    return listing.paginate(views.live(t["v_document"]), listing.document_order(), page=3).select("id", "name")


@query(
    "win11_deep_page",
    f"SELECT id, name FROM (SELECT * REPLACE ({_MIXED_SQL.replace('{k}', 'orderkey')} AS name) FROM {{v_document}}) s "
    f"WHERE NOT is_deleted ORDER BY {_order_sql(_name_keys('name'), 'ASC', 'id')} LIMIT 7 OFFSET 560",
)
def _(t):
    docs = views.live(t["v_document"]).withColumn("name", _mixed(F.col("orderkey")))
    return listing.paginate(docs, listing.document_order("name-asc"), page=81, deep=True).select("id", "name")


@query(
    "win11_sorted_page",
    f"SELECT id, name FROM (SELECT * REPLACE ({_MIXED_SQL.replace('{k}', 'orderkey')} AS name) FROM {{v_document}}) s "
    f"WHERE NOT is_deleted ORDER BY {_order_sql(_name_keys('name'), 'DESC', 'id')} LIMIT 7 OFFSET 7",
)
def _(t):
    docs = views.live(t["v_document"]).withColumn("name", _mixed(F.col("orderkey")))
    return listing.paginate(docs, listing.document_order("name-desc"), page=2).select("id", "name")


@query(
    "win11_page_summary",
    "SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 7.0) AS BIGINT), 1) AS pages FROM {v_document} WHERE NOT is_deleted",
)
def _(t):
    return listing.page_summary(views.live(t["v_document"]))


@query(
    "win12_page_of",
    "SELECT CAST(floor(p / 7) + 1 AS BIGINT) AS page FROM (SELECT id, row_number() OVER (ORDER BY uploaded_at DESC, id) - 1 AS p FROM {v_document}) s WHERE id = '100'",
)
def _(t):
    return listing.page_of(t["v_document"], "100")


@query("agg8_unread_counts", "SELECT receiver_id, count(*) FILTER (WHERE NOT has_read) AS unread FROM {v_notification} GROUP BY 1")
def _(t):
    return listing.unread_counts(t["v_notification"])


@query("agg9_audit_stats", "SELECT least(count(*), 1000) AS held, 1000 AS capacity FROM {v_audit}")
def _(t):
    return audit.audit_stats(t["v_audit"])


# --- display -------------------------------------------------------------------------
_TENTH = "CAST(CAST(floor(({x}) * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(({x}) * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR)"


@query(
    "fmt1_human_size",
    "SELECT id, CASE WHEN b IS NULL THEN 'Unknown' WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN "
    + _TENTH.format(x="b / 1024.0") + " || ' KB' ELSE " + _TENTH.format(x="b / 1048576.0")
    + " || ' MB' END AS size FROM (SELECT id, CASE WHEN orderkey % 17 = 0 THEN NULL WHEN orderkey % 2 = 0 THEN byte_size ELSE orderkey END AS b FROM {v_document}) s",
)
def _(t):
    k = F.col("orderkey")
    size = F.when(k % 17 == 0, F.lit(None)).when(k % 2 == 0, F.col("byte_size")).otherwise(k)
    return t["v_document"].select("id", D.human_size(size.cast("long")).alias("size"))


@query("fmt2_display_date", "SELECT id, coalesce(strftime(scanned_at, '%d/%m/%Y %H:%M:%S'), 'Never') AS shown FROM {v_document}")
def _(t):
    raw = F.concat(F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))
    return t["v_document"].select("id", D.display_date(raw).alias("shown"))


@query(
    "fmt3_scan_info",
    """SELECT id, CASE scan_status WHEN 'CLEAN' THEN '0 MALWARE DETECTED' WHEN 'INFECTED' THEN 'MALWARE DETECTED' ELSE 'NOT SCANNED' END AS title,
         CASE scan_status WHEN 'CLEAN' THEN coalesce(scan_message, 'No malware detected.') WHEN 'INFECTED' THEN coalesce(scan_message, 'Malware detected.')
              ELSE 'Malware scanning has been skipped for this document.' END AS description,
         CASE WHEN scan_status IN ('CLEAN', 'INFECTED') AND scanned_at IS NOT NULL THEN strftime(scanned_at, '%d/%m/%Y %H:%M:%S') ELSE '-' END AS shown
       FROM {v_document}""",
)
def _(t):
    info = D.scan_info(F.col("scan_status"), F.col("scan_message"), F.col("scanned_at"))
    return t["v_document"].select("id", info.alias("i")).select("id", F.col("i.title").alias("title"), F.col("i.description").alias("description"), F.col("i.date").alias("shown"))


@query(
    "fmt4_audit_display",
    """SELECT seq, CASE WHEN length(u) <= 10 THEN u ELSE substr(u, 1, 10) || '...' END AS user_id, replace(role, 'ROLE_', '') AS role, action,
         CASE WHEN client_ip = '0:0:0:0:0:0:0:1' THEN '127.0.0.1' ELSE client_ip END AS ip
       FROM (SELECT *, coalesce(email, 'N/A') AS u FROM {v_audit}) s""",
)
def _(t):
    shown = D.audit_display(F.col("email"), F.col("role"), F.col("action"), F.col("client_ip"))
    return t["v_audit"].select("seq", shown.alias("d")).select("seq", "d.*")


@query(
    "fmt5_ratio_display",
    "SELECT id, CASE WHEN orderkey % 10 = 0 THEN 'N/A' ELSE " + _TENTH.format(x="r * 100")
    + " || '%' END AS percent FROM (SELECT id, orderkey, (orderkey % 1000) / 1000.0 AS r FROM {v_document}) s",
)
def _(t):
    k = F.col("orderkey")
    return t["v_document"].select("id", D.percent_display(F.when(k % 10 != 0, (k % 1000) / 1000.0)).alias("percent"))


@query(
    "fmt6_client_ip",
    """SELECT seq, CASE WHEN event_id % 3 = 0 THEN client_ip WHEN event_id % 3 = 1 THEN '1.2.3.' || CAST(event_id % 200 AS VARCHAR) ELSE client_ip END AS ip FROM {v_audit}""",
)
def _(t):
    e = F.col("event_id")
    forwarded = F.when(e % 3 == 1, F.concat(F.lit(" 1.2.3."), (e % 200).cast("string"), F.lit(" , 9.9.9.9"))).when(e % 3 == 2, F.lit("  "))
    return t["v_audit"].select("seq", D.client_ip(forwarded, F.col("client_ip")).alias("ip"))


@query(
    "fmt7_http_status",
    """SELECT seq, CASE event_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 400 WHEN 2 THEN 409 WHEN 3 THEN 400 WHEN 4 THEN 403 ELSE 500 END AS code FROM {v_audit}""",
)
def _(t):
    names = [*V.EXCEPTION_STATUS, "AppException", "IllegalStateException"]
    exc = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 6 + 1).cast("int"))
    return t["v_audit"].select("seq", D.http_status(exc, F.lit(403)).alias("code"))


@query(
    "fmt8_progress",
    """SELECT seq, least(95.0, CAST(event_id % 300 AS DOUBLE) / 200.0 * 100) AS progress FROM {v_audit}""",
)
def _(t):
    up = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    now = up + F.make_dt_interval(secs=F.col("event_id") % 300)
    return t["v_audit"].select("seq", D.progress(up, now).alias("progress"))


@query(
    "fmt9_identity_defaults",
    """SELECT seq, CASE WHEN email IS NULL THEN 'anonymous' ELSE user_id END AS user_id, coalesce(email, 'anonymous') AS email,
         CASE WHEN email IS NULL THEN 'NONE' ELSE role END AS role, CASE WHEN event_id % 23 = 0 THEN 'N/A' ELSE method END AS method FROM {v_audit}""",
)
def _(t):
    method = F.when(F.col("event_id") % 23 != 0, F.col("method"))
    who = D.identity_defaults(F.col("user_id"), F.col("name"), F.col("email"), F.col("role"), method, F.col("path"))
    return t["v_audit"].select("seq", who.alias("w")).select("seq", "w.user_id", "w.email", "w.role", "w.method")


@query(
    "fmt10_display_value",
    """SELECT source, replace('field_' || source, '_', ' ') AS label, string_agg(lang, ', ' ORDER BY lang) AS shown
       FROM (SELECT DISTINCT source, lang FROM {documents}) s GROUP BY source""",
)
def _(t):
    langs = t["documents"].groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    return langs.select("source", D.field_label(F.concat(F.lit("field_"), "source")).alias("label"), D.display_list(F.col("langs")).alias("shown"))
