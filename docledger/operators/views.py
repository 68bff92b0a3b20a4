"""Rows and joins behind the screens: live rows, scoping, flattened responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.validation import accessible
from .broadcasting import maybe_broadcast


# --- filters -------------------------------------------------------------------------
def live(df: DataFrame) -> DataFrame:
    """Rows not soft-deleted (FIL1)."""
    return df.filter(~F.col("is_deleted"))


def by_uploader(df: DataFrame, user_id: str) -> DataFrame:
    return df.filter(F.col("uploader_id") == user_id)


def by_department(df: DataFrame, department_id: str) -> DataFrame:
    return df.filter(F.col("department_id") == department_id)


def by_id(df: DataFrame, row_id: str) -> DataFrame:
    return df.filter(F.col("id") == row_id)


def mine(df: DataFrame, user_id: str) -> DataFrame:
    """The "my uploads" tab of a manager (FIL6)."""
    return by_uploader(df, user_id)


def _holds(c: Column, term: str) -> Column:
    # a literal substring, neither a pattern nor LIKE; a missing value never matches
    return F.coalesce(F.lower(c).contains(F.lower(F.lit(term))), F.lit(False))


def search_documents(df: DataFrame, term: str) -> DataFrame:
    """Name, type or uploader name holds the term, ignoring case (FIL2)."""
    return df.filter(
        _holds(F.col("name"), term) | _holds(F.col("type"), term) | _holds(F.col("uploader_name"), term)
    )


def search_audit(df: DataFrame, term: str) -> DataFrame:
    """Free-text search of audit entries; a blank term keeps all (FIL3)."""
    if not term.strip():
        return df
    texts = [_holds(F.col(c), term) for c in ("email", "action", "role", "path", "client_ip")]
    code = F.coalesce(F.col("status").cast("string"), F.lit("undefined")).contains(term.lower())
    return df.filter(reduce(lambda a, b: a | b, [*texts, code]))


def search_any(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Any column's text holds the term; a missing value counts as '' (FIL4)."""
    if term == "":
        return df
    cols = columns or df.columns
    hits = [
        F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(F.lower(F.lit(term))) for c in cols
    ]
    return df.filter(reduce(lambda a, b: a | b, hits))


def visible_fields(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, key, value``: the fields shown for a document's type, without missing
    and empty ones (FIL7). ``docs``: doc_id, type, fields (struct)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema["fields"].dataType.fields}

    def shown(key: str) -> Column:
        c = F.col(f"fields.{key}")
        if kinds[key].startswith("array"):
            return F.when(F.size(c) > 0, F.array_join(c, ", "))
        return c.cast("string")

    chain = None
    for kind, keys in V.VISIBLE_KEYS.items():
        entries = F.array(
            *[
                F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), shown(k).alias("value"))
                for i, k in enumerate(keys)
                if k in kinds
            ]
        )
        chain = F.when(F.col("type") == kind, entries) if chain is None else chain.when(F.col("type") == kind, entries)
    present = F.filter(chain, lambda e: e["value"].isNotNull())
    return docs.select("doc_id", F.explode_outer(present).alias("e")).filter(F.col("e").isNotNull()).select("doc_id", "e.*")


def skip_pages(pages: DataFrame) -> DataFrame:
    """Pages to score: a payslip's first two pages are printed instructions (FIL8)."""
    return pages.filter(~((F.col("type") == "PAY_SLIP") & (F.col("page") < 2)))


# --- flattened responses -------------------------------------------------------------
def document_view(docs: DataFrame, users: DataFrame, departments: DataFrame) -> DataFrame:
    """Documents with uploader and department names (JOI1). The department may be missing."""
    u = users.select(F.col("id").alias("uploader_id"), F.col("name").alias("uploader_name"))
    d = departments.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    return docs.join(maybe_broadcast(u), "uploader_id").join(maybe_broadcast(d), "department_id", "left")


def user_view(users: DataFrame, departments: DataFrame) -> DataFrame:
    """Users with their department and its manager (JOI2)."""
    return users.join(
        department_view(departments, users).select(
            F.col("id").alias("department_id"), F.col("name").alias("department_name"), "manager_id", "manager_name"
        ),
        "department_id",
        "left",
    )


def department_view(departments: DataFrame, users: DataFrame) -> DataFrame:
    """Departments with the manager's name (JOI3)."""
    m = users.select(F.col("id").alias("manager_id"), F.col("name").alias("manager_name"))
    return departments.join(m, "manager_id", "left")


def notification_view(notifications: DataFrame, docs: DataFrame, users: DataFrame) -> DataFrame:
    """Notifications with document and receiver names (JOI4)."""
    d = docs.select(F.col("id").alias("triggered_document_id"), F.col("name").alias("document_name"))
    u = users.select(F.col("id").alias("receiver_id"), F.col("name").alias("receiver_name"))
    return notifications.join(d, "triggered_document_id").join(maybe_broadcast(u), "receiver_id")


def route_notifications(docs: DataFrame, users: DataFrame, departments: DataFrame) -> DataFrame:
    """One notification per upload to the uploader's department manager, unless there is
    none or the manager is the uploader (JOI5)."""
    managers = departments.filter(F.col("manager_id").isNotNull()).select(
        F.col("id").alias("uploader_department_id"), F.col("manager_id").alias("receiver_id")
    )
    senders = (
        users.select(
            F.col("id").alias("uploader_id"),
            F.col("name").alias("uploader_name"),
            F.col("department_id").alias("uploader_department_id"),
        )
        .join(maybe_broadcast(managers), "uploader_department_id")
        .filter(F.col("receiver_id") != F.col("uploader_id"))
    )
    return docs.join(maybe_broadcast(senders), "uploader_id").select(
        F.col("id").alias("triggered_document_id"),
        "receiver_id",
        F.concat("uploader_name", F.lit(" uploaded a new document: "), "name").alias("content"),
    )


def join_known(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Left join on a key that many rows may not have: rows without it match nothing, so
    they are dealt out evenly instead of meeting in the task of the NULL key."""
    deal = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024)) + 1).otherwise(F.lit(0).cast("long"))
    # always 0, but not a literal: the optimizer would put a literal into the join's condition and
    # let the rows meet on the key alone, all those without one in one task
    right = names.withColumn("__deal", F.pmod(F.xxhash64(key), F.lit(1).cast("long")))
    return df.withColumn("__deal", deal).join(right, [key, "__deal"], "left").drop("__deal")


def resolve_actions(audit: DataFrame, docs: DataFrame, users: DataFrame, departments: DataFrame) -> DataFrame:
    """Add ``action``: the template with ids replaced by ``name [id]``; an unknown id stays
    raw, a missing one reads ``null`` (JOI6).

    ``audit``: template, document_id, target_user_id, department_id.
    """

    def names(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col("id").alias(key), F.col("name").alias(f"__{key}"))

    out = (
        join_known(audit, names(docs, "document_id"), "document_id")
        .join(maybe_broadcast(names(users, "target_user_id")), "target_user_id", "left")
        .join(maybe_broadcast(names(departments, "department_id")), "department_id", "left")
    )

    def shown(key: str) -> Column:
        named = F.concat(F.col(f"__{key}"), F.lit(" ["), F.col(key), F.lit("]"))
        return F.coalesce(named, F.col(key), F.lit("null"))

    action = F.col("template")
    for mark, key in (("{documentId}", "document_id"), ("{userId}", "target_user_id"), ("{departmentId}", "department_id")):
        action = F.replace(action, F.lit(mark), shown(key))
    return out.withColumn("action", action).drop("__document_id", "__target_user_id", "__department_id")


# --- who may do what -----------------------------------------------------------------
def delete_scopes(users: DataFrame) -> DataFrame:
    """``user_id, scope, key``: what each user may delete, one row for each user (ACL1): the
    documents of an ``uploader``, of a ``department`` (none without one), or ``all``."""
    role = F.col("role")
    scope = F.when(role == "STAFF", "uploader").when(role == "MANAGER", "department").when(role == "ADMIN", "all")
    key = F.when(role == "STAFF", F.col("id")).when(role == "MANAGER", F.col("department_id"))
    scopes = users.select(F.col("id").alias("user_id"), scope.alias("scope"), key.alias("key"))
    return scopes.filter((F.col("scope") == "all") | F.col("key").isNotNull())


def can_delete(docs: DataFrame, users: DataFrame) -> DataFrame:
    """``doc_id, user_id`` pairs allowed by role: own uploads, own department, everything
    (ACL1). A missing department equals nothing.

    Staff and managers are two equi joins. An administrator may delete everything, which is
    one row per administrator with a NULL ``doc_id`` instead of all pairs.
    """
    d = docs.select(F.col("id").alias("doc_id"), "uploader_id", "department_id")
    staff = users.filter(F.col("role") == "STAFF").select(F.col("id").alias("user_id"))
    managers = users.filter(F.col("role") == "MANAGER").select(F.col("id").alias("user_id"), "department_id")
    own = d.join(maybe_broadcast(staff), d["uploader_id"] == staff["user_id"]).select("doc_id", "user_id")
    team = d.join(maybe_broadcast(managers), "department_id").select("doc_id", "user_id")
    everything = users.filter(F.col("role") == "ADMIN").select(
        F.lit(None).cast("string").alias("doc_id"), F.col("id").alias("user_id")
    )
    return own.unionByName(team).unionByName(everything)


def can_delete_requests(requests: DataFrame, docs: DataFrame, users: DataFrame) -> DataFrame:
    """``allowed`` for each (doc_id, user_id) request (ACL1)."""
    d = docs.select(F.col("id").alias("doc_id"), "uploader_id", F.col("department_id").alias("doc_department"))
    u = users.select(F.col("id").alias("user_id"), "role", F.col("department_id").alias("user_department"))
    allowed = (
        F.when(F.col("role") == "STAFF", F.col("uploader_id") == F.col("user_id"))
        .when(F.col("role") == "MANAGER", F.coalesce(F.col("doc_department") == F.col("user_department"), F.lit(False)))
        .when(F.col("role") == "ADMIN", True)
        .otherwise(False)
    )
    return requests.join(d, "doc_id").join(maybe_broadcast(u), "user_id").select("doc_id", "user_id", allowed.alias("allowed"))


def can_preview_requests(requests: DataFrame, docs: DataFrame, users: DataFrame) -> DataFrame:
    """``allowed`` for each (doc_id, user_id) request: the owner, or the same known
    department (ACL2)."""
    d = docs.select(F.col("id").alias("doc_id"), "uploader_id", F.col("department_id").alias("doc_department"))
    u = users.select(F.col("id").alias("user_id"), F.col("department_id").alias("user_department"))
    allowed = (F.col("uploader_id") == F.col("user_id")) | F.coalesce(
        F.col("doc_department") == F.col("user_department"), F.lit(False)
    )
    return requests.join(d, "doc_id").join(maybe_broadcast(u), "user_id").select("doc_id", "user_id", allowed.alias("allowed"))


def attach_links(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``accessible, requester_is_owner, signed_url`` (ACL5). ``docs`` carries
    ``requester_id``; ``links``: document_link, signed_url.

    Only documents the requester owns and may open are looked up.
    """
    open_to = accessible(F.col("scan_status"))
    owner = F.col("uploader_id") == F.col("requester_id")
    marked = docs.withColumns({"accessible": open_to, "requester_is_owner": owner})
    key = F.when(F.col("accessible") & F.col("requester_is_owner"), F.col("document_link"))
    urls = links.groupBy("document_link").agg(F.min("signed_url").alias("signed_url"))
    return join_known(marked.withColumn("__link", key), urls.withColumnRenamed("document_link", "__link"), "__link").drop("__link")


def preview_state(docs: DataFrame, retry: bool = False) -> DataFrame:
    """Add ``preview_outcome, next_status`` (ACL6). ``docs``: format, processing_path,
    n_items (size of the redaction list, NULL when absent), redacted_preview_status."""
    image = F.col("format").isin("PNG", "JPG", "JPEG")
    scanned = (F.col("format") == "PDF") & (F.col("processing_path") == "ocr")
    textual = F.col("format").isin("PDF", "DOCX") & (F.col("processing_path") == "text_native")
    renderable = image | F.coalesce(scanned, F.lit(False)) | F.coalesce(textual, F.lit(False))
    status = F.coalesce(F.col("redacted_preview_status"), F.lit("NOT_STARTED"))
    start = (status == "NOT_STARTED") | ((status == "FAILED") & F.lit(retry))
    outcome = (
        F.when(~renderable, "NOT_IMPLEMENTED")
        .when(F.coalesce(F.col("n_items"), F.lit(0)) == 0, "UNPROCESSABLE")
        .when(start, "GENERATING")
        .otherwise(status)
    )
    return docs.withColumn("preview_outcome", outcome).withColumn(
        "next_status",
        F.when(F.col("preview_outcome") == "GENERATING", "GENERATING").otherwise(F.col("redacted_preview_status")),
    )
