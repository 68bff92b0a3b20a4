"""The documents list: what one requester sees, as one plan.

live rows -> the requester's scope -> tab and search -> names joined -> sort and page -> for the
rows that are left: accessible or not, owner or not, link, stored or stripped result.

Sorting and paging come before links and results, so only a page's results are parsed and
only its links looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from . import listing, views
from .access import shown_result

SCOPES = ("mine", "department", "all")


def in_scope(docs: DataFrame, users: DataFrame, requester_id: str, scope: str) -> DataFrame:
    """Live documents of a scope: own uploads, those of the requester's department (none
    if there is no department), or all."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    rows = views.live(docs)
    if scope == "mine":
        return views.by_uploader(rows, requester_id)
    if scope == "department":
        own = users.filter(F.col("id") == requester_id).select("department_id").filter(F.col("department_id").isNotNull())
        return rows.join(own, "department_id", "left_semi")
    return rows


def document_list(
    docs: DataFrame, users: DataFrame, departments: DataFrame, links: DataFrame, requester_id: str, scope: str,
    mine_only: bool = False, term: str = "", sort: str = "date-desc", page: int | None = 1, size: int = V.PAGE_SIZE,
) -> DataFrame:
    """The rows of one page (``page`` None: of the whole list) with ``uploader_name``,
    ``department_name``, ``accessible``, ``requester_is_owner``, ``signed_url`` and ``shown`` (the result JSON).

    ``docs`` carries ``ai_result``; ``links``: document_link, signed_url."""
    rows = views.document_view(in_scope(docs, users, requester_id, scope), users, departments)
    if mine_only:
        rows = views.mine(rows, requester_id)
    rows = views.search_documents(rows, term)
    order = listing.document_order(sort)
    if page is not None:
        rows = listing.paginate(rows, order, page, size) if order else rows.offset((page - 1) * size).limit(size)
    seen = views.attach_links(rows.withColumn("requester_id", F.lit(requester_id)), links)
    seen = seen.withColumn("shown", shown_result(F.col("ai_result"), F.col("requester_is_owner"))).drop("requester_id")
    # links are joined by a shuffle or a broadcast: put the few rows back in order
    return seen.orderBy(*order) if order and page is not None else seen
