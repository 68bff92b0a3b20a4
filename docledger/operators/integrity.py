"""Organisation rules checked over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .broadcasting import maybe_broadcast


def email_taken(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requested e-mails already in use (AGG11)."""
    return requests.join(users.select("email"), "email", "left_semi")


def org_violations(users: DataFrame, departments: DataFrame) -> DataFrame:
    """``rule, subject_id, related_id`` for every broken rule (JOI14).

    Everything but duplicate e-mails follows from two joins, so users are read twice and
    departments twice, whatever the number of rules.
    """
    u = users.select("id", "role", "department_id", "is_deleted")
    d = departments.select(F.col("id").alias("dept_id"), "manager_id")

    def emit(df: DataFrame, rules: dict[str, Column], subject: str, related: str) -> DataFrame:
        hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
        return df.select(
            F.explode(hits).alias("rule"),
            F.col(subject).cast("string").alias("subject_id"),
            F.col(related).cast("string").alias("related_id"),
        )

    managed = d.join(u.withColumnRenamed("id", "manager_id"), "manager_id")
    by_department = emit(
        managed,
        {
            "manager_without_manager_role": ~F.col("role").isin("MANAGER", "ADMIN"),
            "admin_as_manager": F.col("role") == "ADMIN",
            "manager_in_other_department": F.col("department_id") != F.col("dept_id"),
            "deleted_manager_referenced": F.col("is_deleted"),
        },
        "dept_id",
        "manager_id",
    )
    own = maybe_broadcast(d.withColumnRenamed("dept_id", "department_id").withColumn("__known", F.lit(True)))
    placed = u.join(own, "department_id", "left")
    by_user = emit(
        placed,
        {
            "user_in_missing_department": F.col("department_id").isNotNull() & F.col("__known").isNull(),
            "manager_without_department": (F.col("role") == "MANAGER")
            & ~F.coalesce(F.col("manager_id") == F.col("id"), F.lit(False)),
        },
        "id",
        "department_id",
    )
    duplicates = (
        users.groupBy("email")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select(
            F.lit("duplicate_email").alias("rule"),
            F.col("email").alias("subject_id"),
            F.col("n").cast("string").alias("related_id"),
        )
    )
    return reduce(DataFrame.unionByName, [by_department, by_user, duplicates])
