"""Governed customer dimension: region bucket, column masks, row filter."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import murmur_abs_bucket, portable_bucket
from tidemark.functions.masks import mask_email, mask_mobile, region_visible

# Fixed values.
REGIONS = ["North", "South", "East", "West"]


def region_of(key: Column, portable: bool = False) -> Column:
    bucket = (portable_bucket if portable else murmur_abs_bucket)(len(REGIONS), key)
    return F.element_at(F.array(*[F.lit(name) for name in REGIONS]), bucket + 1)


def customer_dimension(users: DataFrame, portable: bool = False) -> DataFrame:
    return users.select(
        "user_id",
        "first_name",
        "last_name",
        "email",
        "mobile",
        region_of(F.col("user_id"), portable).alias("region"),
        "date_of_birth",
        "anniversary_date",
        "created_at",
    )


def governed_customers(dimension: DataFrame, groups: Collection[str]) -> DataFrame:
    """What a member of ``groups`` may see: filtered rows, masked mail and mobile."""
    return dimension.where(region_visible(F.col("region"), groups)).withColumns(
        {
            "email": mask_email(F.col("email"), groups),
            "mobile": mask_mobile(F.col("mobile"), groups),
        }
    )


def register_sql_masks(spark: SparkSession, groups: Collection[str]) -> None:
    """SQL forms of the masks and the filter for the groups of the current user."""
    admin = "TRUE" if "admins" in groups else "FALSE"
    bodies = {
        "mask_email(mail STRING) RETURNS STRING": (
            f"if({admin}, mail, left(mail, 2) || '***' || regexp_extract(mail, '(@.*)$', 1))"
        ),
        "mask_mobile(number STRING) RETURNS STRING": f"if({admin}, number, '******' || right(number, 4))",
        "region_filter(region STRING) RETURNS BOOLEAN": f"{admin} OR region = 'South'",
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
