"""Column masks and the row filter; the caller's groups are an argument."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ADMIN_GROUP = "admins"
VISIBLE_REGION = "South"


def is_admin(groups: Collection[str]) -> bool:
    return ADMIN_GROUP in groups


def mask_email(email: Column, groups: Collection[str]) -> Column:
    if is_admin(groups):
        return email
    return F.concat(F.substring(email, 1, 2), F.lit("***"), F.regexp_extract(email, "(@.*)$", 1))


def mask_mobile(mobile: Column, groups: Collection[str]) -> Column:
    if is_admin(groups):
        return mobile
    return F.concat(F.lit("******"), F.substring(mobile, -4, 4))


def region_visible(region: Column, groups: Collection[str]) -> Column:
    if is_admin(groups):
        return F.lit(True)
    return region == VISIBLE_REGION
