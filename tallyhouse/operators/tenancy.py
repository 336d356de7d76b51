"""Reading what a principal is granted. A convenience for queries, not a security boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import broadcast_within, stage
from tallyhouse.sources.files import scan_text


def readable_rows(data: DataFrame, grants: DataFrame, principal: str, tenant: str = "tenant") -> DataFrame:
    """Rows of the tenants granted to ``principal``; a repeated grant repeats no row.

    The tenants of one principal are measured and normally broadcast, so the data is filtered in place.
    """
    granted = stage(grants.filter(F.col("principal") == principal).select(tenant).distinct(), "grants")
    return data.join(broadcast_within(granted), tenant, "left_semi")


def require_grant(grants: DataFrame, principal: str, tenant: str, column: str = "tenant") -> None:
    """Raise ``PermissionError`` unless the grant exists."""
    held = grants.filter((F.col("principal") == principal) & (F.col(column) == tenant))
    if held.isEmpty():
        raise PermissionError(f"{principal} may not read {tenant}")


def read_tenant_text(spark: SparkSession, root: str, grants: DataFrame, principal: str, tenant: str) -> DataFrame:
    """Lines of the tenant's text files below ``root``, if the principal holds the grant."""
    require_grant(grants, principal, tenant)
    return scan_text(spark, f"{root}/{tenant}")
