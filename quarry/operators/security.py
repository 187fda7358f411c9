"""Row security: which rows an access context sees, and which it may write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.context import AccessContext


def visible(ctx: AccessContext, level: str = "classification") -> Column:
    """The filter that every secured read carries; on physical columns it reaches the scan."""
    if ctx.clearance is None:
        return F.lit(False)
    return (F.col("app_id") == ctx.app_id) & (F.col(level) <= F.lit(ctx.clearance))


def secure(df: DataFrame, ctx: AccessContext, level: str = "classification") -> DataFrame:
    """docs, chunks, entity, entity_chunk, entity_edge, entity_summary; audit_search with level="clearance". An administrator sees all."""
    return df if ctx.role == "admin" else df.where(visible(ctx, level))


def secure_versions(versions: DataFrame, docs: DataFrame, ctx: AccessContext) -> DataFrame:
    """Versions of the documents that are visible."""
    return versions if ctx.role == "admin" else versions.join(secure(docs, ctx).select("doc_id"), "doc_id", "left_semi")


def secure_jobs(jobs: DataFrame, ctx: AccessContext) -> DataFrame:
    return jobs.where(F.col("app_id") == ctx.app_id)


def secure_mutations(audit: DataFrame, actor: str) -> DataFrame:
    return audit.where(F.col("actor") == actor)


def open_bases(bases: DataFrame, ctx: AccessContext, level: str = "required_clearance") -> DataFrame:
    """The knowledge bases that a clearance opens, whatever their application."""
    return bases.where(F.lit(False) if ctx.clearance is None else F.col(level) <= F.lit(ctx.clearance))


def check_writes(rows: DataFrame, ctx: AccessContext) -> DataFrame:
    """The rows, unless one belongs to another application: then writing them fails. A reader writes nothing. A row may be above its
    writer's clearance, who then doesn't see it: classification says who reads, and a decision upwards is no leak."""
    if ctx.role == "admin":
        return rows
    if not ctx.may_write:
        raise PermissionError(f"the role {ctx.role} does not write")
    message = f"row of another application than {ctx.app_id}"
    fine = F.coalesce(F.col("app_id") == ctx.app_id, F.lit(False))
    return rows.withColumn("app_id", F.when(fine, F.col("app_id")).otherwise(F.raise_error(F.lit(message)).cast("string")))
