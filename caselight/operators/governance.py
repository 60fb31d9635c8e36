"""Row-level access by payer and checks on keys and identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.exact import n_where
from caselight.sources.tables import append_missing

IDENTIFIERS = frozenset(
    {
        "first_name", "last_name", "middle_initial", "dob", "ssn4", "address_line1", "city", "zip",
        "phone", "email", "name_on_form", "dob_extracted", "ssn4_extracted", "sender_fax_number",
        "race_ethnicity", "member_id", "member_id_on_form", "candidate_member_id",
    }
)


NOBODY = "\u0000"  # stands for "no payer" in the join below; no payer code has it


def visible(
    df: DataFrame, grants: DataFrame, user: str, col: str = "payer_code", inline: int = 0
) -> DataFrame:
    """Rows without a payer, or of a payer ``user`` holds a grant for, by an existence join that each query evaluates.

    The user's grants are one row per payer at most, so adaptive execution broadcasts them once it knows their
    size, and prunes the folders of a table partitioned by payer.  With ``inline``, up to that many grants as they are
    now become an IN list instead, which reaches the scan as a pushed filter but keeps to the grants of this moment.
    """
    granted = grants.where(F.col("user_email") == user).select(F.col("payer_id").alias("_payer"))
    if inline:
        codes = [r["_payer"] for r in granted.distinct().limit(inline + 1).collect()]
        if len(codes) <= inline:
            return df.where(F.col(col).isNull() | F.col(col).isin(codes))
    without = df.sparkSession.range(0, 1, 1, 1).select(F.lit(None).cast("string").alias("_payer"))
    seen = granted.where(F.col("_payer").isNotNull()).unionByName(without)
    return df.join(seen, F.coalesce(col, F.lit(NOBODY)) == F.coalesce("_payer", F.lit(NOBODY)), "left_semi")


def grant_all(mapping: DataFrame, user: str, payers: DataFrame, granted_at: Column, by: str) -> DataFrame:
    """Mapping plus the missing (user, payer) pairs for every payer."""
    wanted = payers.select(
        F.lit(user).alias("user_email"),
        F.col("payer_code").alias("payer_id"),
        granted_at.alias("granted_at"),
        F.lit(by).alias("granted_by"),
    )
    return append_missing(mapping, wanted, ["user_email", "payer_id"])


def check_key(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """One row: NULL keys, duplicated keys and surplus rows of a key."""
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    per_key = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_missing", missing)
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.lit(",".join(cols)).alias("key_columns"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("_missing"), F.col("_n"))), F.lit(0)).alias("null_keys"),
        n_where(~F.col("_missing") & (F.col("_n") > 1)).alias("duplicate_keys"),
    )


def check_ref(child: DataFrame, table: str, col: str, parent: DataFrame, key: str) -> DataFrame:
    """One row: children whose non-NULL key has no parent."""
    # Count per key first: the join then sees each key once, however hot.
    used = child.groupBy(F.col(col).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    parents = parent.select(F.col(key).alias("_key")).distinct().withColumn("_found", F.lit(True))
    orphan = F.col("_key").isNotNull() & F.col("_found").isNull()
    return used.join(parents, "_key", "left").agg(
        F.lit(table).alias("table_name"),
        F.lit(col).alias("column_name"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), F.lit(0)).alias("null_refs"),
        F.coalesce(F.sum(F.when(orphan, F.col("_n"))), F.lit(0)).alias("orphan_rows"),
    )


def check_no_identifiers(df: DataFrame) -> list[str]:
    """Columns of a published view that name a person; empty when clean."""
    return sorted(IDENTIFIERS.intersection(df.columns))
