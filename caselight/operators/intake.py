"""Document stages: parsing outcome and field extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_docs(docs: DataFrame, error_code: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Parse outcome per document; ``error_code`` is the engine's code for a readable one, ``keep`` stays beside it."""
    unreadable = ~F.col("is_readable")
    code = F.lit(None).cast("string") if error_code is None else error_code
    return docs.select(
        "doc_id",
        unreadable.alias("unreadable_flag"),
        F.when(unreadable, 0).otherwise(F.col("page_count")).cast("int").alias("page_count_detected"),
        F.when(unreadable, "unreadable").otherwise(code).alias("parse_error_status"),
        F.col("ingestion_timestamp").alias("ingest_ts"),
        "payer_code",
        *keep,
    )


def extract_fields(parsed: DataFrame, forms: DataFrame) -> DataFrame:
    """Structured row per readable document; the missing flags mirror NULL anchors."""
    readable = parsed.where(~F.col("unreadable_flag")).select("doc_id", "ingest_ts", "payer_code")
    return readable.join(forms, "doc_id", "left").select(
        "doc_id",
        "member_id_on_form",
        "auth_id",
        "name_on_form",
        "dob_extracted",
        "ssn4_extracted",
        "service_date_on_form",
        F.col("dob_extracted").isNull().alias("missing_dob"),
        F.col("ssn4_extracted").isNull().alias("missing_ssn4"),
        F.col("ingest_ts").alias("extraction_ts"),
        "payer_code",
    )
