"""Explicit schemas of the source tables, with column comments."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "d": T.DoubleType(),
    "b": T.BooleanType(),
    "date": T.DateType(),
    "ts": T.TimestampType(),
    "arr": T.ArrayType(T.StringType()),
}


def _schema(text: str, required: tuple[str, ...] = ()) -> T.StructType:
    """``name:type`` pairs; the type defaults to string."""
    fields = []
    for token in text.split():
        name, _, kind = token.partition(":")
        fields.append(T.StructField(name, _TYPES[kind or "s"], name not in required))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "member": _schema(
        "member_id first_name last_name middle_initial dob:date gender ssn4 address_line1 city state zip"
        " phone email preferred_language race_ethnicity created_at:ts updated_at:ts source_system"
    ),
    "authorization": _schema(
        "auth_id auth_number member_id service_from_date:date service_to_date:date procedure_code"
        " procedure_modifier diagnosis_code rendering_provider_npi rendering_provider_name status"
        " approved_units:i denial_reason_code auth_requested_date:date auth_decision_date:date"
        " clinical_doc_id doc_match_method doc_received_date:ts pend_reason additional_info_due_date:date"
        " created_at:ts updated_at:ts created_by payer_code urgency"
    ),
    "clinical_document": _schema(
        "doc_id auth_id member_id document_type file_name file_path file_format file_size_bytes:l"
        " page_count:i source_channel sender_fax_number sender_provider_npi received_timestamp:ts"
        " ingestion_timestamp:ts mrm_batch_id cover_sheet_detected:b ocr_status ocr_confidence_score:d"
        " match_status doc_match_method match_confidence_score:d matched_by matched_at:ts is_readable:b"
        " quality_score:d notes created_at:ts updated_at:ts payer_code"
    ),
    "clinical_doc_parsed": _schema(
        "doc_id unreadable_flag:b page_count_detected:i parse_error_status ingest_ts:ts payer_code"
    ),
    "clinical_doc_structured": _schema(
        "doc_id member_id_on_form auth_id name_on_form dob_extracted ssn4_extracted service_date_on_form:date"
        " missing_dob:b missing_ssn4:b extraction_ts:ts payer_code"
    ),
    "doc_member_match_candidates": _schema(
        "doc_id candidate_member_id name_weight:d dob_weight:d ssn4_weight:d total_weight:d match_class"
        " pipeline_run_ts:ts payer_code"
    ),
    "doc_auth_match_candidates": _schema(
        "doc_id candidate_auth_id auth_id_weight:d service_date_weight:d total_weight:d match_class"
        " pipeline_run_ts:ts payer_code"
    ),
    "match_events": _schema("event_id doc_id event_type matched_entity_id confidence:d event_ts:ts"),
    "mv_call_scores": _schema(
        "call_id document_id agent_name agency_name call_type vendor_template language disposition"
        " call_score:i summary_of_score outcome_bucket created_ts:ts source_schema"
    ),
    "gold_call_summaries_sentiment": _schema(
        "document_id call_type vendor_template summary_text sentiment_overall sentiment_start"
        " sentiment_end sentiment_trajectory key_topics:arr emotional_markers:arr created_ts:ts source_schema"
    ),
    "mv_compliance_outcomes": _schema(
        "day:date call_type agency_name scored_calls:l avg_call_score:d compliant_calls:l"
        " needs_review_calls:l high_risk_calls:l high_risk_rate:d compliance_rate:d source_schema"
    ),
    "payer_dim": _schema(
        "payer_code payer_name payer_type active:b created_at:ts", ("payer_code", "payer_name")
    ),
    "call_ops_supplemental": _schema(
        "call_id wait_seconds:i handle_seconds:i fcr_flag:b generated_at:ts synthetic_call_ts:ts",
        ("call_id",),
    ),
    "payer_access_mapping": _schema(
        "user_email payer_id granted_at:ts granted_by", ("user_email", "payer_id")
    ),
    "dq_run_results": _schema(
        "batch_id run_ts:ts total_docs:l pct_unreadable:d pct_missing_dob:d pct_missing_ssn4:d"
        " parse_errors:l pct_match:d pct_possible_match:d pct_non_match:d"
    ),
    "fellegi_sunter_parameters": _schema("field m:d u:d"),
    "pipeline_run_log": _schema("run_ts:ts status run_by"),
}

TABLE_COMMENTS: dict[str, str] = {
    "clinical_doc_parsed": "One row per document after OCR parsing",
    "clinical_doc_structured": "Fields read off each readable document",
    "doc_member_match_candidates": "Scored member candidate of each document",
    "doc_auth_match_candidates": "Scored authorization candidate of each document",
    "match_events": "Confirmed links of documents to members and authorizations",
    "dq_run_results": "Data-quality summary per intake batch",
    "fellegi_sunter_parameters": "Agreement probabilities per compared field",
    "pipeline_run_log": "One row per processing run",
    "payer_dim": "Payer dimension",
    "call_ops_supplemental": "Queue and handle times per call",
    "payer_access_mapping": "Which user may see which payer",
}

COLUMN_COMMENTS: dict[str, dict[str, str]] = {
    "clinical_doc_parsed": {
        "doc_id": "Document key",
        "unreadable_flag": "OCR could not read the document",
        "page_count_detected": "Pages found by OCR, 0 when unreadable",
        "parse_error_status": "Error category, NULL on success",
        "ingest_ts": "Entry into the parsing stage",
    },
    "clinical_doc_structured": {
        "doc_id": "Document key",
        "member_id_on_form": "Member id read off the form",
        "auth_id": "Authorization id read off the form",
        "dob_extracted": "Date of birth as text",
        "ssn4_extracted": "Last four SSN digits as text",
        "missing_dob": "Date of birth not found",
        "missing_ssn4": "Last four SSN digits not found",
        "extraction_ts": "End of field extraction",
    },
    "doc_member_match_candidates": {
        "doc_id": "Document key",
        "candidate_member_id": "Member scored against the document",
        "name_weight": "Weight of the name comparison",
        "dob_weight": "Weight of the date-of-birth comparison",
        "ssn4_weight": "Weight of the SSN comparison",
        "total_weight": "Sum of the field weights",
        "match_class": "match, possible_match or non_match",
        "pipeline_run_ts": "When the candidate was scored",
    },
    "doc_auth_match_candidates": {
        "doc_id": "Document key",
        "candidate_auth_id": "Authorization scored against the document",
        "auth_id_weight": "Weight of the authorization-id comparison",
        "service_date_weight": "Weight of the service-date comparison",
        "total_weight": "Sum of the field weights",
        "match_class": "match, possible_match or non_match",
        "pipeline_run_ts": "When the candidate was scored",
    },
    "match_events": {
        "event_id": "Event key",
        "doc_id": "Document the event is about",
        "event_type": "Kind of confirmed link",
        "matched_entity_id": "Member or authorization linked to",
        "confidence": "Confidence of the decision, 0 to 1",
        "event_ts": "When the link was confirmed",
    },
    "dq_run_results": {
        "batch_id": "Intake batch",
        "run_ts": "When the batch was checked",
        "total_docs": "Documents in the batch",
        "pct_unreadable": "Percent OCR could not read",
        "pct_missing_dob": "Percent without date of birth",
        "pct_missing_ssn4": "Percent without SSN digits",
        "parse_errors": "Documents with a parse error",
        "pct_match": "Percent of candidates classed match",
        "pct_possible_match": "Percent of candidates classed possible_match",
        "pct_non_match": "Percent of candidates classed non_match",
    },
    "pipeline_run_log": {
        "run_ts": "Start of the run",
        "status": "success, failed or partial",
        "run_by": "Who started the run",
    },
}
