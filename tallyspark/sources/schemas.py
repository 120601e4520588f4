"""Column lists of the engine's tables, as Spark DDL; never inferred.

Money is in minor units, dates are DATE, ``created_at``/``updated_at`` are
epoch milliseconds or sequence numbers; every table carries its owner.
"""

TABLES: dict[str, str] = {
    "transactions": "owner_id BIGINT, tx_id STRING, type STRING, amount_minor BIGINT, category_id BIGINT, merchant STRING, note STRING, tx_date DATE, source STRING, created_at BIGINT, receipt_group_id STRING, merchant_id BIGINT, purchase_group_id STRING",
    "categories": "owner_id BIGINT, category_id BIGINT, name STRING, type STRING, icon_name STRING, created_at BIGINT, is_archived BOOLEAN",
    "merchants": "owner_id BIGINT, merchant_id BIGINT, display_name STRING, normalized_name STRING, usage_count BIGINT, last_used_at BIGINT, created_at BIGINT, default_category_id BIGINT, source STRING",
    "item_category_mappings": "owner_id BIGINT, normalized_item STRING, normalized_merchant STRING, category_id BIGINT, confirmation_count BIGINT, created_at BIGINT, updated_at BIGINT",
    "financial_commitments": "owner_id BIGINT, commitment_id BIGINT, title STRING, amount_minor BIGINT, type STRING, frequency STRING, next_due_date DATE, end_date DATE, merchant_id BIGINT, notes STRING, is_active BOOLEAN, created_at BIGINT, updated_at BIGINT",
    "commitment_occurrence_overrides": "owner_id BIGINT, commitment_id BIGINT, due_date DATE, status STRING, paid_tx_id STRING, paid_at BIGINT",
    "debt_profiles": "owner_id BIGINT, profile_id BIGINT, commitment_id BIGINT, creditor_name STRING, original_principal_minor BIGINT, start_date DATE, expected_end_date DATE, repayment_mode STRING, notes STRING, is_archived BOOLEAN, created_at BIGINT, updated_at BIGINT",
    "debt_payments": "owner_id BIGINT, profile_id BIGINT, due_date DATE, payment_date DATE, total_minor BIGINT, principal_minor BIGINT, financing_minor BIGINT, late_minor BIGINT, linked_tx_id STRING, note STRING, idempotency_key STRING, created_at BIGINT",
    "financing_terms": "owner_id BIGINT, profile_id BIGINT, financing_type STRING, total_repayable_minor BIGINT, rate_points BIGINT, created_at BIGINT, updated_at BIGINT",
    "late_payment_rules": "owner_id BIGINT, profile_id BIGINT, grace_days INT, charge_type STRING, charge_interval STRING, charge_basis STRING, fixed_minor BIGINT, rate_points BIGINT, is_compounding BOOLEAN, minimum_minor BIGINT, maximum_minor BIGINT, created_at BIGINT, updated_at BIGINT",
    "assets": "owner_id BIGINT, asset_id BIGINT, name STRING, asset_type STRING, custom_type_id BIGINT, brand STRING, model STRING, category_id BIGINT, purchase_price_minor BIGINT, current_km BIGINT, ownership_status STRING, is_archived BOOLEAN, created_at BIGINT, updated_at BIGINT",
    "custom_asset_types": "owner_id BIGINT, custom_type_id BIGINT, name STRING, normalized_name STRING, is_archived BOOLEAN, created_at BIGINT",
    "asset_ownership_events": "owner_id BIGINT, event_id BIGINT, asset_id BIGINT, status STRING, effective_date DATE, note STRING, created_at BIGINT",
    "asset_identifiers": "owner_id BIGINT, identifier_id BIGINT, asset_id BIGINT, identifier_type STRING, value STRING, created_at BIGINT",
    "asset_warranties": "owner_id BIGINT, warranty_id BIGINT, asset_id BIGINT, name STRING, start_date DATE, end_date DATE, created_at BIGINT",
    "asset_maintenance_rules": "owner_id BIGINT, rule_id BIGINT, asset_id BIGINT, title STRING, kind STRING, trigger_type STRING, interval_months INT, interval_km BIGINT, baseline_date DATE, baseline_km BIGINT, warning_days INT, warning_km BIGINT, is_active BOOLEAN, created_at BIGINT, updated_at BIGINT",
    "asset_maintenance_events": "owner_id BIGINT, event_id STRING, asset_id BIGINT, rule_id BIGINT, title STRING, event_date DATE, km BIGINT, cost_minor BIGINT, merchant_id BIGINT, linked_tx_id STRING, notes STRING, idempotency_key STRING, created_at BIGINT",
    "asset_documents": "owner_id BIGINT, document_id BIGINT, asset_id BIGINT, document_type STRING, title STRING, stored_path STRING, mime_type STRING, size_bytes BIGINT, created_at BIGINT",
    "asset_transaction_links": "owner_id BIGINT, asset_id BIGINT, tx_id STRING, relation STRING",
    "asset_commitment_links": "owner_id BIGINT, asset_id BIGINT, commitment_id BIGINT, relation STRING",
    "asset_maintenance_document_links": "owner_id BIGINT, event_id STRING, document_id BIGINT",
    "asset_checkpoints": "owner_id BIGINT, checkpoint_id BIGINT, asset_id BIGINT, title STRING, trigger_mode STRING, due_date DATE, due_km BIGINT, repeat_months INT, repeat_km BIGINT, warning_days INT, warning_km BIGINT, rescheduled_date DATE, rescheduled_km BIGINT, is_active BOOLEAN, created_at BIGINT, updated_at BIGINT",
    "asset_checkpoint_events": "owner_id BIGINT, event_id STRING, checkpoint_id BIGINT, event_date DATE, km BIGINT, due_date DATE, due_km BIGINT, note STRING, created_at BIGINT",
    "asset_reminder_rules": "owner_id BIGINT, rule_id STRING, asset_id BIGINT, source_type STRING, source_id BIGINT, trigger_kind STRING, lead_value BIGINT, is_enabled BOOLEAN",
    "asset_notification_deliveries": "owner_id BIGINT, rule_id STRING, occurrence_key STRING, delivered_at BIGINT",
    "ocr_lines": "owner_id BIGINT, receipt_id BIGINT, line_no BIGINT, text STRING, confidence DOUBLE, left DOUBLE, top DOUBLE, right DOUBLE, bottom DOUBLE",
    "numeric_candidates": "owner_id BIGINT, receipt_id BIGINT, item_id STRING, text STRING, confidence DOUBLE, preprocessing STRING, role STRING, left DOUBLE, right DOUBLE",
    "labelled_items": "item_id BIGINT, canonical_id STRING, text STRING, category STRING, language STRING, variant_type STRING",
}

# The tables the driver generates, with only the columns the engine reads.
DRIVER_TABLES: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# Allowed texts of the enum columns, in their declared order.
ENUMS: dict[str, list[str]] = {
    "transaction_type": ["EXPENSE", "INCOME"],
    "transaction_source": ["MANUAL", "RECEIPT", "BANK_NOTIFICATION", "SMS"],
    "category_type": ["DEFAULT", "CUSTOM"],
    "frequency": ["ONE_TIME", "WEEKLY", "MONTHLY", "QUARTERLY", "SEMI_ANNUAL", "ANNUAL", "CUSTOM"],
    "occurrence_status": ["UNPAID", "PAID", "SKIPPED"],
    "repayment_mode": ["FIXED_INSTALLMENTS", "OPEN_ENDED"],
    "ownership_status": ["OWNED", "SOLD", "GIVEN_AWAY", "LOST", "DISPOSED"],
}
