"""Every registered query against its SQL in DuckDB, on the smallest data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.catalog import QUERIES
from checks.compare import connect, rows_of
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = queries()[key](spark, SF)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert key in oracle_sql()
    cur = duck.execute(oracle_sql()[key])
    assert rows_of([d[0] for d in cur.description], cur.fetchall()) == (names, got)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_inventory_key_is_registered():
    missing = set(INVENTORY.split()) - set(queries())
    assert not missing


# The inventory keys. Those without a query of their own are tested elsewhere in tests/.
INVENTORY = """
scan_notices_csv scan_ocds_json stream_notice_pages scan_uploads scan_tables scroll_points scan_notice_pages sink_json_append
sink_by_date upsert_points delete_points parse_notice_date parse_money clean_field parse_cpv parse_bool join_address pick_value
notice_defaults filter_open_csv filter_active_ocds flatten_ocds extract_cpv_items first_region notice_point_id notice_display_text
notice_embedding_text notice_payload firm_slug audit_action audit_resource audit_skip audit_details format_value format_deadline
score_percent digest_subject urgency_band preview notice_url html_notice_fields tender_id_from_url page_links clean_document_text
document_id filename_metadata onboarding_state is_new clause_number search_result_row word_window_chunks page_map page_of_position
clause_boundaries clause_chunks split_large_clause sentence_chunks structure_gate chunk_enrich marker_stats chunk_quality clause_index
embed cosine vector_topk payload_filter shape_hits search_notices user_centroid match_documents vector_diagnostics count_points
collection_stats embed_missing firm_notice_pairs profile_assemble reminder_join user_firm conversation_counts unseen_urls is_saved
page_asof backfill_windows capability_vectors buyer_similarity owned_lookup notice_lookup avg_top3 capped_sum profile_counts
distinct_documents generic_share ordered_reasons sync_stats batch_outcome digest_totals saved_totals rank_scored overfetch
past_wins_recent conversations_recent priority_order thread_messages merge_sources concat_pages dedupe_links capability_score
past_win_score preference_hard_filter preference_score total_score score_notices recommend_notices personalised_search
match_breakdown recommend_past_wins recommend_capabilities recommend_preferences recommendations daily_digest deadline_reminders
mark_sent apply_saves apply_status apply_unsaves patch_update replace_update fill_defaults cascade_delete onboarding_update
refresh_vectors touch_parent insert_if_absent validate_rows audit_stream
"""
