"""Declared schemas of the corpus and the store."""

from __future__ import annotations

TURNS = "ambassador_name string, country string, speech string, is_procedural boolean, substantive_word_count int, role string, language string, speaker_header string, doc_symbol string, meeting_date string, meeting_number string, turn_index int, word_count int, source_pdf string, record_ids string"
UNITS = "unit_id string, speech_id string, para_index int, text string, country string, ambassador_name string, role string, language string, meeting_date string, bloc string, is_party int, para_is_procedural int, n_words int, segmented_at string"
JOBS = "unit_id string, codebook_id string, codebook_version int, run_id string, speech_id string, status string, request_hash string, prompt_hash string, model string, response_json string, error string, attempts int, prompt_tokens int, completion_tokens int, n_annotations int, n_evidence_unverified int, created_at string, updated_at string"
ANNOTATIONS = "unit_id string, codebook_id string, codebook_version int, run_id string, annotation_index int, dimension string, value string, evidence string, confidence double, evidence_verified int"
MANIFEST = "symbol string, series string, meeting_number int, resumption int, exists boolean, meeting_date date, agenda string, n_pages int, n_words int, n_terms int, sha256 string, n_bytes long, path string, error string"
#: Columns left out of dumps unless asked for.
HEAVY = ("response_json", "error")
