"""Schemas of the records that the library reads and writes."""

CHUNK = (
    "text string, source_type string, source_url string, source_title string, domains array<int>, chunk_index int, "
    "categories array<string>, freshness string, posted_at string, parent_post_id string, section_path string, notes string, "
    "lang string, chunk_id string, char_count int, crawled_at string"
)
CHUNK_FIELDS = [c.split()[0] for c in CHUNK.split(", ")]
ENRICHED = CHUNK + ", _retrieval_group string, _alias_urls array<string>, _canonical_url string, _passage string, _text_for_bm25 string"
QA = (
    "qa_id string, question string, answer_gold string, domain int, categories array<string>, question_type string, "
    "expected_source_urls array<string>, is_fallback_expected boolean, tags array<string>, created_by string, reviewed_by string, "
    "created_at string, reviewed_at string, gen_prompt_version string, notes string"
)
QA_FIELDS = [c.split()[0] for c in QA.split(", ")]
CELL = "report_id string, page int, ord int, x int, y int, w int, h int, text string, backcolor string"
