"""Schemas of the engine's tables, as DDL; readers pass them instead of inferring."""

COMPANIES = "code string, name string, full_name string, exchange string, sub_theme string"
ANNOUNCEMENTS = "sec_code string, title string, adjunct_url string, announcement_ms bigint, position int"
CANDIDATES = "array<struct<title:string,date:string,url:string>>"
MANIFEST = (
    "doc_id string, code string, name string, full_name string, exchange string, sub_theme string, report_type string, report_year string, "
    f"period_label string, title string, announcement_date string, url string, file string, size bigint, sha256 string, pages int, candidates {CANDIDATES}, downloaded_at string"
)
BLOCKS = "doc_id string, page int, seq int, type string, src_type string, text string, html string, level int, caption string"
DOC_STATS = "doc_id string, tier string, mineru_cost_s double, parsed_at string, pages int, blocks int, tables int"
CHUNKS = (
    "chunk_id string, doc_id string, company string, code string, report_type string, report_label string, section string, page int, "
    "type string, text string, html string, caption string, n_chars int"
)
QUESTIONS = "id string, type string, question string, k int, expected_doc string, ground_truth string"
POSTINGS = "chunk_id string, term string, tf bigint"
EVIDENCE = (
    "qid string, idx int, chunk_id string, score double, vec_rank int, bm25_rank int, vec_sim double, company string, code string, doc_id string, "
    "report_label string, section string, page int, type string, text string, html string, n_chars int, mentioned_company boolean"
)
