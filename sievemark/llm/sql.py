"""DuckDB statements for those queries of this subpackage that SQL can express over whole tables."""

ORACLE: dict[str, str] = {
    "p3_found": "SELECT content_id FROM extracted_content WHERE length(text) > 3000",
}
