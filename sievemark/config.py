"""Options of a scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from .vocab import EXTENSIONS, PDF_PAGES, SCANNED_PAGES


@dataclass(frozen=True)
class ScanConfig:
    """What to read and how much of it."""

    root: str
    output: str = "result.csv"
    output_format: str = "csv"
    include_extensions: frozenset[str] = field(default_factory=lambda: frozenset(EXTENSIONS))
    max_text_chars: int = 200_000
    max_structured_rows: int = 20_000
    max_binary_read_bytes: int = 5_000_000
    max_pdf_pages: int = PDF_PAGES
    max_scanned_pages: int = SCANNED_PAGES
    enable_ocr: bool = False
    include_empty_results: bool = False
    #: partitions that files are read in and that texts are analysed in; None leaves both to Spark
    file_parts: int | None = None
    analysis_parts: int | None = None
    debug_progress: bool = False
    slow_log_path: str | None = None
    slow_threshold_seconds: float = 20.0
