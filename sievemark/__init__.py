"""Finding and classifying personal data in large collections, on Spark."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"
_EXPORTS = {
    "analyze": "operators.document", "findings": "operators.finding", "classify": "operators.finding", "with_spans": "operators.recognise", "with_labels": "operators.recognise",
    "read_files": "sources.files", "extract_files": "sources.extract", "chunk_files": "sources.chunks", "read_chunks": "sources.chunks", "scan_root": "plans.scan", "scan_findings": "plans.scan",
    "write_results": "plans.report", "write_all": "plans.report", "register": "functions.sqlfuncs", "ScanConfig": "config",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    """The library's main functions, imported when first asked for."""
    if name in _EXPORTS:
        return getattr(importlib.import_module(f"{__name__}.{_EXPORTS[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
