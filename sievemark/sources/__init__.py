"""Files, their texts and their chunks."""

from . import chunks, decode, extract, files
from .chunks import chunk_files, chunks_of, read_chunks, states_of
from .extract import extract_files
from .files import read_files

__all__ = ["available", "chunk_files", "chunks", "chunks_of", "decode", "extract", "extract_files", "files", "read_chunks", "read_files", "states_of"]


def available(name: str) -> bool:
    """Can a module that is not required be imported here?"""
    import importlib.util

    try:
        return importlib.util.find_spec(name) is not None
    except (ImportError, ValueError):
        return False
