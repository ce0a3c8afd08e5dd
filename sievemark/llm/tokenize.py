"""Problem 8: the whole corpus as ids of a public byte-level tokenizer.

The rank file is opened where the work runs (its path is a parameter, the file
is never shipped or copied), once per Python worker.  Texts longer than
``long_text`` characters are first cut at places where the tokenizer's own
pre-splitting pattern always starts a new piece, blanks and changes between
letters, figures and signs among them, so that texts of one line are cut too,
memory stays bounded and the ids stay those of the whole text.

Defined results: null text and empty text give an empty list; blank text is
encoded as it stands; strings that look like special tokens are ordinary text;
repeated rows give a row each; ids that are null keep their row.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

# fixed values: the pre-splitting pattern of the public vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_TEXT = 100_000

#: Places where the pattern always starts a new piece, so a cut changes
#: nothing: a blank or line feed behind a non-space, and a sign or figure behind
#: a letter, or a sign or letter behind a figure, of the scripts named here.
_SAFE = re.compile(
    r"(?<=\S)(?=[ \n])|(?<=[A-Za-zА-Яа-яЁё一-龥ぁ-んァ-ヶก-ฮ])(?=[0-9,.;:!?(){}<>\"=/\[\]，。、！？；：「」（）])|(?<=[0-9])(?=[A-Za-z,.;:!?(){}<>\"=/\[\]，。、！？；：「」（）])"
)


def default_rank_file() -> str:
    """The installed vocabulary's place, or its usual folder."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(rank_file: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int) -> list[str]:
    """``text`` cut into pieces of about ``size`` at safe boundaries only; a run of letters of one kind stays whole, however long."""
    out, start = [], 0
    while len(text) - start > size and (m := _SAFE.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def encode(text: str | None, rank_file: str, long_text: int = LONG_TEXT) -> np.ndarray:
    """Ids of one text."""
    if not text:
        return np.empty(0, np.uint32)
    enc = encoder(rank_file)
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text, long_text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids, rank_file: str) -> bytes:
    """Raw bytes of ids; only whole texts are sure to be valid UTF-8."""
    return encoder(rank_file).decode_bytes([int(i) for i in ids])


def token_ids(docs: DataFrame, rank_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", long_text: int = LONG_TEXT) -> DataFrame:
    """``(id, ids array<int>)`` for every row of ``docs``: a narrow map, no shuffle."""
    rank_file = rank_file or default_rank_file()
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            seen: dict[str, np.ndarray] = {}
            parts = []
            for t in texts:
                t = t or ""
                if (x := seen.get(t)) is None:
                    x = seen[t] = encode(t, rank_file, long_text)
                parts.append(x)
            ends = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) for p in parts], out=ends[1:])
            flat = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    return spread(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))).mapInArrow(run, f"{id_col} long, ids array<int>")
