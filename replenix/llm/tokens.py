"""Token ids of a byte-level BPE vocabulary file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import sys

import numpy as np
import pyarrow as pa

#: the pattern that splits text before the merges (fixed by the vocabulary)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def vocabulary(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    """The path of a public vocabulary file."""
    if folder not in sys.path:
        sys.path.append(folder)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(folder, name)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printing
    Latin-1 characters for themselves, the other bytes in order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes whole texts with the file's vocabulary and merges.  An id of such a file
    is its merge's rank, so the faster ``tiktoken`` merges alike; the tests hold the
    ids against those of ``tokenizers``.  Added tokens of the file (``<|endoftext|>``) are
    one id wherever their string stands in a text, as that library has it."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = byte_of()
        added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in file["model"]["vocab"].items() if piece not in added}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        #: bytes of each id
        self.width = np.zeros(max([*ranks.values(), *added.values()], default=0) + 1, np.int64)
        for piece, i in (ranks | {c.encode(): i for c, i in added.items()}).items():
            self.width[i] = len(piece)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow column (null: none)."""
        return [self.bpe.encode_to_numpy(t or "", allowed_special="all").astype("<u4", copy=False) for t in texts.to_pylist()]


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
