"""Byte-level BPE ids of whole texts, from public vocabulary files.

The ids are those of ``tokenizers`` with the given JSON file. Texts of common
scripts are encoded with ``tiktoken`` from the same vocabulary, which is
several times faster and gives the same ids (tests hold both together); texts
with rarer characters, where Unicode versions of the two libraries could
differ, go to ``tokenizers`` itself. The path is a parameter and the file must
be found at that place by every worker, as with any installed package.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: End of the code points whose letter and digit classes are stable: Latin, Greek, Cyrillic.
COMMON_END = 0x0530


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _loaded(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    model = json.load(open(path, encoding="utf-8"))
    # the printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves, the others follow from 256 on
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in visible}
    stand_in |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(stand_in[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return slow, tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str) -> np.ndarray:
    """The ids of one whole text as uint32; null is the empty text."""
    slow, fast = _loaded(path)
    if not text:
        return np.zeros(0, "<u4")
    if text.isascii() or np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max() < COMMON_END:
        return np.asarray(fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), "<u4")
    return np.asarray(slow.encode(text, add_special_tokens=False).ids, "<u4")
