"""Subword ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str) -> str:
    """Where a vocabulary lies on this machine: an absolute path stays; else the installed file of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """A function from a text to the ids that `tokenizers` gives with add_special_tokens=False.

    The ranks beside the vocabulary hold the same merges, and their encoder takes a fifth of the time; a text that has
    the string of a special token goes through `tokenizers`, which makes it one id and is kept from the first such text on.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary_path(name)
    special = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(part): int(rank) for part, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode
