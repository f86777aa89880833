"""Public byte-level BPE vocabularies, loaded once per Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

TOKENIZER_FILE = os.environ.get("CADENCE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end_of_text = len(ranks)        # the first free id
        self.n_ids = len(ranks) + 1

    def encode_text(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)
