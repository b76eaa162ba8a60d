"""Token ids of the byte-level tokenizer, as the ``tokenizers`` library gives them.

The vocabulary also exists as ranks, which encode several times faster. Both follow one pattern for
pre-tokens; its letter and number classes may differ between the two libraries' Unicode versions,
so texts with characters beyond those of the Latin, Greek and Cyrillic blocks and general
punctuation go through ``tokenizers`` itself. The special string inside a text is read as its id,
the default of ``tokenizers``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Code points whose classes have long been settled.
_RARE = re.compile("[^\x00-ͷЀ-ҁҊ-ԧ‐-‧‰-⁞€]")


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids, without added special tokens, truncation or padding."""
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if _RARE.search(text):
            return library.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode
