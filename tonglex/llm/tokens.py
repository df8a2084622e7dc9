"""Public tokenizers, read from their own place; nothing is trained or copied."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import lru_cache


@lru_cache(maxsize=4)
def encoder(path: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids as tokenizers gives them without special tokens of its own; the strings of added tokens are those tokens.

    None: the 50k byte-level BPE, which comes in both forms with equal ids (tests compare them): its ranks are about
    four times as fast, its added tokens are those of the JSON file. A .tiktoken path is read as ranks without any.
    """
    added = {}
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = {piece: i for piece, i in ranks.items() if i not in added.values()}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        if not added:
            return own.encode_ordinary
        # most texts hold no added token: the plain call spares the search that comes with the other
        return lambda text: own.encode(text, allowed_special="all") if any(a in text for a in added) else own.encode_ordinary(text)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids
