"""Token ids of whole texts by the rank file of a vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from itertools import chain

#: Runs of white space from here on overflow the stack of the library's own pattern matcher, at about 800,000 signs.
LONG = 50_000
_RUN = re.compile(r"\s{%d}" % LONG)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def has_long_run(text: str) -> bool:
    return len(text) >= LONG and _RUN.search(text) is not None


def encoder(ranks_path: str, pattern: str) -> Callable[[str], list[int]]:
    """ids(text), without special tokens; texts with very long runs of white space are split by another matcher."""
    import regex
    import tiktoken

    own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
    split = regex.compile(pattern).findall

    def ids(text: str) -> list[int]:
        if has_long_run(text):
            return list(chain.from_iterable(own._encode_single_piece(word) for word in split(text)))
        return own.encode_ordinary(text)

    return ids
