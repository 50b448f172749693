"""Byte-level BPE token ids by a public vocabulary file (nothing is trained here)."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that this vocabulary goes with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded part by part, cut before a single blank between words, where the
#: pattern always splits; the ids are the same.
PART_CHARS = 1 << 16
#: Longer runs of white space are cut into pieces of this length (the pattern's look-ahead would
#: exhaust the encoder's stack); the ids still decode to the same text.
SPACE_RUN = 1 << 12
_RUN = re.compile(rf"\s{{{SPACE_RUN}}}")


@lru_cache(2)
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def end_id(path: str = VOCABULARY) -> int:
    """The id after the last of the vocabulary ends a document; no text encodes to it."""
    return encoding(path).n_vocab


def id_type(path: str = VOCABULARY) -> np.dtype:
    return np.dtype("<u2" if end_id(path) < 1 << 16 else "<u4")


def parts(text: str):
    lo = 0
    while len(text) - lo > PART_CHARS:
        at = lo + PART_CHARS
        while 0 <= (at := text.find(" ", at)) and (text[at - 1].isspace() or at + 1 >= len(text) or text[at + 1].isspace()):
            at += 1
        if at < 0:
            break
        yield text[lo:at]
        lo = at
    yield text[lo:]


def pieces(text: str):
    """Parts of a long text, none with a white space run over ``SPACE_RUN``."""
    for p in parts(text):
        lo = 0
        for m in _RUN.finditer(p):
            yield p[lo: m.start()]
            yield m[0]
            lo = m.end()
        yield p[lo:]


def encode(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Ids of a whole text; none for a null or empty one."""
    if not text:
        return []
    e = encoding(path)
    if len(text) <= SPACE_RUN:
        return e.encode_ordinary(text)
    return [i for p in pieces(text) if p for i in e.encode_ordinary(p)]
