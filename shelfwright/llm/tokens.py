"""Token ids of a public byte-level vocabulary."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


@cache
def tokenizer(path: str, plain: bool = True) -> Tokenizer:
    """The vocabulary; with ``plain``, strings of special tokens inside a text are ordinary text."""
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain
    return made


@cache
def _special(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values())


@cache
def _ranked(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str | None = None, ranks: str | None = None, plain: bool = True) -> np.ndarray:
    """Ids of the text, without special tokens added.

    Strings of special tokens in the text are ordinary text, or, without ``plain``, those tokens, as the vocabulary has it.
    Latin-1 texts go through the same vocabulary as ranks, which gives the same ids several times as fast
    (a test holds both against each other for every such character); other texts go through the vocabulary
    itself, as both libraries may know different editions of Unicode.
    """
    if path is None:
        path, ranks = public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)
    if ranks is not None and (plain or not any(t in text for t in _special(path))):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            return _ranked(ranks).encode_to_numpy(text, disallowed_special=())
    return np.array(tokenizer(path, plain).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
