"""Byte-level BPE ids with the vocabulary of a public tokenizer file."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from parley.llm.wordbpe import byte_symbols

# Fixed value: the public pattern that byte-level tokenizers cut texts with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Encoder of one tokenizer file; ids are those of the tokenizers library.

    The file's merges are read as ranks, which an encoder of ranks works off about three times as fast.  Where that one
    gives up (white space by the hundred thousand exceeds its pattern's stack) the library itself encodes the text.
    """

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        steps = spec["pre_tokenizer"]
        if (spec["normalizer"], steps["type"], steps["add_prefix_space"], steps["use_regex"]) != (None, "ByteLevel", False, True):
            raise ValueError("the tokenizer file normalises or splits in another way")
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if made != list(range(256, 256 + len(made))):
            raise ValueError("the ids of the tokenizer file are not in the order of its merges")
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.bytes_of = {i: bytes(byte_of[s] for s in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, special_tokens=self.special,
                                        mergeable_ranks={b: i for i, b in self.bytes_of.items()})
        self.path = path

    @lru_cache(maxsize=2)
    def library(self, special: bool) -> Tokenizer:
        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        out.encode_special_tokens = not special
        return out

    def encode(self, text: str, special: bool = True) -> np.ndarray:
        """Ids of the text; strings of special tokens in it are these tokens, or plain text without ``special``."""
        try:
            return self.ranked.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
        except ValueError:
            return np.array(self.library(special).encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
