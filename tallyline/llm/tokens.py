"""Ids and bytes of the public tokenizers' tokens.  A tokenizer is a file that every executor can read."""

from __future__ import annotations

import json
import re

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the pre-tokens of byte-level tokenizers.
_PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The splitter of the quick way recurses over blanks: texts with longer stretches of them go through the file's own tokenizer.
_LONG_TEXT, _LONG_BLANK = 200_000, re.compile(r"\s{100000}")


def written_bytes() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it shows, else the next one after 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level tokenizer of the `tokenizers` library.

    Where its merges come in the order of the ids they make, the ids follow from the vocabulary alone; then tiktoken, which is
    several times quicker, finds the same ids from the same file.  Any other file goes through `tokenizers`.
    `plain_specials`: the strings of special tokens are ordinary text; else they give the special tokens, as the library does.
    """

    def __init__(self, path: str, plain_specials: bool):
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = plain_specials
        spec = json.loads(self.own.to_str())
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        byte = written_bytes()
        size = max(self.own.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(map(byte.__getitem__, token))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.specials = None if plain_specials or not added else re.compile("|".join(map(re.escape, added)))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        by_rank = (
            spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and made == list(range(256, 256 + len(made))) and len(model["vocab"]) == 256 + len(made)
        )
        self.quick = None
        if by_rank:
            self.quick = tiktoken.Encoding("own", pat_str=_PRE_TOKENS, mergeable_ranks={self.bytes[i]: i for i in model["vocab"].values()}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if (self.quick is None or (self.specials is not None and self.specials.search(text))
                or (len(text) > _LONG_TEXT and _LONG_BLANK.search(text))):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


class PieceBpe:
    """A sentencepiece model; its marked blank is a space, its byte pieces are bytes."""

    def __init__(self, path: str):
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, num_threads=1), "<u4")


_LOADED: dict[tuple, ByteBpe | PieceBpe] = {}


def loaded(kind: type, *arguments):
    """One of each for each worker process."""
    key = (kind, *arguments)
    if key not in _LOADED:
        _LOADED[key] = kind(*arguments)
    return _LOADED[key]
