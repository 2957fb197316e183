"""Tokenizers of public vocabulary files as plain functions from texts to arrays of ids."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from pagelore.llm.words import WordTable, by_text

#: White space to Python's split(), but not to the tokenizers' patterns.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Fixed value: the characters that no composition changes, whose lower case is one character, context or not.
_PLAIN = "\x00-\u012f\u0131-\u02ff"
WORD_END = "</w>"


class WordEncoder:
    """encode_batch of a lower-casing byte-level BPE tokenizer with word ends, remembering the ids of each word.

    Its pieces never cross white space, so texts are split there, and words into the pieces of the tokenizer's own
    pattern. All ids come from the library: those of a piece from the tokenizer's BPE model, those of words with
    characters beyond U+02FF or with control tokens, and of texts with characters that only split() takes for white
    space, from the whole tokenizer. So do all texts where the file describes another kind of tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.controls = [x["content"] for x in told["added_tokens"]]
        pattern = _split_pattern(told)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.by_word = pattern is not None and all(c + WORD_END in vocabulary for c in pre_tokenizers.ByteLevel.alphabet()) and not any(re.search(r"\s", c) for c in self.controls)
        if self.by_word:
            self.odd = re.compile("|".join([f"[^{_PLAIN}]", *map(re.escape, self.controls)]))
            self.parts = regex.compile(f"{pattern}|\n")
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
            self.pieces = WordTable(self._encode_pieces, self.dtype)
            self.words = WordTable(self._encode_words, self.dtype)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One call for all: a piece's last id is the one that ends a word. A line end has no ids."""
        is_piece = [p != "\n" for p in pieces]
        told = pieces if all(is_piece) else [p for p in pieces if p != "\n"]
        ids = np.array(self.bare.encode_batch_fast([told], is_pretokenized=True, add_special_tokens=False)[0].ids if told else [], self.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(told):
            raise ValueError("a piece has not exactly one id that ends a word")
        sizes = np.zeros(len(pieces), np.int64)
        sizes[np.array(is_piece, bool)] = np.diff(ends, prepend=0)
        return ids, sizes

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = set()
        if self.odd.search("\n".join(words)):
            odd = {i for i, w in enumerate(words) if self.odd.search(w)}
        plain = "".join(w + "\n" for i, w in enumerate(words) if i not in odd).lower()
        ids, at, sizes = self.pieces([self.parts.findall(plain)])
        upto = np.cumsum(sizes)[at == self.pieces.numbers["\n"]]  # ids up to the end of each word
        if not odd:
            return ids, np.diff(upto, prepend=0)
        found = iter(np.split(ids, upto[:-1]) if len(upto) else [])
        others = iter(self._whole([words[i] for i in sorted(odd)]))
        every = [next(others) if i in odd else next(found) for i in range(len(words))]
        return np.concatenate(every), np.array(list(map(len, every)))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return self._whole(texts)
        split = [[] if _ODD_SPACE.search(x) else x.split() for x in texts]
        ids, _, sizes = self.words(split)
        out = by_text(ids, sizes, split)
        for i, text in enumerate(texts):
            if text and not split[i] and _ODD_SPACE.search(text):
                out[i] = self._whole([text])[0]
        return out


def _split_pattern(told: dict) -> str | None:
    """The pattern of the pieces, if a tokenizer's file composes, lower-cases and splits as WordEncoder does."""
    steps = (told.get("normalizer") or {}).get("normalizers") or []
    before = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in before] != ["Split", "ByteLevel"]:
        return None
    split, level = before
    same = (
        steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " " and split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
        and told["model"]["type"] == "BPE" and told["model"]["end_of_word_suffix"] == WORD_END and not told.get("post_processor")
        and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"])
    )
    return split["pattern"].get("Regex") if same else None


@lru_cache(maxsize=2)
def word_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Byte-level BPE from a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [np.array(coder.encode_ordinary(x), np.uint32) for x in texts]
