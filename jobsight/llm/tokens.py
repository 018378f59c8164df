"""Token ids of whole texts from a tokenizer file, with a bounded cache of words.

A tokenizer that drops white space gives a text the ids of its words one after the other,
so every distinct word has to be encoded only once per worker. The file's own normalizer
and pattern say whether this holds; other tokenizers encode whole texts by the library.
"""

from __future__ import annotations

import json
import os
import struct
from functools import lru_cache
from pathlib import Path

import regex

from .text import pieces

#: Words whose ids a worker keeps (about 200 bytes each); beyond it the cache starts anew.
CACHE = 800_000
# Fixed values of the files that are known to cut texts into words: how a word is cut into pieces.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters whose normal form, lower case, class and bytes are the same in every library.
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# Marks that end a word, a piece of their own after a letter or digit (the apostrophe is none).
_MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


def default_path() -> str:
    """The public word-level file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Word (bytes) to ids (little-endian unsigned 32-bit)."""

    def __init__(self, tokenizer) -> None:
        from tokenizers import pre_tokenizers

        super().__init__()
        self._tokenizer, self._tokenize, self._pieces = tokenizer, tokenizer.model.tokenize, regex.compile(_PATTERN).findall
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)]]
        self._table = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in plain})

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        if core != word and core[-1:].isalnum() and b"<|" not in word:
            packed = self[core] + self[word[len(core):]]  # most words with a mark are known without it
        else:
            ids = self._ids(word.decode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE:
            self.clear()
        self[word] = packed
        return packed

    def _ids(self, text: str) -> list[int]:
        if text.isascii() and text.isalpha():
            return [t.id for t in self._tokenize(text.lower())]
        if _PLAIN.fullmatch(text) and "<|" not in text:
            text = text.lower()
            cut = [text] if text.isalpha() else self._pieces(text)
            return [t.id for p in cut for t in self._tokenize(p.translate(self._table))]
        return self._tokenizer.encode(text, add_special_tokens=False).ids


class TextEncoder:
    """Ids of whole texts as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self._tokenizer = Tokenizer.from_file(path)
        self._words = _Words(self._tokenizer) if _cuts_words(json.loads(Path(path).read_text())) else None

    def encode(self, text: bytes) -> bytes:
        if self._words is None:
            ids = self._tokenizer.encode(text.decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if b"<|" not in text:  # so that no marker comes to be by lower-casing
            text = text.lower()
        get = self._words.__getitem__
        return b"".join(b"".join(map(get, piece.split())) for piece in pieces(text))


def _cuts_words(file: dict) -> bool:
    """Whether a text has the ids of its lower-cased words, one after the other."""
    steps = (file.get("normalizer") or {}).get("normalizers", [])
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return False
    blank = steps[1]["pattern"].get("Regex") == r"\s+" and steps[1]["content"] == " "
    split, level = cuts
    dropped = split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
    marked = all(not t["normalized"] and t["content"].startswith("<|") for t in file.get("added_tokens", []))
    return blank and dropped and marked and split["pattern"].get("Regex") == _PATTERN


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder per worker and file."""
    return TextEncoder(path)
