"""Token ids of texts by a public tokenizer file, with bounded memos of words.

A tokenizer that lower-cases, drops white space and cuts words by the rules below never looks across
ASCII white space, so the ids of a text are those of its words, one after another (a test compares
whole texts). Any other tokenizer file gets each text whole."""

from __future__ import annotations

import json
import os
import struct

import numpy as np

from .common import Memo, kept

DEFAULT_TOKENIZER = "word_bpe_49k.json"
_ENCODERS: dict[str, "WordEncoder"] = kept({})
#: Whole words that a worker remembers (the frequent ones), and words without marks, of either generation.
KEEP_WORDS, KEEP_STEMS = 100_000, 250_000


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that a word may end in; after a letter or digit they are words of their own to the tokenizer.
TRAILING = b".,;:!?*%&#$()[]\"|"
#: Letters up to here are one piece with their neighbours, have no parts to compose, and fold by themselves.
SIMPLE_UNDER, DOTTED_I = "ɐ", "İ"
# The kinds of steps, and the pattern, of a tokenizer that works word by word.
NORMAL_STEPS = ["NFC", "Replace", "Lowercase"]
WORD_STEPS = ["Split", "ByteLevel"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(rules: dict) -> bool:
    """Whether a tokenizer file's rules are those that the memo of words relies on."""
    normal = (rules.get("normalizer") or {}).get("normalizers") or []
    cut = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x["type"] for x in normal] != NORMAL_STEPS or [x["type"] for x in cut] != WORD_STEPS:
        return False
    plain = normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
    split = cut[0]["pattern"] == {"Regex": WORD_PATTERN} and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
    return plain and split and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"] and rules["model"]["type"] == "BPE"


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


class WordEncoder:
    """Ids as little-endian uint32 bytes.

    A plain word (letters, then perhaps marks) is its letters, lower-cased, and its marks: the letters go to the
    tokenizer's merges at once; any other word goes through all its steps."""

    def __init__(self, path: str, words: int = KEEP_WORDS, stems: int = KEEP_STEMS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_words = by_words(json.loads(self.tok.to_str()))
        self.merge = self.tok.model.tokenize
        self.signs = dict(enumerate(byte_signs()))
        self.words, self.stems, self.tails = Memo(self.one, words), Memo(self.merged, stems), Memo(self.whole, 10_000)

    def whole(self, word: bytes) -> bytes:
        return np.array(self.tok.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, low: bytes) -> bytes:
        """Of a lower-case word of letters."""
        ids = self.merge(low.decode() if low.isascii() else low.decode("latin-1").translate(self.signs))
        return struct.pack(f"<{len(ids)}I", *[x.id for x in ids])

    def one(self, word: bytes) -> bytes:
        stem = word.rstrip(TRAILING)
        if stem.isalpha():  # ASCII letters
            low = stem.lower()
        else:
            text = stem.decode()
            if not text.isalpha() or max(text) >= SIMPLE_UNDER or DOTTED_I in text:
                return self.whole(word)
            low = text.lower().encode()
        return self.stems[low] + self.tails[word[len(stem) :]] if len(stem) < len(word) else self.stems[low]

    def encode(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "replace")
        return b"".join(map(self.words.__getitem__, raw.split())) if self.by_words else self.whole(raw)


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
