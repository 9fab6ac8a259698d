"""Token ids of whole texts, with a bounded cache of words."""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
from tokenizers import Tokenizer


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    others = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + k) for k, b in enumerate(others)}


class TokenCache(dict):
    """Words in UTF-8, with A-Z in lower case, to their ids as little-endian 32-bit values.

    This holds for tokenizers that lower-case, compose (NFC) and drop white space before they split into runs
    of letters, digits and other signs, and encode each run by itself; ``fits`` checks it.  Any other
    tokenizer encodes whole texts.  The cache is emptied when it holds ``limit`` words."""

    limit = 600_000
    _shared: dict[str, TokenCache] = {}

    @classmethod
    def of(cls, path: str) -> TokenCache:
        """One cache per worker process."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_word = self.fits(json.load(file))
        self.letters = str.maketrans({chr(b): letter for b, letter in _byte_letters().items()})
        self.model = self.tokenizer.model

    @staticmethod
    def fits(config: dict) -> bool:
        steps = [x["type"] for x in (config.get("normalizer") or {}).get("normalizers", [])]
        splits = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["use_regex"]
            and splits[0]["pattern"]["Regex"].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and " " not in x["content"] for x in config["added_tokens"])
        )

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, spelled: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(spelled)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() and len(word) < 200:  # letters a-z: one run, which stands for itself
            ids = self._run(word.decode())
        elif word[-1:] in (b".", b",") and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            text = word.decode()
            if text.isalpha() and max(text) <= "ÿ" and len(text) < 200:
                # one run of letters that lower() composes and lower-cases as the tokenizer does
                ids = self._run(text.lower().encode().decode("latin-1").translate(self.letters))
            else:
                ids = self._encoded(text)
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not self.by_word or "<|" in text:
            return self._encoded(text)
        if len(self) > self.limit:
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().lower().split()))
