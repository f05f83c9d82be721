"""Token ids of whole texts, by the tokenizers library, word by word with a bounded memory.

For vocabularies whose pre-tokenizer never joins characters across white space (it splits or
drops white space, adds no prefix and normalises each word on its own), a text's ids are its
words' ids one after the other. Each distinct word is then encoded once while it is remembered. Where the
vocabulary also lower-cases and splits letters from punctuation, a word of plain letters goes
straight to the library's model, and its punctuation apart. A text that holds the string of an added
token (such as an end-of-text mark) goes to the library as a whole, which gives the token's own id.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

REMEMBERED = 500_000  # words in each of the two generations a Python worker remembers (about 90 MB each)
LONGEST = 64  # bytes of a word that is worth remembering
_PLAIN = re.compile("[a-zß-öø-ÿ]+")  # letters with one lower-case form, which composing leaves alone
_TAIL = b".,!?;:"


def _byte_letters() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + k for k, b in enumerate(others)}


class _Words(dict):
    """Ids of words, as bytes; a word not yet known is made, or taken from the generation before."""

    def __init__(self, make, before: dict[bytes, bytes]) -> None:  # noqa: ANN001
        self._make, self._before = make, before

    def __missing__(self, word: bytes) -> bytes:
        made = self._before.get(word)
        if made is None:
            made = self._make(word)
        if len(word) <= LONGEST:
            self[word] = made
        return made


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library, self._tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # of words alone: folding may have made a word into a token's string
        small = self._tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self._code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        with open(path, encoding="utf-8") as file:
            written = json.load(file)
        self._added = [t["content"].encode() for t in written.get("added_tokens", [])]
        steps = json.dumps([written.get("normalizer"), written.get("pre_tokenizer")])
        self._folds = '"Lowercase"' in steps and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in steps and '"ByteLevel"' in steps
        self._model, self._letters = self._tokenizer.model, _byte_letters()
        self._remembered = remembered
        self._words = _Words(self._made, {})

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self._code}", *ids)

    def _whole(self, word: bytes) -> bytes:
        return self._packed(self._tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def _made(self, word: bytes) -> bytes:
        if not self._folds:
            return self._whole(word)
        core = word.rstrip(_TAIL)
        letters = core.decode().lower()
        if not _PLAIN.fullmatch(letters):
            return self._whole(word)
        if len(core) < len(word):
            return self._words[core] + self._words[word[len(core) :]]
        return self._packed([t.id for t in self._model.tokenize(letters.encode().decode("latin-1").translate(self._letters))])

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text, as the bytes of an array of self.dtype."""
        if any(token in text for token in self._added):
            return self._packed(self._library.encode(text.decode(), add_special_tokens=False).ids)
        if len(self._words) > self._remembered:
            self._words = _Words(self._made, dict(self._words))
        return b"".join(map(self._words.__getitem__, (text.lower() if self._folds else text).split()))

    def count(self, text: bytes) -> int:
        return len(self.encode(text)) // self.dtype.itemsize


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a vocabulary file that every machine has at `path`."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
