"""Exact, fast encoding with a word-level BPE tokenizer file of the `tokenizers` library.

The file's pre-tokenizer drops white space and no token spans it, so a text's ids are its white-space separated
words' ids joined. A bounded per-worker cache maps word to ids; words outside the plain range go through the library.
Files whose pipeline lacks that property are encoded whole by the library.
"""

from __future__ import annotations

import json
import re
from array import array

#: words a cache generation holds; about 200 bytes each, two generations of two caches a worker
CACHE_WORDS = 150_000
_LOADED: dict[tuple[str, int], "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def loaded(path: str, cache_words: int = CACHE_WORDS) -> "WordEncoder":
    """One encoder a worker process, file and cache size; its cache outlives a task."""
    key = path, cache_words
    if key not in _LOADED:
        _LOADED[key] = WordEncoder(path, cache_words)
    return _LOADED[key]


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """word -> ids as little-endian unsigned 32-bit integers. When full it becomes the older generation, whose words come back as they are met."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = (split.get("pattern") or {}).get("Regex", "")
        self.by_word = split.get("behavior") == "Removed" and bool(split.get("invert")) and pattern.endswith(r"[^\s\p{L}\p{N}]+") and spec["model"].get("end_of_word_suffix") == "</w>"
        self.pattern = regex.compile(pattern) if self.by_word else None
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.tokens_by_id = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.decoder_is_plain = spec.get("decoder") is None
        self.words = _Cache(self._word, cache_words)
        self.parts = _Cache(self._part, cache_words)
        self._odd = re.compile("[\x1c-\x1f]")

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one part, and no special token is all letters
            low = word.lower()
            return self._part(word) if low == word else self.parts[low]  # the word's own entry is enough
        if word.isprintable() and max(word) < "ƀ" and not any(s in word for s in self.specials):  # below U+0300 NFC changes nothing
            return b"".join(map(self.parts.__getitem__, self.pattern.findall(word.lower())))
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if not self.by_word:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        words = re.split("[ \t\n\r]+", text.strip(" \t\n\r")) if self._odd.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words)) if words != [""] else b""

    def decode_bytes(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        values = memoryview(ids).cast("I")
        if self.decoder_is_plain:
            return " ".join(map(self.tokens_by_id.__getitem__, values))
        return self.library.decode(list(values), skip_special_tokens=False)
