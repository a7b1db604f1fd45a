"""Fast, exact encoding with the `tokenizers` library.

A text is cut at spaces into chunks that the tokenizer would treat on their own
anyway, and each distinct chunk is encoded once per worker. The rules that make
the cuts safe are in `_ByteChunks` and `_WordChunks`; a text to which they do not
apply is given to the library whole.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

from tokenizers import Tokenizer

from wattloom.llm.common import hold

#: Punctuation that both pre-tokenizers separate from a letter or digit before it.
_TAIL = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: No mark can join what follows such a character: ASCII letters and digits, and the Latin-1 letters.
_ENDS_WORD = frozenset(c for c in map(chr, range(256)) if c.isascii() and c.isalnum() or c >= "À" and c not in "×÷")
#: A space between two other white-space characters belongs to neither neighbour.
_SPACE_RUN = re.compile(r"\s \s").search
#: Chunks of one cache generation, unless the caller asks for fewer; two are held, about 200 bytes a chunk.
GENERATION = 500_000


class _Cache(dict):
    """chunk -> ids as little-endian uint32 bytes; holds two generations at most."""

    def __init__(self, encode, generation: int):
        super().__init__()
        self._encode, self._old, self._generation = encode, {}, generation

    def __missing__(self, chunk: str) -> bytes:
        found = self._old.get(chunk)
        if found is None:
            found = self._encode(chunk)
        if len(self) >= self._generation:
            self._old = dict(self)
            self.clear()
        self[chunk] = found
        return found


#: Formats of short lists, made once.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _u32(ids: list[int]) -> bytes:
    n = len(ids)
    return _PACK[n](*ids) if n < 64 else struct.pack(f"<{n}I", *ids)


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte (as Latin-1) in byte-level BPE, from its rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """ids(text) -> bytes of little-endian uint32 ids, equal to the library's own."""

    def __init__(self, path: str, generation: int = GENERATION):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenize, self._symbols = self._tokenizer.model.tokenize, _byte_symbols()
        pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
        added = [t["content"] for t in config.get("added_tokens", [])]
        self._special = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.ids = self._by_byte_chunks
            self._newline = self._whole("\n")
            self._spaced, self._bare = _Cache(lambda c: self._byte_chunk(c, " "), generation), _Cache(lambda c: self._byte_chunk(c, ""), generation)
        elif [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and config["model"].get("end_of_word_suffix"):
            self.ids = self._by_words
            self._words = _Cache(self._word_chunk, generation)
        else:
            self.ids = self._whole

    def _whole(self, text: str) -> bytes:
        return _u32(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _as_bytes(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self._symbols)

    # Byte level: a pre-token takes at most one space, the one before it. So a cut before a
    # space is safe unless white space lies on both sides of that space.
    def _by_byte_chunks(self, text: str) -> bytes:
        if _SPACE_RUN(text) or self._special(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return (self._bare[first] if first else b"") + b"".join(map(self._spaced.__getitem__, rest))

    def _byte_chunk(self, chunk: str, lead: str) -> bytes:
        if chunk.isalpha():  # the usual case, judged first
            if chunk.isascii():
                return _u32([t.id for t in self._tokenize("Ġ" + chunk if lead else chunk)])
            if _LATIN(chunk):
                return _u32([t.id for t in self._tokenize(self._as_bytes(lead + chunk))])
            return self._whole(lead + chunk)
        cache = self._spaced if lead else self._bare
        if "\n" in chunk:
            lines = chunk.split("\n")
            if all(x.split() == [x] for x in lines):  # single line ends between words are tokens of their own
                newline = self._newline
                return cache[lines[0]] + b"".join(newline + self._bare[x] for x in lines[1:])
        core = chunk.rstrip(_TAIL)
        if core and core != chunk and core[-1] in _ENDS_WORD:
            return cache[core] + self._bare[chunk[len(core):]]
        return self._whole(lead + chunk)

    # Lower-cased words: white space only separates and gives no id.
    def _by_words(self, text: str) -> bytes:
        if self._special(text):
            return self._whole(text)
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))

    def _word_chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # the usual case, judged first
            low = chunk.lower()
            if not _LATIN(chunk):
                return self._whole(chunk)
            if low != chunk:
                return self._words[low]
            return _u32([t.id for t in self._tokenize(low if low.isascii() else self._as_bytes(low))])
        if not chunk:
            return b""
        core = chunk.rstrip(_TAIL)
        if core and core != chunk and core[-1] in _ENDS_WORD:
            return self._words[core] + self._words[chunk[len(core):]]
        return self._whole(chunk)


@lru_cache(maxsize=1)
def _encoder(path: str, generation: int) -> Encoder:
    return Encoder(path, generation)


def encoder(path: str, generation: int = GENERATION) -> Encoder:
    """One encoder per worker process, file and size of cache, as long as no other operator needs the room."""
    hold(f"tokens {path} {generation}", _encoder.cache_clear)
    return _encoder(path, generation)
