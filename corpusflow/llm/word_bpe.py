"""BPE encoding and decoding with tree concatenation for long unsplit text.

A text is normalised and cut into pre-tokens. A pre-token of ordinary length is
encoded by the tokenizers library once and kept in a bounded cache. A long one
(no white space or change of character class for `LONG` characters, as in
scripts that write without spaces) is cut in leaves which one batch call
encodes in parallel; neighbours are then concatenated pairwise, level by level.
At each join a window of tokens on both sides is encoded anew, and grows until
its first and last token are those that stood there before. A sequence is the
encoding of its text exactly if each adjacent pair is, so that agreement at
both ends makes the whole exact.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable
from itertools import chain
from struct import pack

import numpy as np
from tokenizers import Tokenizer

#: Characters from which a pre-token counts as long, and of one leaf.
LONG, LEAF = 24, 12
#: Words, and pre-tokens, kept by one worker.
CACHE = 200_000

_LATIN = [chr(c) for c in range(0x180)]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == kind)


_LETTER, _NUMBER = _class("L"), _class("N")
_SPACE = r"\t-\r \x85\xa0"  # what str.split() separates at below U+0180, but for U+001C-U+001F
#: The tokenizer's own pattern, over the letters and numbers below U+0180.
_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: Characters whose class, composition or lower case is left to the library.
_OTHER = re.compile("[^\x00-\x1b\x20-įı-ſ]")


class WordBpe:
    """Exact ids of a tokenizers file that has a word-end suffix."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, cache: int = CACHE):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        spec["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(spec))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self._shown = dict(enumerate(_byte_chars()))
        self._bytes_of = {c: b for b, c in enumerate(_byte_chars())}
        self.long, self.leaf, self.limit = long, leaf, cache
        self.cache: dict[str, bytes] = {}  # ids of pre-tokens
        self.words: dict[str, bytes] = {}  # and of words between white space

    def pretokens(self, text: str) -> list[str]:
        """The strings that BPE sees, of a text in any script."""
        if not _OTHER.search(text):
            return _PATTERN.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null as empty."""
        if not text:
            return b""
        if self._split is None or "<" not in text:
            return self._encode_segment(text)
        out = []
        for part in self._split.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.append(self._encode_segment(part))
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """As decode(ids, skip_special_tokens=False) without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def decode_bytes(self, ids: bytes) -> str:
        return self.decode(np.frombuffer(ids, "<u4").tolist())

    def _encode_segment(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self._encode_pretokens(self.pretokens(text))
        # No pre-token crosses white space, so that whole words can be kept too.
        words = text.lower().split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            pass
        if len(self.words) > self.limit:
            self.words.clear()
        missing = [w for w in dict.fromkeys(words) if w not in self.words]
        cut = [_PATTERN.findall(w) for w in missing]
        self._learn(chain.from_iterable(cut))
        for w, parts in zip(missing, cut, strict=True):
            if len(w) < self.long:
                self.words[w] = b"".join(map(self.cache.__getitem__, parts))
        # Only now: this may clear the cache, which the words above are read from.
        own = {w: self._encode_pretokens(parts) for w, parts in zip(missing, cut, strict=True) if len(w) >= self.long}
        if not own:
            return b"".join(map(self.words.__getitem__, words))
        return b"".join(own[w] if w in own else self.words[w] for w in words)

    def _learn(self, words: Iterable[str]) -> None:
        """Cache the pre-tokens of ordinary length."""
        if len(self.cache) > self.limit:
            self.cache.clear()
        short = [w for w in dict.fromkeys(words) if w not in self.cache and len(w) < self.long]
        tokenize, shown = self.tokenizer.model.tokenize, self._shown
        for w in short:  # normalised and cut already: only the merges are left
            i = [t.id for t in tokenize(w.encode().decode("latin-1").translate(shown))]
            self.cache[w] = pack(f"<{len(i)}I", *i)

    def _encode_pretokens(self, words: list[str]) -> bytes:
        self._learn(words)
        own = {w: np.array(self.encode_long(w), "<u4").tobytes() for w in set(words) if len(w) >= self.long}  # not kept: so long a run hardly repeats
        return b"".join(own[w] if w in own else self.cache[w] for w in words)

    def encode_long(self, word: str) -> list[int]:
        """Tree concatenation over one pre-token."""
        leaves = [word[i : i + self.leaf] for i in range(0, len(word), self.leaf)]
        parts = [list(e.ids) for e in self.inner.encode_batch_fast(leaves[:-1], add_special_tokens=False)]
        parts.append(list(self.tokenizer.encode(leaves[-1], add_special_tokens=False).ids))
        while len(parts) > 1:
            last = len(parts) - 2
            parts = [self._concatenate(parts[i], parts[i + 1], i >= last) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def bytes_of(self, token: int) -> bytes:
        """What a token stands for."""
        return bytes(map(self._bytes_of.__getitem__, self.tokens[token].removesuffix("</w>")))

    def _symbols(self, ids: Iterable[int]) -> bytes:
        return bytes(map(self._bytes_of.__getitem__, chain.from_iterable(self.tokens[i].removesuffix("</w>") for i in ids)))

    def _concatenate(self, left: list[int], right: list[int], ends_word: bool) -> list[int]:
        size = 4
        while True:
            a, b = left[-size:], right[:size]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            window = self._encode_symbols(self._symbols(a + b), ends_word and whole_right)
            if window is not None and (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            size *= 2

    def _encode_symbols(self, raw: bytes, ends_word: bool) -> list[int] | None:
        """None where the window cuts a character, which a wider one mends."""
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
        return list((self.tokenizer if ends_word else self.inner).encode(text, add_special_tokens=False).ids)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_OPEN: dict[tuple, WordBpe] = {}


def opened(path: str, **options) -> WordBpe:
    """The encoder of this worker, made once."""
    # The leaves of one batch call are encoded by two threads: what a worker may use besides its JVM.
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    key = (path, *sorted(options.items()))
    if key not in _OPEN:
        _OPEN[key] = WordBpe(path, **options)
    return _OPEN[key]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
