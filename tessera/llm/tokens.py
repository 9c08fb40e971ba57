"""Token ids of whole texts, by a public tokenizer that is read and never trained."""

from __future__ import annotations

import os
import re
import sys
import unicodedata

import numpy as np

#: ASCII marks but `<`, with which the special tokens begin.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "<")
#: Words of these letters alone are one pre-token each and their own normal form.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def byte_letters() -> str:
    """The characters by which byte-level tokenizers name the bytes: printable ones by themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


_BYTES = byte_letters()


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


class WordEncoder:
    """Encodes texts with a `tokenizers` file whose pre-tokenizer drops white space, so that the
    ids of a text are those of its white-space separated words, joined. Each distinct word is
    encoded once and kept, up to `most_words` of them; ids come as little-endian uint32 bytes.
    """

    LONG = 64

    def __init__(self, path: str, most_words: int = 600_000, chunk: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer, self.most_words, self.chunk = Tokenizer.from_file(path), most_words, chunk
        self.known: dict[bytes, bytes] = {}  # words, their stems and marks
        self.as_bytes = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    def _learn(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        at = np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(e.ids))
        cut = np.searchsorted(at, starts)  # ids come in text order
        ids = np.asarray(e.ids, dtype="<u4").tobytes()
        for k, w in enumerate(words):
            into[w] = ids[4 * cut[k] : 4 * cut[k + 1]]

    @staticmethod
    def _halves(word: bytes) -> tuple[bytes, bytes]:
        """The stem and the marks that give the word's ids one after the other: the tokenizer lower-cases, and
        parts a run of marks from the letters and digits before it. Its special tokens begin with `<`."""
        stem = word.rstrip(_MARKS)
        if not (stem[-1:].isalnum() or stem[-2:-1] == b"\xc3" and stem[-1] not in b"\x97\xb7") or b"<" in word:
            return word, b""
        return stem.lower() if stem.isascii() else stem, word[len(stem) :]

    def _learn_words(self, words: set[bytes]) -> None:
        """Letters alone go to the model as the one pre-token that they are, other words through the whole tokenizer."""
        known, as_bytes, one = self.known, self.as_bytes, self.tokenizer.model.tokenize
        mixed, halves = [], []
        for w in words:
            if w.isalpha():  # of ASCII letters
                stem, marks = w.lower(), b""
            else:
                stem, marks = self._halves(w)
                if marks and marks not in known:
                    self._learn([marks], known)
            if stem not in known:
                if stem.isalpha():
                    letters = stem.decode()
                else:
                    letters = stem.decode("utf-8", "replace").lower()
                    letters = "".join(map(_BYTES.__getitem__, letters.encode())) if _LETTERS.fullmatch(letters) else None
                if letters is None:
                    mixed.append(stem)
                    halves.append((w, stem, marks))
                    continue
                known[stem] = b"".join([as_bytes[t.id] for t in one(letters)])
            if stem is not w:
                known[w] = known[stem] + known[marks] if marks else known[stem]
        for k in range(0, len(mixed), self.chunk):
            self._learn(mixed[k : k + self.chunk], known)
        for w, stem, marks in halves:
            known[w] = known[stem] + known[marks] if marks else known[stem]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        held = set().union(*split)
        new = held.difference(self.known)
        if len(self.known) + len(new) > self.most_words:
            self.known = {w: self.known[w] for w in held.difference(new)}
        long = {w for w in new if len(w) > self.LONG}  # not kept
        self._learn_words(new - long)
        if not long:
            return [b"".join(map(self.known.__getitem__, words)) for words in split]
        rare: dict[bytes, bytes] = {}
        for w in long:
            self._learn([w], rare)
        return [b"".join(rare[w] if w in rare else self.known[w] for w in words) for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, which keeps its words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


#: White space as the byte-level pre-tokenizer means it, and the endings that it parts from a word.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ENDINGS = "'(?:[stmd]|re|ve|ll)"


def _ranges(majors: str, begin: int = 0, end: int = 1 << 16) -> str:
    """A character class's inside: the characters from begin to before end whose category begins with one of `majors`."""
    out, first = [], None
    for k in range(begin, end + 1):
        in_it = k < end and unicodedata.category(chr(k))[0] in majors
        if in_it and first is None:
            first = k
        elif not in_it and first is not None:
            out.append(f"\\U{first:08x}-\\U{k - 1:08x}")
            first = None
    return "".join(out)


class ByteEncoder:
    """Encodes texts with a byte-level `tokenizers` file. A text's ids are those of its pre-tokens, joined: each distinct
    one is encoded once and kept, up to `most_words` of them. Texts that hold a special token, characters without a
    category here, or letters and numbers beyond U+FFFF (whose ranges would slow the pattern) go whole through the
    tokenizer. Ids come as little-endian bytes of `width`."""

    LONG = 64

    def __init__(self, path: str, width: int = 4, most_words: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.most_words = Tokenizer.from_file(path), width, most_words
        letters, numbers = _ranges("L"), _ranges("N")
        marks = f"[^{_SPACES}{letters}{numbers}]+"
        self.parts = re.compile(f"{_ENDINGS}| ?[{letters}]+| ?[{numbers}]+| ?{marks}|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+").findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.as_bytes = [k.to_bytes(width, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.high = re.compile("[^\x00-\u024f]").search
        self.rare = re.compile(f"[{_ranges('C', 0x250)}{_ranges('CLN', 1 << 16, sys.maxunicode + 1)}]").search
        self.known: dict[str, bytes] = {}

    def _learn(self, parts: set[str], into: dict[str, bytes]) -> None:
        """A pre-token goes to the model by the characters that name its bytes."""
        one, as_bytes = self.tokenizer.model.tokenize, self.as_bytes
        for part in parts:
            plain = part.isascii() and part.isprintable()
            letters = part.replace(" ", _BYTES[32]) if plain else "".join(map(_BYTES.__getitem__, part.encode()))
            into[part] = b"".join([as_bytes[t.id] for t in one(letters)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif any(t in text for t in self.special) or self.high(text) and self.rare(text):
                out.append(b"".join(map(self.as_bytes.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids)))
            else:
                out.append(self._join(self.parts(text)))
        return out

    def _join(self, parts: list[str]) -> bytes:
        known, rare = self.known, {}
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        held = set(parts)
        new = held.difference(known)
        if len(known) + len(new) > self.most_words:
            self.known = known = {w: known[w] for w in held.difference(new)}
        long = {w for w in new if len(w) > self.LONG}  # not kept
        self._learn(new - long, known)
        self._learn(long, rare)
        return b"".join([rare[w] if w in rare else known[w] for w in parts])


_BYTE_ENCODERS: dict[tuple[str, int], ByteEncoder] = {}


def byte_encoder(path: str, width: int = 4) -> ByteEncoder:
    """One encoder for each Python worker, which keeps its pre-tokens from task to task."""
    if (path, width) not in _BYTE_ENCODERS:
        _BYTE_ENCODERS[path, width] = ByteEncoder(path, width)
    return _BYTE_ENCODERS[path, width]
