"""Whole-text encoding with public tokenizer files, by cached chunks.

Between two single spaces a byte-level or word-level pre-tokenizer never makes a piece that crosses the space, so each
space-delimited chunk has its ids whatever stands beside it. Chunks are encoded by the tokenizers library and kept in a
cache per Python worker; in texts with runs of white space, or white space at either end, only a single space between
two other characters ends a chunk. Nothing is put into a text to part it, so a text may hold any character.

Strings of special tokens in a text become what the library makes of them: the special token's id by default, ordinary
text with `specials_are_text`. A null or empty text has no ids; a text of any length is encoded whole.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Chunks kept per worker in each of two generations; the older one goes when the newer is full. It bounds memory only.
CACHE = 300_000
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_SINGLE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: Characters for which the piece pattern below gives the pre-tokenizers' pieces.
_PLAIN = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")
_BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+")
#: Most chunks: letters, perhaps with a few signs behind them, which are one piece, or two.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


#: What the byte-level alphabet writes for a space, and whether this machine's numbers are laid out as the files want them.
_SPACE, _LITTLE = _byte_letters()[32], sys.byteorder == "little"


class _Cache(dict):
    """Ids by chunk. A missing chunk is taken from the older generation or encoded."""

    def __init__(self, encode) -> None:
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.encode(chunk)
        self[chunk] = found
        return found

    def turn(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class Encoder:
    """ids(text): the tokenizer's ids without added special tokens, as little-endian unsigned numbers of `width` bytes."""

    def __init__(self, path: str, specials_are_text: bool = False) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_are_text
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.letters = _byte_letters()
        self.lower = self.tokenizer.normalizer is not None  # the word-level file lower-cases and drops white space
        added = {} if specials_are_text else self.tokenizer.get_added_tokens_decoder()
        self.specials = sorted((t.content for t in added.values()), key=len, reverse=True)
        #: Such tokens cut a text into parts that the library encodes each by itself.
        self.cutting = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.at_specials = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.known = all(self._plain(s) == self._whole(s) for s in ("Ab cd, 12x", "it's é!", "A" if self.lower else " A\nb"))
        #: Ids of signs behind letters, which are a piece of their own.
        self.signs = _Cache(self._plain)
        #: What the byte-level alphabet writes for letters that take two bytes.
        self.accented = {c: chr(c).encode().decode("latin-1").translate(self.letters) for c in range(192, 256)}
        self.exact = _Cache(self._word if self.lower else self._chunk)
        #: Keys stand behind a single space, unless they begin with a line feed.
        self.spaced = _Cache(self._word)

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes() if _LITTLE else struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _word(self, chunk: str) -> bytes:
        """A chunk behind a single space, or a word-level one."""
        if self.known and (m := _SIMPLE.fullmatch(chunk)):
            letters, signs = m.groups()
            letters = letters.lower() if self.lower else _SPACE + letters
            if not chunk.isascii():
                letters = letters.translate(self.accented)
            return self._pack([t.id for t in self.model.tokenize(letters)]) + self.signs[signs]
        return self._chunk(chunk if self.lower or chunk[0] == "\n" else " " + chunk)

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> bytes:
        pieces = _WORD_PIECES.findall(text.lower()) if self.lower else _BYTE_PIECES.findall(text)
        tokenize, ids = self.model.tokenize, []
        for p in pieces:
            if not p.isascii():
                p = p.encode().decode("latin-1").translate(self.letters)
            elif p[0] in " \n":
                p = p.translate(self.letters)
            ids += [t.id for t in tokenize(p)]
        return self._pack(ids)

    def _chunk(self, text: str) -> bytes:
        return self._plain(text) if self.known and _PLAIN.fullmatch(text) else self._whole(text)

    def ids(self, text: str | None) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """ids() of each text; for a list of about a megabyte it takes the least time."""
        parts = [self._parts(t) for t in texts]
        for cache in (self.exact, self.spaced, self.signs):
            cache.turn()
        exact, spaced = self.exact.__getitem__, self.spaced.__getitem__
        return [b"".join([p[2] + b"".join(map(exact, p[0])) + b"".join(map(spaced, p[1])) for p in of]) for of in parts]

    def _parts(self, text: str | None) -> list[tuple[list[str], list[str], bytes]]:
        """(chunks, chunks behind single spaces, ids that stand before both) of what special tokens leave of a text."""
        if not text:
            return []
        if not any(s in text for s in self.specials):
            return [self._between(text)]
        if not self.cutting:
            return [([], [], self._whole(text))]
        return [([], [], self._whole(p)) if p in self.specials else self._between(p) for p in self.at_specials.split(text) if p]

    def _between(self, text: str) -> tuple[list[str], list[str], bytes]:
        words = text.split()
        if self.lower:
            # what is white space for split() alone doesn't part words
            return ([], [], self._whole(text)) if _ODD_SPACE.search(text) else (words, [], b"")
        lines, gaps = text.count("\n"), len(words) - 1
        if words and gaps == text.count(" ") + lines and gaps + sum(map(len, words)) == len(text):
            if lines:
                words = text.replace("\n", " \n").split(" ")
            return words[:1], words[1:], b""
        return _SINGLE_SPACE.split(text), [], b""


def groups(texts: Iterable[str | None], size: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts in turn, in lists of about `size` characters or of one longer text."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


@lru_cache(maxsize=2)
def encoder(path: str, specials_are_text: bool = False) -> Encoder:
    return Encoder(path, specials_are_text)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    return public_tokenizers.path(name)
