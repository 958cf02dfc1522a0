"""Token ids of whole texts, by the tokenizers library.

Both public vocabularies cut a text at white space before any merge, so the ids of a text are the
ids of its pieces in order. Natural text repeats pieces; a bounded memo of piece -> ids saves most
merges. Texts with white space other than space, TAB, CR and LF are encoded whole, since the
libraries do not agree on what else is white space.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np

ODD_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
#: A run of white space belongs to the word behind it.
SPACED = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")


#: Signs that both pre-tokenizers keep apart from letters before them (no apostrophe: it may bind).
SIGNS = ".,;:!?*$%&#()-"
#: Byte-level vocabularies write a byte as a character: printable Latin-1 as itself, the others from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


class Memo(dict):
    """A dictionary that finds what it lacks with ``find``."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.find(key)
        return found


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    A new piece that is letters with ASCII signs behind them is two pre-tokens. Its letters go
    straight to the tokenizer's model, which skips the costly normalisation of a whole text;
    anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str, memo: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # control strings in a text are plain text
        self.id_bytes = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        #: Whether white space leaves no trace in the ids.
        self.drops_space = self._ids(" b") == self._ids("b")
        self.limit, self.signs = memo, Memo(self._ids)
        before = "" if self.drops_space else BYTE_CHARS[32]
        #: Ids of letters alone and of letters behind a space; None if the model may not be asked directly.
        self.letters, self.spaced_letters = Memo(self._letters), Memo(lambda w: self._letters(w, before))
        self.pieces, self.behind_space = Memo(self._piece), Memo(self._behind_space)
        self.memos = (self.letters, self.spaced_letters, self.pieces, self.behind_space)

    def _ids(self, text: str) -> bytes:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.asarray(found.ids, dtype="<u4").tobytes()

    def _letters(self, word: str, before: str = "") -> bytes | None:
        letters = word.lower() if self.drops_space else word
        if not word.isascii():
            if "\u03a3" in word or not unicodedata.is_normalized("NFC", word) or not letters.isalpha():
                return None
            letters = letters.encode().decode("latin-1").translate(BYTE_CHARS)
        of = self.id_bytes
        return b"".join([of[t.id] for t in self.tokenizer.model.tokenize(before + letters)])

    def _piece(self, piece: str) -> bytes:
        """Ids of a word with any white space before it."""
        word = piece.rstrip(SIGNS)
        if word.isalpha():
            found = self.letters[word]
            if found is not None:
                return found + self.signs[piece[len(word) :]] if len(word) < len(piece) else found
        return self._ids(piece)

    def _behind_space(self, piece: str) -> bytes:
        """Ids of a word with one space before it, or of a line feed and the word behind it."""
        if piece[0] == "\n":  # before a word, one line feed is a pre-token of its own
            return self._ids(piece) if piece[1].isspace() else self.signs["\n"] + self._piece(piece[1:])
        word = piece.rstrip(SIGNS)
        if word.isalpha():
            found = self.spaced_letters[word]
            if found is not None:
                return found + self.signs[piece[len(word) :]] if len(word) < len(piece) else found
        return self._ids(" " + piece)

    def _text(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self._ids(text)
        if self.drops_space:
            return b"".join(map(self.pieces.__getitem__, text.split()))
        cut = text.replace("\n", " \n").split(" ")
        if "" in cut or "\n" in cut or "\t" in text or "\r" in text:  # longer white space, or at an end
            return b"".join(map(self.pieces.__getitem__, SPACED.findall(text)))
        return self.pieces[cut[0]] + b"".join(map(self.behind_space.__getitem__, cut[1:]))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        out = []
        for t in texts:
            if sum(map(len, self.memos)) > self.limit:
                for memo in self.memos:
                    memo.clear()
            if len(self.signs) > 10_000:
                self.signs.clear()
            out.append(self._text(t or ""))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def in_slices(texts: list, most_chars: int = 2_000_000):
    """Index ranges of neighbouring texts of a bounded size together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
