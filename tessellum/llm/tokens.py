"""Token ids of whole texts by the tokenizers library, with a memo of the pieces between spaces."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator


#: Distinct pieces that a worker remembers; beyond them it forgets those it met last (about 200 MB).
MEMO = 800_000
_LOADED: dict[str, Encoder] = {}


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files have `name`; looked up where it is called."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it shows, else the next free one from 256 on."""
    shows = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shows]
    return {b: chr(b) for b in shows} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """Ids equal to those of ``Tokenizer.encode(text, add_special_tokens=False)`` on the whole text.

    Where the pre-tokenizer surely splits, a text may be cut and its pieces be encoded apart, so a
    piece met before needs no work. A byte-level vocabulary splits before a space, and on either side
    of a line end, that stands between two characters that are not white space; one that drops white
    space splits at every space. Anything else stays together in one piece. A word of letters alone
    is a single pre-token, so it goes straight to the library's model. A special token's string in a text
    gives its id, as in that call; with specials_as_text it is ordinary text.
    """

    def __init__(self, path: str, *, specials_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        added = self.tokenizer.get_added_tokens_decoder()
        if specials_as_text:
            added = {n: t for n, t in added.items() if not t.special}
        self.specials = {t.content: array("I", [n]).tobytes() for n, t in added.items()}
        #: Cuts a text at added tokens, which the library takes out first; None where they do more than that.
        plain = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.cuts = re.compile(f"({'|'.join(map(re.escape, sorted(self.specials, key=len, reverse=True)))})") if plain and added else None
        self.model = self.tokenizer.model
        same = lambda a, b: self.tokenizer.encode(a, add_special_tokens=False).ids == self.tokenizer.encode(b, add_special_tokens=False).ids
        self.drops_space, self.lowers = same("a  a \n", "a a"), same("A", "a")
        self.letters = byte_letters()
        self.line_end = self._ids("\n")
        self.stops = {c: self._ids(c) for c in ".,"}
        self.memo = _Memo(self._piece)
        self.after_space = self.memo if self.drops_space else _Memo(lambda word: self._piece(f" {word}"))

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece; a word of letters, with no more than a space before and a stop after it, goes to the model."""
        end, whole = b"", piece
        if piece[-1:] in self.stops:
            end, piece = self.stops[piece[-1]], piece[:-1]
        word = piece[1:] if piece[:1] == " " else piece
        if end and word.isascii() and word.isalpha():  # most likely met without the stop
            return (self.memo[piece] if word is piece else self.after_space[word]) + end
        if not word.isalpha():
            return self._ids(whole)
        if self.lowers:
            if not word.isascii():
                piece = word.lower()
                if not unicodedata.is_normalized("NFC", word) or "Σ" in word or not piece.isalpha() or not unicodedata.is_normalized("NFC", piece):
                    return self._ids(whole)
            piece = word.lower()
        if not piece.isascii() or piece[:1] == " ":
            piece = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes() + end

    def _apart(self, text: str) -> Iterator[bytes]:
        """Ids of a text in which white space stands at awkward places."""
        held = ""
        for i, part in enumerate(text.split(" ")):  # a piece begins only where both neighbours of the space are no white space
            if i and part and not part[0].isspace() and held and not held[-1].isspace():
                yield self.memo[held]
                held = f" {part}"
            else:
                held = part if not i else f"{held} {part}"
        yield self.memo[held]

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null: none."""
        if not text:
            return b""
        if self.cuts is None and self.specials:
            return self._ids(text)
        if any(special in text for special in self.specials):
            return b"".join(self.specials.get(part) or self.ids(part) for part in self.cuts.split(text))
        get = self.after_space.__getitem__
        if self.drops_space:
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        if awkward(text):
            return b"".join(self._apart(text))
        out: list[bytes] = []
        for line in text.split("\n"):
            words = iter(line.split(" "))
            out.append(self.memo[next(words)])
            out.extend(map(get, words))
            out.append(self.line_end)
        return b"".join(out[:-1])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        out = [self.ids(t) for t in texts]
        self.memo.shorten()
        self.after_space.shorten()
        return out


class _Memo(dict):
    """Remembers what a function gave for a key."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        self[key] = ids = self.make(key)
        return ids

    def shorten(self) -> None:
        if len(self) > MEMO:
            for key in list(self)[MEMO // 2 :]:
                del self[key]


def awkward(text: str) -> bool:
    """Whether a space or a line end has white space beside it, or there is other white space, by Python or the patterns."""
    return text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(c in text for c in _PAIRS) or not text.isascii() and bool(_WIDE.search(text))


_PAIRS = ("  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_WIDE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
