"""Token ids of whole texts by a public tokenizer file; the path is a parameter and no file is copied."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np

#: White space beside a space or line feed, or one of these at an end: there word-wise encoding could differ.
_ODD_SPACE = re.compile(r"\s[ \n]|[ \n]\s|^\n|[ \n]\Z")
#: All white space but the space and the line feed.
_RARE_SPACE = [chr(c) for c in range(0x3001) if chr(c) not in " \n" and re.match(r"\s", chr(c))]
YOUNG_WORDS = 300_000
#: A mark that ends a word and is a piece of its own.
_MARKS = frozenset(".,;:!?")
_encoders: dict[tuple[str, bool], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte that is no printable character of Latin-1."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


_LETTERS = _byte_letters()


def odd_spacing(text: str) -> bool:
    """Whether _ODD_SPACE occurs in a text (not empty); the pattern itself runs only where rare white space occurs."""
    if text[0] == "\n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    rare = _RARE_SPACE[:8] if text.isascii() else _RARE_SPACE
    return any(x in text for x in rare) and bool(_ODD_SPACE.search(text))


class Encoder:
    """Encodes texts of a byte-level BPE whose pre-tokenizer never joins a space to the characters before it.

    Such an encoding is the concatenation of the encodings of the text's words, each with the space before it,
    so words are encoded once per worker and then looked up. A word of letters, alone or before one mark, is one piece of
    the pre-tokenizer (and the mark another), so the file's model splits it directly. Texts with odd spacing are encoded whole.
    The strings of special tokens are ordinary text if ``special_as_text``; else texts that hold an added token are encoded
    whole, by the file as it is.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [x.content for x in added if not (special_as_text and x.special)]
        self.split = self.tokenizer.model.tokenize
        self.code = [struct.pack("<I", k) for k in range(self.tokenizer.get_vocab_size())].__getitem__
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = dict(zip(sorted(_MARKS), self.whole(sorted(_MARKS))))
        (self.line,) = self.whole(["\n"])
        (by_model,), (by_file,) = [self.piece(" caf\u00e9")], self.whole([" caf\u00e9"])
        self.direct = by_model == by_file and len(self.line) == 4

    def whole(self, texts: list[str]) -> list[bytes]:
        found = (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

    def apart(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids; words are encoded together, a line feed between them, which is one id of its own."""
        plain = [x for x in words if x and not x[-1].isspace() and not x[1:2].isspace() and (x[0] == " " or not x[0].isspace())]
        taken, line = set(plain), struct.unpack("<I", self.line)[0] if len(self.line) == 4 else None
        if line is None:
            plain, taken = [], set()
        for at in range(0, len(plain), 20000):
            some = plain[at : at + 20000]
            parts = [some[k : k + 200] for k in range(0, len(some), 200)]
            found = self.tokenizer.encode_batch_fast(["\n".join(part) for part in parts], add_special_tokens=False)
            for part, encoding in zip(parts, found):
                ids = np.array(encoding.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == line)
                if len(cuts) != len(part) - 1:  # a word holds a line feed's id
                    yield from zip(part, self.whole(part))
                    continue
                raw, start = ids.tobytes(), 0
                for x, end in zip(part, [*(4 * cuts).tolist(), 4 * len(ids)]):
                    yield x, raw[start:end]
                    start = end + 4
        rest = [x for x in words if x not in taken]
        yield from zip(rest, self.whole(rest))

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer."""
        letters = piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
        return b"".join([self.code(x.id) for x in self.split(letters)])

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet; one that begins a line starts with its line feed."""
        rest = []
        for word in words:
            known = self.old.get(word)
            if known is not None:
                self.young[word] = known
                continue
            line = word[:1] == "\n"
            letters, mark = (word[1:] if line else word), b""
            if letters[-1:] in self.marks:
                letters, mark = letters[:-1], self.marks[letters[-1]]
                known = self.young.get(f"\n{letters}" if line else letters)
                if known is not None and letters.isalpha():
                    self.young[word] = known + mark
                    continue
            # letters beyond U+0530 are left to the file's own pattern, whose Unicode version may be another
            if self.direct and letters.isalpha() and (letters.isascii() or max(letters) < "\u0530"):
                self.young[word] = (self.line + self.piece(letters) if line else self.piece(" " + letters)) + mark
            else:
                rest.append(word)
        lines, spaced = [x[1:] for x in rest if x[:1] == "\n"], [" " + x for x in rest if x[:1] != "\n"]
        self.young.update((x[1:], ids) for x, ids in self.apart(spaced))
        self.young.update(("\n" + x, self.line + ids) for x, ids in self.apart(lines))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text is empty."""
        if len(self.young) > YOUNG_WORDS:
            self.old, self.young = self.young, {}
        get, out, odd, open_ = self.young.get, [b""] * len(texts), [], []
        fresh: set[str] = set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if odd_spacing(text) or any(x in text for x in self.added):
                odd.append(i)
                continue
            words = f"\n{text}".replace("\n", " \n").split(" ")[1:]  # as if the text were a line
            found = [*map(get, words)]
            missing = [k for k, ids in enumerate(found) if ids is None]
            if missing:
                fresh.update([words[k] for k in missing])
                open_.append((i, found, [(k, words[k]) for k in missing]))
            else:
                out[i] = b"".join(found)[len(self.line) :]
        self.learn(fresh)
        for i, found, missing in open_:
            for k, word in missing:
                found[k] = self.young[word]
            out[i] = b"".join(found)[len(self.line) :]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = ids
        return out


def encoder(path: str, special_as_text: bool = True) -> Encoder:
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
