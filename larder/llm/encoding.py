"""Token ids of whole texts with a public tokenizer file.

``rows`` cuts the plain texts of a column (printable ASCII, line ends and the letters of Latin-1) into words where both
supported pre-tokenizers do: at a change between letters, digits, marks and white space, and after a contraction. A
blank belongs to the word behind it, or is dropped with all white space where letters are lowered. The distinct words
of a chunk are looked up, and one that is not known goes straight to the tokenizer's model.

``blob`` takes any text. Both pre-tokenizers end a piece before a blank that follows a non-blank, so a text is cut
there, each piece is encoded once and looked up afterwards. A text where white space follows a blank is encoded as a
whole, since there a cut could change the ids; so is one that holds ``<|``, which may be a special token of several
pieces. A new piece of plain letters goes straight to the tokenizer's model; full stops and commas between letters are
cut off first.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from larder.llm.common import text_chunks

#: Pieces remembered by one worker, in each of two generations.
REMEMBER = 200_000
#: A blank followed by white space.
_ODD = [" " + c for c in " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SIMPLE = re.compile(rf" ?[{_LETTER}]+(?:[.,]\n?[{_LETTER}]+)*[.,]?\Z")
_LATIN = re.compile(f"[{_LETTER}]+\\Z").match
_PARTS = re.compile(rf" ?[{_LETTER}]+|[.,]|\n")
#: The printable characters that byte-level vocabularies use for the 256 bytes.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_KEPT)))}
_BLANK, _LINE, _ALPHA, _DIGIT, _MARK, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[32:127] = _MARK
_CLASS[[ord(c) for c in "0123456789"]] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), 0xC3]] = _ALPHA  # 0xC3 leads the letters of Latin-1 in UTF-8
_CLASS[[9, 10, 13]] = _LINE
_CLASS[32] = _BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_QUOTE = ord("'")


def _classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte; both bytes of a Latin-1 letter are letters."""
    kind = _CLASS[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    letter = (data[second] != 0x97) & (data[second] != 0xB7)  # the signs of multiplication and division
    kind[second] = np.where(letter, _ALPHA, _OTHER)
    return kind


def _lowered(data: np.ndarray) -> np.ndarray:
    out = _LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[second[data[second] < 0x9F]] += 32
    return out


def _contractions(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where contractions begin and end, of the quotes at ``starts``."""
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = padded[starts + 1], padded[starts + 2]
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    found = short | long
    return starts[found], starts[found] + np.where(short, 2, 3)[found]


def _odd(text: str) -> bool:
    """Whether white space follows a blank."""
    for pair in _ODD if not text.isascii() else _ODD[:10]:
        if pair in text:
            return True
    return False


class Encoder:
    """Ids of texts by one tokenizer file; one for each worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.lower = self.tokenizer.normalizer is not None
        self.code = "H" if self.kind is np.uint16 else "I"
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of letters with or without a blank before them."""
        if self.lower:
            word = word.lstrip(" ").lower()
        if word.isascii():
            mapped = "Ġ" + word[1:] if word[0] == " " else word
        else:
            mapped = "".join([_BYTE[b] for b in word.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _learn(self, pieces) -> None:
        new, old = self.new, self.old
        for piece in pieces:
            if piece in old:
                new[piece] = old[piece]
                continue
            core = piece[1:] if piece[:1] == " " else piece
            if core.isalpha() and (core.isascii() or _LATIN(core)):
                new[piece] = self._word(piece)
            elif _SIMPLE.match(piece):
                parts = _PARTS.findall(piece)
                self._learn([p for p in parts if p not in new])
                new[piece] = b"".join([new[p] for p in parts])
            else:
                new[piece] = self._whole(piece)

    def blob(self, text: str | None) -> bytes:
        """Little-endian ids of a text, in the narrowest kind that holds the vocabulary."""
        if not text:
            return b""
        if "\0" in text or "<|" in text or text[-1] == " " or _odd(text):
            return self._whole(text)
        pieces = text.replace(" ", "\0 ").split("\0")
        new = self.new
        missing = set(pieces).difference(new)
        if missing:
            self._learn(missing)
            out = b"".join(map(new.__getitem__, pieces))
            if len(new) > REMEMBER:
                self.old, self.new = new, {}
            return out
        return b"".join(map(new.__getitem__, pieces))

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(self.blob(t), self.kind) for t in texts]

    def _known(self, word: bytes) -> bytes:
        """Ids of one word of a plain text."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.old_words.get(word)
            if ids is None:
                if word.isalpha():
                    mapped = word.decode()
                elif word[:1] == b" " and word[1:].isalpha():
                    mapped = "Ġ" + word[1:].decode()
                else:
                    mapped = "".join([_BYTE[b] for b in word])
                ids = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
            self.words[word] = ids
        return ids

    def _plain(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which rows ``_cut`` may take."""
        bad = kind == _OTHER
        bad[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        if not self.lower:  # white space before white space or at a row's end is cut by other rules
            space = kind <= _LINE
            bad[:-1] |= space[:-1] & space[1:]
            ends = offsets[1:][np.diff(offsets) > 0] - 1
            bad[ends] |= space[ends]
        plain = np.ones(len(offsets) - 1, bool)
        plain[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = False
        return plain

    def _cut(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Words of the rows and the first word of each row, with a closing entry."""
        new = np.ones(len(data), bool)
        new[1:] = kind[1:] != kind[:-1]
        if self.lower:
            new |= kind == _DIGIT
        else:
            new[1:] &= kind[:-1] != _BLANK
        first = offsets[:-1][offsets[:-1] < len(data)]
        new[first] = True
        quotes = np.flatnonzero(new & (data == _QUOTE))
        if len(quotes):
            row_end = offsets[np.searchsorted(offsets, quotes, "right")]
            begin, end = _contractions(data, quotes)
            inside = end <= row_end[np.isin(quotes, begin)]
            new[begin[inside] + 1] = False
            if len(end := end[inside]):
                new[end[end < len(data)]] = True
        at = np.flatnonzero(new)
        if self.lower:  # white space is no word
            at = at[kind[at] > _LINE]
            kept = kind > _LINE
            before = np.concatenate([[0], np.cumsum(kept)])
            words = np.append(before[at], before[-1])
            data = data[kept]
        else:
            words = np.append(at, len(data))
        data = np.ascontiguousarray(data)
        made = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(words.astype(np.int32)), pa.py_buffer(data)])
        return made, np.searchsorted(at, offsets)

    def rows(self, column) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow column; a null has none."""
        size = np.dtype(self.kind).itemsize
        for lo, hi, data, offsets in text_chunks(column):
            kind = _classes(data)
            plain = self._plain(data, offsets, kind)
            if not plain.all():
                kept = np.repeat(plain, np.diff(offsets))
                data, kind = data[kept], kind[kept]
                offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) * plain)])
            words, first = self._cut(_lowered(data) if self.lower else data, offsets, kind)
            coded = words.dictionary_encode()
            found = pa.array([self._known(w) for w in coded.dictionary.to_pylist()], pa.binary()).take(coded.indices)
            ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1][first] // size if len(found) else first
            ids = np.frombuffer(found.buffers()[2], self.kind) if len(found) else np.zeros(0, self.kind)
            for k, (i, own) in enumerate(zip(range(lo, hi), plain.tolist(), strict=True)):
                yield ids[ends[k] : ends[k + 1]] if own else np.frombuffer(self.blob(column[i].as_py()), self.kind)
            if len(self.words) > REMEMBER:
                self.old_words, self.words = self.words, {}
