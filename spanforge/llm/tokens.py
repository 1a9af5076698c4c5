"""Token ids of whole texts by a public tokenizer file, with a bounded cache of what lies between safe borders.

Both files split a text by a pattern before they merge, so pieces between borders that the pattern always respects
can be encoded on their own, once, and their ids joined. Texts that break the assumptions of a split (runs of white
space) are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the cache of a worker: about 150 bytes each.
CACHE_ENTRIES = 1_000_000
#: A border mark that the text itself must not hold.
_MARK = b"\x01"
#: Letters or digits, then marks: a border of every pattern.
_TAIL = re.compile(r"( ?[^\W_]+)([.,;:!?|]+)\Z")
_ENDS = tuple(b".,;:!?|")
#: White space other than single spaces and single line ends, as far as it is ASCII.
_RUNS = (b"  ", b"\n\n", b"\n ", b" \n", b"\t", b"\r", b"\x0b", b"\x0c")
#: New pieces that are encoded as one text, and such texts that are encoded in one call.
_AT_ONCE, _TEXTS = 50, 100
#: A word of ASCII and Latin-1 letters, with a space before it or not: one part to the pattern of byte-level files.
_LATIN_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: The signs that byte-level files have for bytes, and one for the line end between words.
_SIGNS = {b: chr(256 + n) for n, b in enumerate([*range(33), *range(127, 161), 173])} | {0: "\u010a", 10: "\n"}
#: Other white space beside white space.
_WIDE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _classes() -> bytes:
    """Byte classes: a letter or digit of ASCII or Latin-1, white space, full stop or comma (.), other marks (!), further scripts (?)."""
    table = bytearray(b"!" * 128 + b"a" * 64 + b"?" * 64)
    for c in range(128):
        if chr(c).isalnum():
            table[c] = ord("a")
        elif chr(c) in " \t\n\x0b\x0c\r":
            table[c] = ord(" ")
    table[ord(".")] = table[ord(",")] = ord(".")
    table[0xC3] = ord("a")  # the lead byte of Latin-1's letters
    return bytes(table)


_CLASSES = _classes()
#: Kinds of bytes: space or line end; ASCII letter or digit; ASCII mark; what a text with borders must not hold; lead byte of a sign
#: beyond ASCII and Latin-1's letters; second byte of a letter of Latin-1.
_BLANK, _ALNUM, _SIGN, _ODD, _WIDER, _REST = (np.uint8(1 << k) for k in range(6))


def _kinds() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[33:127] = _SIGN
    table[[c for c in range(128) if chr(c).isalnum()]] = _ALNUM
    table[[32, 10]] = _BLANK
    table[[1, 9, 11, 12, 13]] = _ODD
    table[0x80:0xC0] = _REST
    table[[0x97, 0xB7]] = 0  # the signs of multiplication and division
    table[0xC2:] = _WIDER
    table[0xC3] = 0
    return table


_KINDS = _kinds()


class Pieces(dict):
    """piece (UTF-8) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer, entries: int):
        super().__init__()
        self.tokenizer, self.entries = tokenizer, entries

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        text = piece.decode()
        if tail := _TAIL.match(text):
            ids = self[tail[1].encode()] + self[tail[2].encode()]
        else:
            ids = self.whole(text)
        self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Runs:
    """Pieces of many texts at once, where white space counts: their ids in one array, each piece's place there."""

    def __init__(self, pieces: Pieces):
        self.whole, self.entries, self.tokenizer = pieces.whole, pieces.entries, pieces.tokenizer
        self.line_end = np.frombuffer(self.whole("\n"), "<u4")
        self.words = _word_encoder(pieces.tokenizer) if len(self.line_end) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.used = 0
        self.ids, self.start, self.size = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def shorten(self) -> None:
        """Only the pieces that came first stay, a fourth of what is kept at most: frequent ones are mostly among them."""
        self.index = dict(islice(self.index.items(), self.entries // 4))
        n = len(self.index)
        self.used = int((self.start[:n] + self.size[:n]).max(initial=0))

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece; the pieces are distinct."""
        if len(self.index) >= self.entries:
            self.shorten()
        found = list(map(self.index.get, pieces))
        if None in found:
            self._learn([p for p, i in zip(pieces, found, strict=True) if i is None])
            found = [self.index[p] if i is None else i for p, i in zip(pieces, found, strict=True)]
        return np.array(found, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        tails = {p: [part.encode() for part in tail.groups()] for p in new if p and p[-1] in _ENDS and (tail := _TAIL.match(p.decode()))}
        plain = [p for p in dict.fromkeys([*new, *(part for parts in tails.values() for part in parts)]) if p not in tails and p not in self.index] if tails else new
        ascii_words, words, lines, alone = [], [], [], []
        for p in plain:
            if self.words and p.removeprefix(b" ").isalpha():
                ascii_words.append(p)
            elif self.words and _LATIN_WORD.fullmatch(p):
                words.append(p)
            # a line end parts what has no white space but a space that it begins with
            elif len(self.line_end) != 1 or not p or b"\n" in p or p.endswith(b" "):
                alone.append(p)
            else:
                lines.append(p)
        alone += self._learn_joined(ascii_words + words, self.words, _as_words) + self._learn_joined(lines, self.tokenizer, _as_lines)
        for p in alone:
            ids = np.frombuffer(self.whole(p.decode()), "<u4")
            self._add([p], ids, np.zeros(1, np.int64), np.array([len(ids)]))
        for p, parts in tails.items():
            at = [self.index[part] for part in parts]
            ids = np.concatenate([self.ids[self.start[i] : self.start[i] + self.size[i]] for i in at])
            self._add([p], ids, np.zeros(1, np.int64), np.array([len(ids)]))

    def _learn_joined(self, pieces: list[bytes], tokenizer, as_text: Callable[[list[bytes]], str], texts: int = _TEXTS) -> list[bytes]:
        """Takes pieces in, many in a call, their ids parted by a line end's; returns those for which this did not work."""
        left, sep = [], int(self.line_end[0]) if len(self.line_end) else 0
        for i in range(0, len(pieces), _AT_ONCE * texts):
            own = pieces[i : i + _AT_ONCE * texts]
            flat: list[int] = []
            for coded in tokenizer.encode_batch_fast([as_text(own[k : k + _AT_ONCE]) for k in range(0, len(own), _AT_ONCE)], add_special_tokens=False):
                flat += coded.ids
                flat.append(sep)
            ids = np.array(flat, np.uint32)
            ends = np.flatnonzero(ids == sep)
            if len(ends) == len(own):
                self._add(own, ids, np.append(0, ends[:-1] + 1), ends)
            else:
                left += own if texts == 1 else self._learn_joined(own, tokenizer, as_text, 1)
        return left

    def _add(self, pieces: list[bytes], ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        n, used = len(self.index), self.used
        self.ids = _room(self.ids, used + len(ids))
        self.start, self.size = _room(self.start, n + len(pieces)), _room(self.size, n + len(pieces))
        self.ids[used : used + len(ids)] = ids
        self.start[n : n + len(pieces)] = start + used
        self.size[n : n + len(pieces)] = end - start
        self.used += len(ids)
        self.index.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def of(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each text; none for one that has to be encoded whole."""
        joined = b"".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        starts, whole = _starts(np.frombuffer(joined, np.uint8), text_ends, self.words is not None)
        whole = {i for i, wide in whole.items() if not wide or _WIDE.search(texts[i].decode())}
        if whole:
            return [None if i in whole else ids for i, ids in enumerate(self.of([b"" if i in whole else t for i, t in enumerate(texts)]))]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(joined))), pa.py_buffer(joined)]).dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        at = self.places(pc.binary_join(distinct, pa.scalar(_MARK, pa.large_binary()))[0].as_py().split(_MARK)).take(coded.indices.to_numpy())
        size = self.size.take(at)
        ends = np.cumsum(size)
        place = np.repeat(self.start.take(at) - ends + size, size)
        place += np.arange(len(place))
        edges = np.append(0, ends).take(np.searchsorted(starts, np.append(0, text_ends))).tolist()
        ids = self.ids.take(place)
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _starts(data: np.ndarray, text_ends: np.ndarray, marks: bool) -> tuple[np.ndarray, dict[int, bool]]:
    """Where pieces of the joined texts start; and the texts that may have to be encoded whole, by number: whether only for their wide signs.

    A space goes with the word after it, a line end stands alone, and marks do not go with the letters or digits before them.
    """
    kinds = _KINDS.take(data)
    inner = text_ends[(text_ends > 0) & (text_ends < len(data))]
    begins = (kinds & _BLANK).view(bool)
    runs = begins[1:] & begins[:-1]
    runs[inner - 1] = False
    odd = np.flatnonzero(kinds & _ODD)
    text_of = lambda places: np.unique(np.searchsorted(text_ends, places, "right")).tolist()
    whole = dict.fromkeys(text_of(np.flatnonzero(kinds & _WIDER)), True) | dict.fromkeys(text_of(np.concatenate([np.flatnonzero(runs), odd])), False)
    begins[1:] |= data[:-1] == 10
    if marks:
        letter = (kinds & _ALNUM) > 0
        letter[1:] |= ((kinds[1:] & _REST) > 0) & (data[:-1] == 0xC3)
        begins[1:] |= letter[:-1] & ((kinds[1:] & _SIGN) > 0)
    begins[inner] = begins[0] = True
    return np.flatnonzero(begins), whole


def _as_lines(pieces: list[bytes]) -> str:
    return b"\n".join(pieces).decode()


def _as_words(words: list[bytes]) -> str:
    """Letters, a space before them or not: the model gets them as its pattern's step would give them."""
    text = b"\n\x00\n".join(words)
    if text.isascii():
        return text.replace(b"\x00", b"\xc4\x8a").replace(b" ", b"\xc4\xa0").decode()
    return text.decode("latin-1").translate(_SIGNS)


def _word_encoder(tokenizer):
    """The same model behind a split at line ends only; none if the tokenizer does more than split bytes by the pattern."""
    from tokenizers import Tokenizer, pre_tokenizers

    step = tokenizer.pre_tokenizer
    known = isinstance(step, pre_tokenizers.ByteLevel) and step.use_regex and not step.add_prefix_space
    if not known or tokenizer.normalizer or not all(t.special for t in tokenizer.get_added_tokens_decoder().values()):
        return None
    words = Tokenizer(tokenizer.model)
    words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    return words


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, made longer if it has fewer than n elements."""
    if len(array) >= n:
        return array
    longer = np.empty(max(n, 2 * len(array)), array.dtype)
    longer[: len(array)] = array
    return longer


class Encoder:
    """ids(text) -> bytes of little-endian unsigned 32-bit ids, equal to those of the whole text (UTF-8 bytes or a string).

    Full stops and commas before white space are pieces of their own where only a letter or a digit stands before them:
    there the patterns always part them, and far fewer distinct pieces remain.
    """

    def __init__(self, path: str, white_space_counts: bool, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.white_space_counts = white_space_counts
        self.pieces = Pieces(self.tokenizer, entries)
        self.runs = Runs(self.pieces) if white_space_counts else None

    def ids(self, text: bytes | str) -> bytes:
        if isinstance(text, str):
            text = text.encode()
        if not text:
            return b""
        get = self.pieces.__getitem__
        classes, latin, stops = self._kind(text)
        if not self.white_space_counts:
            # white space only separates, and case is folded
            text = text.lower()
            if stops:
                text = text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" . ").replace(b",\n", b" , ")
            return b"".join(map(get, text.split()))
        marked = self._marked(text, classes, latin, stops)
        return self.pieces.whole(text.decode()) if marked is None else b"".join(map(get, marked.split(_MARK)))

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each of the texts, where white space counts."""
        return [np.frombuffer(self.pieces.whole(t.decode()), "<u4") if x is None else x for t, x in zip(texts, self.runs.of(texts), strict=True)]

    def _kind(self, text: bytes) -> tuple[bytes, bool, bool]:
        """Classes of its bytes, whether there are only Latin letters, whether stops may be pieces of their own."""
        classes = text.translate(_CLASSES)
        latin = b"?" not in classes and b"\xc3\x97" not in text and b"\xc3\xb7" not in text
        return classes, latin, latin and b"!." not in classes and b".." not in classes

    def _marked(self, text: bytes, classes: bytes, latin: bool, stops: bool) -> bytes | None:
        """The text with a mark at each border; nothing if it has to be encoded whole."""
        if _MARK in text or any(x in text for x in _RUNS) or (not latin and _WIDE.search(text.decode())):
            return None
        if stops and b" ." not in classes:
            text = text.replace(b". ", b"\x01. ").replace(b", ", b"\x01, ").replace(b".\n", b"\x01.\n").replace(b",\n", b"\x01,\n")
        # a space goes with the word after it, a line end stands alone
        return text.replace(b" ", b"\x01 ").replace(b"\n", b"\x01\n\x01")


@cache
def encoder(path: str, white_space_counts: bool, entries: int = CACHE_ENTRIES) -> Encoder:
    """One per worker, file and size of its cache."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(path, white_space_counts, entries)


def public_file(name: str) -> str:
    """The place of a tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
