"""A compact file format for token ids: a context-mixing range coder over independently reset blocks.

Each block of up to ``BLOCK`` ids starts from the same model, holds its own crc32 and can be read alone (with the head). Blocks are coded
side by side, ``LANES`` at a time: every step handles one id of each block with array operations, so the loop runs over
places in a block, not over ids; the more blocks, the less a step costs an id.

Model of a block, adaptive above order 0:
* order 2: the id last seen after the two ids before; order 1: the id last seen after the id before. Each
  prediction has a confidence (how often it was right in a row).
* order 0: the frequencies of the ids of the file, which its head holds in parts of a power of two.
* mixing: each order has a weight, one set of weights for each pair of confidences and whether both orders agree; they are the
  shares that the orders had in predicting the ids of the file, and stand in its head. The probability of a predicted id is the
  weight of the orders that predict it; what is left goes to order 0, from which any id can be coded.

Coder: a 64-bit low and range, written in 32-bit words, carries ripple into what is written. The writer runs the model over
all blocks first, for the weights, and codes what it found after that.

File: magic, then numbers of documents, of null document ids (these come first), of ids per block and of distinct ids,
then the part the file is of, its number there, the ids of the part before it and in it; then per document its id and
length; the distinct ids, ascending (the alphabet: blocks hold places in it), as steps, their frequencies and the weights, all deflated
behind the number of bytes; per block its words and crc32 (of the ids as little-endian unsigned 32-bit integers), then the words of all
blocks, then a crc32 of all that; all little-endian.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

MAGIC = b"SFT4"
#: Ids of a block, and blocks coded side by side at most.
BLOCK, LANES = 2048, 4096
#: Frequencies of order 0 sum to two to this power; a larger alphabet takes a larger one, and ranges are renewed before it.
_ZERO = 20
_SLOTS1, _SLOTS2 = 512, 1024
_HASH, _SHIFT1, _SHIFT2 = np.uint32(2654435769), np.uint32(32 - 9), np.uint32(32 - 10)
_FULL, _LOW32, _WORD = np.uint64((1 << 64) - 1), np.uint64((1 << 32) - 1), np.uint64(32)
_PROB, _ONE = 16, 1 << 16
#: Sets of weights, one for each pair of confidences and whether both orders say the same; the third kind of id of a set.
_SETS, _NEITHER = 32, np.int32(2)


class _Zero:
    """Order 0: the frequency of each id of the alphabet, at least one, and where it begins; a last entry that is certain."""

    def __init__(self, freq: np.ndarray):
        total = int(freq.sum())
        self.freq = np.append(freq, total).astype(np.uint64)
        self.low = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
        self.all, self.bits = np.int32(len(freq)), total.bit_length() - 1
        self.wide = self.bits > _ZERO  # ranges have 21 bits at least after a chance of 32 in 65536

    def places(self) -> np.ndarray:
        """The id of each value below the sum."""
        return np.repeat(np.arange(self.all, dtype=np.int32), self.freq[:-1].astype(np.int64))


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Parts of a power of two in proportion to the counts, one at least each."""
    total = 1 << max(_ZERO, len(counts).bit_length() + 1)
    share = (total - len(counts)) / max(int(counts.sum()), 1)
    freq = 1 + np.floor(counts * share).astype(np.int64)
    while (rest := total - int(freq.sum())) and len(freq):  # what is rounded off goes to the most frequent
        top = np.argsort(-freq, kind="stable")[: abs(rest)]
        freq[top] += np.sign(rest)
    return freq


class _Model:
    """The orders 1 and 2 of all lanes; encoder and decoder drive it alike.

    A slot holds 64 * id and its confidence, times 16 in table 1 and times 4 in table 2.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=np.int64)
        self.base1, self.base2 = lane * _SLOTS1, lane * _SLOTS2
        self.table1, self.table2 = np.zeros(lanes * _SLOTS1, np.int32), np.zeros(lanes * _SLOTS2, np.int32)
        self.key = np.zeros(lanes, np.uint32)  # of the id before
        self.at1, self.at2 = self.base1.copy(), self.base2.copy()

    def predict(self) -> np.ndarray:
        """The set of weights of each lane, times four: both confidences and whether the orders agree."""
        self.v1, self.v2 = self.table1.take(self.at1), self.table2.take(self.at2)
        self.p1, self.p2 = self.v1 >> 6, self.v2 >> 6
        self.c1, self.c2 = self.v1 & 63, self.v2 & 63
        sets = self.c1 + self.c2
        sets += np.left_shift(self.p1 == self.p2, 6, dtype=np.int32)
        return sets

    def learn(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes the ids that came in; whether each order predicted its lane's."""
        hit1, hit2 = self.p1 == ids, self.p2 == ids
        slot = ids << 6
        v1 = np.where(self.c1 > 0, self.v1 - 16, slot)  # a prediction that held before goes only after misses
        np.copyto(v1, np.minimum(self.v1 + 16, self.v1 | 48), where=hit1)
        np.copyto(slot, np.minimum(self.v2 + 4, self.v2 | 12), where=hit2)
        self.table1[self.at1], self.table2[self.at2] = v1, slot
        key = ids.astype(np.uint32) * _HASH
        self.at1 = (key >> _SHIFT1) + self.base1
        self.at2 = ((key ^ (self.key >> np.uint32(5)) * _HASH) >> _SHIFT2) + self.base2
        self.key = key
        return hit1, hit2


class _Mix:
    """Chances, in parts of 65536, of what the orders 2 and 1 say and of order 0, by set of weights; of each where it begins."""

    def __init__(self, weights: np.ndarray):
        """weights: orders 2 and 1 of each set."""
        w2, w1 = weights.astype(np.uint64).reshape(2, _SETS)
        none = np.zeros(_SETS, np.uint64)
        self.freq = np.stack([w2, w1, np.uint64(_ONE) - w2 - w1, none], 1).ravel()
        self.low = np.stack([none, w2, w2 + w1, none], 1).ravel()


def weigh(counts: np.ndarray) -> np.ndarray:
    """The weights of orders 2 and 1 in each set, from how often each set's ids came from order 2, from 1 and from 0."""
    share = (counts[:, :2] + 0.25) / (counts.sum(1, keepdims=True) + 0.75)
    return (32 + np.floor(share * (_ONE - 128))).T.astype(np.int64).ravel()


class _Writer:
    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _FULL, np.uint64)
        self.words = words
        self.out = np.zeros(lanes * words, np.uint32)
        self.at = np.arange(lanes) * words

    def narrow(self, cum: np.ndarray, freq: np.ndarray, bits: int) -> None:
        r = self.range >> np.uint64(bits)
        cum = r * cum
        self.low += cum
        self.range = r * freq
        over = self.low < cum
        if over.any():
            back = self.at[over] - 1
            while len(back):  # a carry into the words before
                self.out[back] += np.uint32(1)
                back = back[self.out[back] == 0] - 1

    def flush(self) -> None:
        """Write what is settled, so that ranges are above 32 bits again."""
        small = np.flatnonzero(self.range <= _LOW32)
        x, at = self.low.take(small), self.at.take(small)
        self.out[at] = x >> _WORD
        self.at[small] = at + 1
        self.low[small] = x << _WORD
        self.range[small] = self.range.take(small) << _WORD

    def close(self) -> list[bytes]:
        for word in (self.low >> _WORD, self.low & _LOW32):
            self.out[self.at] = word
            self.at += 1
        return [self.out[i * self.words : end].astype("<u4").tobytes() for i, end in enumerate(self.at.tolist())]


class _Reader:
    def __init__(self, words: np.ndarray, first: np.ndarray):
        """words: of all blocks; first: where each block's begin."""
        self.words = np.r_[words, np.zeros(2, words.dtype)].astype(np.uint64)
        self.at = first + 2
        self.value = (self.words[first] << _WORD) | self.words[first + 1]
        self.range = np.full(len(first), _FULL, np.uint64)

    def peek(self, bits: int) -> np.ndarray:
        self.r = self.range >> np.uint64(bits)
        return self.value // self.r

    def take(self, cum: np.ndarray, freq: np.ndarray) -> None:
        self.value -= self.r * cum
        self.range = self.r * freq

    def fill(self) -> None:
        small = np.flatnonzero(self.range <= _LOW32)
        at = self.at.take(small)
        self.value[small] = (self.value.take(small) << _WORD) | self.words.take(at, mode="clip")
        self.at[small] = at + 1
        self.range[small] = self.range.take(small) << _WORD


def encode_blocks(ids: np.ndarray, freq: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, list[bytes]]:
    """The weights and the words of each block of ``block`` ids, places in ``freq``; the last is filled up with zeros, which the reader drops."""
    runs, counts = [], np.zeros(4 * _SETS, np.int64)
    steps, zero = min(block, len(ids)), _Zero(freq)
    for a in range(0, len(ids), block * LANES):
        own = ids[a : a + block * LANES]
        n = -(-len(own) // steps)
        table = np.zeros(n * steps, np.int32)
        table[: len(own)] = own
        table = np.ascontiguousarray(table.reshape(n, steps).T)
        kinds, model = np.empty((steps, n), np.uint8), _Model(n)
        for x, kind in zip(table, kinds, strict=True):
            sets = model.predict()
            hit1, hit2 = model.learn(x)
            miss2 = ~hit2
            np.add(sets, miss2.view(np.int8) + (miss2 & ~hit1), out=kind, casting="unsafe")
            counts += np.bincount(kind, minlength=4 * _SETS)
        runs.append((table, kinds))
    weights = weigh(counts.reshape(_SETS, 4)[:, :3])
    mix, out = _Mix(weights), []
    for table, kinds in runs:
        coder = _Writer(table.shape[1], 2 * steps + 8)
        for x, kind in zip(table, kinds, strict=True):
            coder.narrow(mix.low.take(kind), mix.freq.take(kind), _PROB)
            if zero.wide:
                coder.flush()
            at = np.where(kind & 3 == _NEITHER, x, zero.all)
            coder.narrow(zero.low.take(at), zero.freq.take(at), zero.bits)
            coder.flush()
        out += coder.close()
    return weights, out


def decode_blocks(payloads: list[bytes], n_ids: int, freq: np.ndarray, weights: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of blocks that follow each other, the last of which may hold fewer."""
    out = [np.zeros(0, np.int32)]
    steps, zero, mix = min(block, n_ids), _Zero(freq), _Mix(weights)
    places = zero.places()
    for a in range(0, len(payloads), LANES):
        own = payloads[a : a + LANES]
        lengths = np.array([len(p) // 4 for p in own])
        table = np.empty((steps, len(own)), np.int32)
        model, coder = _Model(len(own)), _Reader(np.frombuffer(b"".join(own), "<u4"), np.cumsum(lengths) - lengths)
        for x in table:
            sets = model.predict()
            coder.r = coder.range >> np.uint64(_PROB)
            is2 = coder.value < coder.r * mix.freq.take(sets)
            none = coder.value >= coder.r * mix.low.take(sets + _NEITHER)
            kind = sets + (~is2).view(np.int8) + none
            coder.take(mix.low.take(kind), mix.freq.take(kind))
            if zero.wide:
                coder.fill()
            at = places.take(coder.peek(zero.bits), mode="clip")
            np.copyto(x, np.where(is2, model.p2, model.p1))
            np.copyto(x, at, where=none)
            np.copyto(at, zero.all, where=~none)
            coder.take(zero.low.take(at), zero.freq.take(at))
            coder.fill()
            model.learn(x)
        out.append(table.T.ravel())
    return np.concatenate(out)[:n_ids]


#: magic, documents, null ids, ids per block, distinct ids, part, number in the part, ids of the part before, ids.
_HEAD = struct.Struct("<4sIIIIIIQQ")
HEAD_BYTES = _HEAD.size


class Head(NamedTuple):
    documents: int
    nulls: int
    block: int
    alphabet: int
    part: int
    seq: int
    first: int
    n_ids: int


def read_head(data: bytes) -> Head:
    """What the first ``HEAD_BYTES`` bytes of a file say; ValueError if they are not of this format."""
    if len(data) < HEAD_BYTES or data[:4] != MAGIC:
        raise ValueError("not a token file")
    return Head(*_HEAD.unpack_from(data)[1:])


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, ascending, the place of each id among them, and how often they occur."""
    if not len(ids) or ids.max() >= max(1 << 20, 4 * len(ids)):
        return np.unique(ids, return_inverse=True, return_counts=True)
    every = np.bincount(ids)
    alphabet = np.flatnonzero(every)
    place = np.zeros(len(every), np.int32)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[ids], every[alphabet]


def _planes(values: np.ndarray) -> bytes:
    """32-bit values by bytes of one rank."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplane(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def write_file(doc_ids: list[int | None], documents: list[np.ndarray], block: int = BLOCK, part: int = 0, seq: int = 0, first: int = 0) -> bytes:
    """The documents' ids as one file; null document ids come first."""
    ids = np.concatenate([np.zeros(0, np.uint32), *documents])
    nulls = sum(d is None for d in doc_ids)
    alphabet, ids_in, counts = _distinct(ids)
    freq = frequencies(counts)
    weights, words = encode_blocks(ids_in, freq, block)
    own = zlib.compress(_planes(np.diff(alphabet, prepend=0)) + _planes(freq) + _planes(weights))
    parts = [_HEAD.pack(MAGIC, len(documents), nulls, block, len(alphabet), part, seq, first, len(ids)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(d) for d in documents], "<u8").tobytes(), struct.pack("<I", len(own)), own]
    crcs = [zlib.crc32(ids[i : i + block].astype("<u4").tobytes()) for i in range(0, len(ids), block)]
    parts += [np.array([len(w) for w in words], "<u4").tobytes(), np.array(crcs, "<u4").tobytes(), *words]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def read_file(data: bytes) -> tuple[Head, list[int | None], np.ndarray, np.ndarray]:
    """The head, the id and length of each document, and all token ids; ValueError for a file that is damaged or not of this format."""
    head = read_head(data)
    if len(data) < HEAD_BYTES + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("the file is damaged")
    at, n = HEAD_BYTES, head.documents
    doc_ids = [None] * head.nulls + np.frombuffer(data, "<i8", n, at)[head.nulls :].tolist()
    lengths = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
    at += 16 * n
    size = struct.unpack_from("<I", data, at)[0]
    planes = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), np.uint8)
    steps, freq, weights = (_unplane(p) for p in np.split(planes, [4 * head.alphabet, 8 * head.alphabet]))
    alphabet = np.cumsum(steps)
    at += 4 + size
    n_blocks = -(-head.n_ids // head.block)
    sizes = np.frombuffer(data, "<u4", n_blocks, at)
    crcs = np.frombuffer(data, "<u4", n_blocks, at + 4 * n_blocks)
    ends = at + 8 * n_blocks + np.cumsum(sizes, dtype=np.int64)
    payloads = [data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
    ids = alphabet[decode_blocks(payloads, head.n_ids, freq, weights, head.block)]
    for i, crc in enumerate(crcs.tolist()):
        if zlib.crc32(ids[i * head.block : (i + 1) * head.block].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return head, doc_ids, lengths, ids
