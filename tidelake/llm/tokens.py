"""Token ids of many texts by a byte-level BPE vocabulary file, each distinct piece of text encoded once.

Texts are cut where the vocabulary's own splitting pattern always cuts: before the last
blank of a run of blanks, around other blanks, and between an ASCII letter and an ASCII mark. Such
pieces have the same ids wherever they stand, so a batch encodes its distinct pieces
only. Pieces of plain Latin letters go through the rank encoder, which is several times
faster; all others, and texts with blanks beyond ASCII whole, go through the file's own
tokenizer, so both agree whatever either knows of Unicode.
"""

from __future__ import annotations

import json
import os
import sys
import types

import numpy as np
from pyspark import cloudpickle

from tidelake.llm import kernels as K

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: how byte-level vocabularies split texts, and which bytes stand for themselves in their files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]

BLANK = K.byte_table((0x09, 0x0D), (0x20, 0x20))
LETTER = K.byte_table((0x41, 0x5A), (0x61, 0x7A))
MARK = K.byte_table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
# lead bytes above U+024F: not plain Latin
FOREIGN = K.byte_table((0xC9, 0xFF))
# all blanks beyond ASCII
WIDE_BLANKS = [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WIDE_LEAD = K.byte_table((0xC2, 0xC2), (0xE1, 0xE3))
# an encoder forgets its pieces beyond this number
KNOWN_PIECES = 1 << 21


def printed_bytes():
    """The letter that stands for each byte in a byte-level vocabulary file."""
    own = {b for low, high in PRINTED for b in range(low, high + 1)}
    rest = iter(range(256, 512))
    return {chr(b if b in own else next(rest)): b for b in range(256)}


def pieces_of(data, offsets):
    """(starts, ends) of the pieces of all texts; an empty text has none."""
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    blank = BLANK[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:] = blank[:-1]
    before &= ~first[:-1]
    after[:-1] = ~blank[1:]
    after &= ~first[1:]
    joined = np.zeros(n, dtype=bool)  # behind a space of its own text
    joined[1:] = data[:-1] == 0x20
    start = first[:-1] | (blank & (~before | after)) | (~blank & before & ~joined)
    start[1:] |= MARK[data[1:]] & LETTER[data[:-1]]
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def piece_keys(data, starts, ends):
    """A 64-bit hash of each piece, from its eight-byte words; short pieces are most."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    key, open_, at = lengths.astype(np.uint64) * K.ODD, np.arange(len(starts)), starts
    low = np.append((np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1), ~np.uint64(0))
    while len(open_):
        left = ends[open_] - at
        key[open_] = K.mix(key[open_] ^ (words[at] & low[np.minimum(left, 8)])) + K.ODD
        more = left > 8
        open_, at = open_[more], at[more] + 8
    return key


def encoder(path):
    """The encoder of a vocabulary file; the tasks of one Python worker share it and what it knows."""
    store = sys.modules.setdefault("tidelake_encoders", types.ModuleType("tidelake_encoders"))
    if path not in vars(store):
        vars(store)[path] = Encoder(path)
    return vars(store)[path]


class Encoder:
    """Token ids of Arrow batches; holds the pieces seen so far, up to KNOWN_PIECES and a batch."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = printed_bytes()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
        special = {self.tokenizer.id_to_token(i) for i in self.tokenizer.get_added_tokens_decoder()}
        ranks = {token: i for token, i in ranks.items() if token.decode("utf-8", "replace") not in special}
        self.largest = max(max(vocabulary.values()), *self.tokenizer.get_added_tokens_decoder(), 0)
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.ranks = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self):
        self.keys, self.at = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.first, self.ids = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint32)

    def plain(self, texts):
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ranked(self, data, starts, ends):
        """(ids, number of ids of each piece) of plain pieces, those behind a space as one text."""
        raw = data.tobytes()
        spaced = (data[starts] == 0x20) & (ends - starts > 1) & ~BLANK[data[np.minimum(starts + 1, len(data) - 1)]]
        numbers, found = np.zeros(len(starts), dtype=np.int64), []
        for i in np.flatnonzero(~spaced).tolist():
            found.append(self.ranks.encode_ordinary(raw[starts[i]:ends[i]].decode()))
            numbers[i] = len(found[-1])
        other = np.array([i for ids in found for i in ids], dtype=np.uint32)
        at = np.flatnonzero(spaced)
        text = b"".join([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        joint = np.asarray(self.ranks.encode_to_numpy(text.decode()) if text else [], dtype=np.uint32)
        stops = np.searchsorted(np.cumsum(self.sizes[joint]), np.cumsum(ends[at] - starts[at])) + 1
        numbers[at] = np.diff(stops, prepend=0)
        out = np.empty(len(joint) + len(other), dtype=np.uint32)
        inside = np.repeat(spaced, numbers)
        out[inside], out[~inside] = joint, other
        return out, numbers

    def learn(self, keys, data, starts, ends, foreign):
        """Add new pieces; ``keys`` ascend."""
        ids, numbers = self.ranked(data, starts[~foreign], ends[~foreign])
        raw = data.tobytes()
        own = self.plain([raw[a:b].decode() for a, b in zip(starts[foreign].tolist(), ends[foreign].tolist())])
        order = np.concatenate([np.flatnonzero(~foreign), np.flatnonzero(foreign)])
        numbers = np.concatenate([numbers, np.array([len(x) for x in own], dtype=np.int64)])
        place = np.searchsorted(self.keys, keys[order])
        number = len(self.first) - 1 + np.arange(len(keys))
        back = np.argsort(order)
        self.keys = np.insert(self.keys, place[back], keys)
        self.at = np.insert(self.at, place[back], number[back])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(numbers)])
        self.ids = np.concatenate([self.ids, ids, np.array([i for x in own for i in x], dtype=np.uint32)])

    def encode(self, column):
        """(ids of all texts one after the other, offsets of the texts in them)."""
        data, offsets = K.text_bytes(column)
        starts, ends = pieces_of(data, offsets)
        key = piece_keys(data, starts, ends)
        distinct, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        known = K.lookup(distinct, self.keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            if len(self.keys) + len(new) > KNOWN_PIECES:
                self.forget()
                new = np.arange(len(distinct))
            a, b, odd = starts[index[new]], ends[index[new]], np.flatnonzero(FOREIGN[data])
            self.learn(distinct[new], data, a, b, np.searchsorted(odd, b) > np.searchsorted(odd, a))
            known = K.lookup(distinct, self.keys)
        number = self.at[known][inverse]
        lengths = np.diff(self.first)[number]
        ends_ = np.cumsum(lengths)
        total = int(ends_[-1]) if len(ends_) else 0
        ids = self.ids[np.repeat(self.first[:-1][number] - (ends_ - lengths), lengths) + np.arange(total)]
        sums = np.concatenate([[0], ends_])
        return self.whole(column, data, offsets, ids, sums[np.searchsorted(starts, offsets)])

    def whole(self, column, data, offsets, ids, at):
        """The same with texts that hold blanks beyond ASCII encoded whole."""
        odd = np.zeros(len(offsets) - 1, dtype=bool)
        lead = np.flatnonzero(WIDE_LEAD[data])
        if len(lead):
            tail = np.concatenate([data, np.zeros(2, dtype=np.uint8)]).astype(np.int64)
            two, three = tail[lead + 1] & 0x3F, tail[lead + 2] & 0x3F
            point = np.where(data[lead] == 0xC2, 0x80 | two, (tail[lead] & 0x0F) << 12 | two << 6 | three)
            found = lead[np.isin(point, WIDE_BLANKS)]
            odd[np.searchsorted(offsets, found, side="right") - 1] = True
        if not odd.any():
            return ids, at
        rows = np.flatnonzero(odd).tolist()
        own = dict(zip(rows, self.plain([data[offsets[i]:offsets[i + 1]].tobytes().decode() for i in rows])))
        parts = [np.array(own[i], dtype=np.uint32) if i in own else ids[at[i]:at[i + 1]] for i in range(len(odd))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
