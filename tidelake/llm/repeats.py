"""Windows of a document that also start in a document with a smaller id, exactly.

A *sampler* picks few anchor positions per text such that two equal windows always hold
an equal anchor at the same place. Steps, each linear in the text:

1. Every block sends its distinct anchor hashes; a hash in two documents is shared.
   The answer names the smallest document with it and its place there.
2. Anchors that follow each other on one diagonal of one smaller document extend to a
   longer match without looking at that document; windows inside are found. Other windows
   with an anchor in a smaller document stay open. Holders of shared anchors send keys that
   all windows on one side of an anchor have in common, open windows ask for theirs.
3. Blocks that hold a key that is asked for and shared send the hashes of the windows it
   stands for, as far as they are not found yet. (The smallest holder of a window is never
   itself found, so it sends.)
4. An open window is found if the smallest document that sent it has a smaller id.

Hashes of whole windows have 64 bits: two different windows among n sent ones meet with
a chance of about n * n / 2**65. Rows without an id are returned, but nothing is removed
from them and they hold nothing for others; rows with equal ids are the same document.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle

from tidelake.llm import exchange as X
from tidelake.llm import kernels as K

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANCHORS, PROVEN, OPEN = 1, 2, 3  # kinds of message entries

def anchor_mask(size):
    """The leading bits of anchor hashes that a table of so many bytes needs.

    Anchors need not be told apart by all 64 bits: a chance meeting only costs a look, and at
    11 bits more than the table has bytes one anchor in some thousands meets another.
    """
    bits = min(64, max(32, size.bit_length() + 11))
    return np.uint64((1 << 64) - (1 << (64 - bits)))


@dataclass
class Items:
    """The items (words or bytes) of a block's documents."""

    h: np.ndarray  # a word's hash, or a byte
    offsets: np.ndarray  # first item of each document, and the total
    ids: np.ndarray
    window: int
    memo: dict = field(default_factory=dict)

    def once(self, name, make):
        """The value of ``make()``, kept for the next time."""
        if name not in self.memo:
            self.memo[name] = make()
        return self.memo[name]

    @property
    def owner(self):
        return self.once("owner", lambda: K.owners(self.offsets))

    def windows(self, active):
        """(first, past the last) window start of each document that has any."""
        low, high = self.offsets[:-1], self.offsets[1:] - self.window + 1
        some = active & (high > low)
        return low[some], high[some]


def first_holders(h, doc, place):
    """Distinct hashes with their first (document, place) and whether another document follows.

    Items come by ascending document and place.
    """
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    cuts = K.group_starts(ordered)
    first, last = order[cuts], order[np.append(cuts[1:], len(h)) - 1] if len(h) else order[cuts]
    return ordered[cuts], doc[first], place[first], doc[first] != doc[last]


def smallest_holders(src, h, doc, more):
    """Per entry, in hash order: (order, smallest document of its hash, is it shared)."""
    order = np.argsort(h, kind="stable")
    cuts = K.group_starts(h[order])
    sizes = np.diff(np.append(cuts, len(h)))
    least = np.minimum.reduceat(doc[order], cuts)
    most = np.maximum.reduceat(doc[order], cuts)
    shared = (least != most) | np.logical_or.reduceat(more[order], cuts)
    return order, np.repeat(least, sizes), np.repeat(shared, sizes), cuts, sizes


def send_anchors(sampler, items, active, block, buckets):
    place, h = sampler.anchors(items, active)
    h = h & sampler.mask
    owner = items.owner[place]
    keys, doc, at, more = first_holders(h, items.ids[owner], place - items.offsets[owner])
    return X.to_buckets(block, ANCHORS, buckets, keys, doc, (at * 2 + more).astype(np.uint64))


def share_anchors(bucket, table):
    src, h, x, y = X.gather(table, ANCHORS)
    if not len(h):
        return []
    doc = x.view(np.int64)
    order, least, shared, cuts, sizes = smallest_holders(src, h, doc, (y & np.uint64(1)).astype(bool))
    place = (y >> np.uint64(1))[order]
    # the place in the smallest document, for all entries of the hash
    own = np.where(doc[order] == least, place, np.iinfo(np.uint64).max)
    at = np.repeat(np.minimum.reduceat(own, cuts), sizes)
    return X.back(bucket, ANCHORS, src[order][shared], h[order][shared], least[shared], at[shared])


def shared_anchors(sampler, items, active, found):
    """(all places, index of shared ones, their hash, smallest holder and place in it)."""
    _, h, x, y = X.gather(found, ANCHORS)
    order = np.argsort(h, kind="stable")
    h, least, at = h[order], x.view(np.int64)[order], y.astype(np.int64)[order]
    place, own = sampler.anchors(items, active)
    own = own & sampler.mask
    hit = K.lookup(own, h)
    k = np.flatnonzero(hit >= 0)
    return place, k, own[k], least[hit[k]], at[hit[k]]


def extend(sampler, items, active, found, block, buckets):
    """Matches proven by anchors on one diagonal; shared anchors, marked where windows stay open."""
    if not found.num_rows:
        return []
    place, k, h, least, at = shared_anchors(sampler, items, active, found)
    if not len(k):
        return []
    p = place[k]
    owner = items.owner[p]
    good = least < items.ids[owner]
    diagonal = p - items.offsets[owner] - at
    joined = np.zeros(len(k), dtype=bool)
    joined[1:] = ((k[1:] == k[:-1] + 1) & (owner[1:] == owner[:-1]) & good[1:] & good[:-1] & (least[1:] == least[:-1])
                  & (diagonal[1:] == diagonal[:-1]) & (p[1:] - p[:-1] <= sampler.width))
    heads = np.flatnonzero(~joined)
    tails = np.append(heads[1:], len(k)) - 1
    long = good[heads] & (p[tails] + sampler.width - p[heads] >= items.window)
    starts, ends = p[heads][long], p[tails][long] + sampler.width - items.window + 1
    n = items.offsets[-1]
    free = K.covered(*items.windows(active), n) & ~K.covered(starts, ends, n)
    open_, keys, doc, asks = np.zeros(n, dtype=bool), [], [], []
    for part in range(sampler.parts):
        at, anchor = sampler.around(items, active, p, part)
        at, anchor = at[free[at]], anchor[free[at]]
        open_[at[good[anchor]]] = True
        held = np.unique(anchor)
        keys.append(sampler.keys(items, p[held], part) & sampler.mask)
        doc.append(items.ids[owner[held]])
        asks.append(good[held])
    keys, doc, asks = np.concatenate(keys), np.concatenate(doc), np.concatenate(asks)
    order = np.argsort(keys, kind="stable")
    cuts = K.group_starts(keys[order])
    out = []
    if len(keys):
        several = np.minimum.reduceat(doc[order], cuts) != np.maximum.reduceat(doc[order], cuts)
        marks = np.logical_or.reduceat(asks[order], cuts) + 2 * several
        out.extend(X.to_buckets(block, ANCHORS, buckets, keys[order][cuts], marks.astype(np.uint64)))
    run_starts, run_ends = K.runs(open_)
    for kind, s, e in ((PROVEN, starts, ends), (OPEN, run_starts, run_ends)):
        if len(s):
            out.append((block % buckets, block, kind, s.astype(np.uint64), (e - s).astype(np.uint64), None))
    return out


def passed_on(bucket, table):
    """Entries that a block sent to itself."""
    for row in table.select(["src", "kind", "n", "h", "x"]).to_pylist():
        if row["kind"] != ANCHORS:
            yield (row["src"], bucket, row["kind"], K.unpack_sorted(row["h"], row["n"]), K.unpack(row["x"], row["n"]), None)


def asked(bucket, table):
    """Every holder of a key that some block asks for and two documents have."""
    src, h, x, _ = X.gather(table, ANCHORS)
    out = list(passed_on(bucket, table))
    if len(h):
        order = np.argsort(h, kind="stable")
        cuts = K.group_starts(h[order])
        sizes = np.diff(np.append(cuts, len(h)))
        marks = np.bitwise_or.reduceat(x[order], cuts)
        wanted = np.repeat((marks % np.uint64(2) > 0) & ((sizes > 1) | (marks > 1)), sizes)
        out.extend(X.back(bucket, ANCHORS, src[order][wanted], h[order][wanted]))
    return out


def spans(found, kind):
    _, s, length, _ = X.gather(found, kind)
    order = np.argsort(s, kind="stable")
    s, length = s[order].astype(np.int64), length[order].astype(np.int64)
    return s, s + length


def send_windows(sampler, items, active, found, block, buckets):
    """Hashes of the windows that wanted keys stand for and that are not proven."""
    out = []
    for kind in (PROVEN, OPEN):
        s, e = spans(found, kind)
        if len(s):
            out.append((block % buckets, block, kind, s.astype(np.uint64), (e - s).astype(np.uint64), None))
    _, h, _, _ = X.gather(found, ANCHORS)
    if len(h):
        place, _ = sampler.anchors(items, active)
        n, h = items.offsets[-1], np.sort(h)
        some = np.zeros(n, dtype=bool)
        for part in range(sampler.parts):
            fits = sampler.fitting(items, place, part)
            wanted = fits[K.lookup(sampler.keys(items, fits, part) & sampler.mask, h) >= 0]
            some[sampler.around(items, active, wanted, part)[0]] = True
        at = np.flatnonzero(some & K.covered(*items.windows(active), n) & ~K.covered(*spans(found, PROVEN), n))
        keys, doc, _, more = first_holders(sampler.whole(items, at), items.ids[items.owner[at]], at)
        out.extend(X.to_buckets(block, ANCHORS, buckets, keys, doc, more.astype(np.uint64)))
    return out


def settle(bucket, table):
    """The smallest document of each window, for blocks that hold it in a later one."""
    src, h, x, y = X.gather(table, ANCHORS)
    out = list(passed_on(bucket, table))
    if len(h):
        doc, more = x.view(np.int64), y > 0
        order, least, _, _, _ = smallest_holders(src, h, doc, more)
        later = (doc[order] > least) | more[order]
        out.extend(X.back(bucket, ANCHORS, src[order][later], h[order][later], least[later]))
    return out


def removed(sampler, items, found):
    """Mask of the items inside a window that also starts in a smaller document."""
    n = items.offsets[-1]
    starts, ends = spans(found, PROVEN)
    at = np.flatnonzero(K.covered(*spans(found, OPEN), n))
    if len(at):
        whole = sampler.whole(items, at)
        _, h, x, _ = X.gather(found, ANCHORS)
        order = np.argsort(h, kind="stable")
        known = K.lookup(whole, h[order])
        hit = np.zeros(len(at), dtype=bool)
        hit[known >= 0] = x.view(np.int64)[order][known[known >= 0]] < items.ids[items.owner[at[known >= 0]]]
        starts, ends = np.concatenate([starts, at[hit]]), np.concatenate([ends, at[hit] + 1])
    return K.covered(starts, ends + items.window - 1, n)


def remove_repeats(docs, read, sampler, finish, schema, window, id_col="doc_id", text_col="text", **sizes):
    """Apply ``finish(table, texts, items, removed mask)`` to every block of documents.

    ``read(table, window)`` gives (texts, Items): how texts are cut into items.
    """
    frame, buckets, count = X.blocks(docs, id_col, text_col, **sizes)
    sampler.mask = anchor_mask(count * sizes.get("block_bytes", X.BLOCK_BYTES))

    def first(block, table):
        _, items = read(table, window)
        return send_anchors(sampler, items, X.ids_of(table)[1], block, buckets)

    def second(block, table, found):
        _, items = read(table, window)
        return extend(sampler, items, X.ids_of(table)[1], found, block, buckets)

    def third(block, table, found):
        _, items = read(table, window)
        return send_windows(sampler, items, X.ids_of(table)[1], found, block, buckets)

    def last(block, table, found):
        texts, items = read(table, window)
        return finish(table, texts, items, removed(sampler, items, found))

    shared = X.resolve(X.emit(frame, first), share_anchors)
    wanted = X.resolve(X.answer(frame, shared, second), asked)
    settled = X.resolve(X.answer(frame, wanted, third), settle)
    return X.answer(frame, settled, last, schema)
