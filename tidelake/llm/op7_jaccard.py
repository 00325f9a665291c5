"""N-gram Jaccard join: subsets of small sets, inverted lists of large ones, by cost."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidelake.llm import exchange as X
from tidelake.llm import kernels as K
from tidelake.llm.components import components
from tidelake.llm.op9_decontaminate import pieces
from tidelake.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SETS, KEYS, LINKED, SAME, LIST, SIZE, BITMAP = 1, 2, 3, 4, 5, 6, 7
# sets compared with one centre in one task
LEAVES = 64
# members of an undecided list compared in one task
CHUNK = 1024
LEAST_BITS = 256


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * intersection >= percent * union."""

    shingle: int
    percent: int
    boundary: int  # smaller sets have their subsets listed

    def spare(self, size):
        """Most members of a set of this size that a linked set can lack."""
        return (100 - self.percent) * size // 100

    def small(self):
        """Smallest size of a set that can link with one of the boundary's size."""
        return -(-self.percent * self.boundary // 100)

    def levels(self, largest):
        """First sizes of size classes: linked sets are in one class or in neighbouring ones."""
        out = [max(1, self.small())]
        while out[-1] <= largest:
            out.append(max(out[-1] + 1, -(-out[-1] * 100 // self.percent)))
        return np.array(out + [max(out[-1] + 1, -(-out[-1] * 100 // self.percent))])

    def parts(self, beyond):
        """One more than the most members by which two linked sets below this size can differ."""
        # difference <= (1 - t) * union and union <= (a + b) / (1 + t)
        return (100 - self.percent) * 2 * (beyond - 1) // (100 + self.percent) + 1

    def linked(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)


def shingle_sets(column, size):
    """(members, first member of each text and the total): distinct shingle hashes, ascending.

    A text with fewer words than ``size`` has its whole word sequence as one shingle.
    """
    data, offsets = K.text_bytes(column, lower=True)
    starts, ends, first = K.words(data, offsets)
    h = K.span_hashes(data, starts, ends)
    owner = K.owners(first)
    whole = K.window_hashes(h, size)
    at = np.flatnonzero(owner[:len(whole)] == owner[size - 1:][:len(whole)])
    member, doc = [whole[at]], [owner[at]]
    count = np.diff(first)
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            member.append(K.mix(K.window_hashes(h, n)[first[short]] + K.U(n)))
            doc.append(short)
    member, doc = np.concatenate(member), np.concatenate(doc)
    order = np.lexsort((member, doc))
    member, doc = member[order], doc[order]
    new = np.ones(len(member), dtype=bool)
    new[1:] = (member[1:] != member[:-1]) | (doc[1:] != doc[:-1])
    member, doc = member[new], doc[new]
    return member, np.searchsorted(doc, np.arange(len(count) + 1))


def sums(values, first):
    """Wrapping sum of each text's values."""
    return np.diff(np.concatenate([[K.U(0)], np.cumsum(values, dtype=np.uint64)])[first])


def set_keys(member, first):
    return K.mix(sums(K.mix(member), first) * K.ODD + np.diff(first).astype(np.uint64))


def subset_keys(members, rule):
    """(key, size) of every subset of a small set that it may share with a linked one."""
    codes = K.mix(members)
    n = len(codes)
    left, last = codes.sum(keepdims=True, dtype=np.uint64), np.array([-1])
    keys, sizes = [left], [np.array([n])]
    for gone in range(1, rule.spare(n) + 1):
        # leave out one more member behind the last one left out
        more = n - 1 - last
        at = np.repeat(np.arange(len(last)), more)
        last = last[at] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
        left = left[at] - codes[last]
        keys.append(left)
        sizes.append(np.full(len(left), n - gone))
    keys, sizes = np.concatenate(keys), np.concatenate(sizes)
    return K.mix(keys * K.ODD + sizes.astype(np.uint64) * K.U(3) + K.U(1)), sizes


def part_keys(member, first, chosen, rule):
    """(key, text) of every part of the chosen large sets, at their size class and the next.

    A set is cut by hash ranges into one part more than linked sets of the class can
    differ by, so two linked sets agree on a whole part. An empty part counts.
    """
    size = np.diff(first)
    if not len(chosen):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    levels = rule.levels(int(size[chosen].max()))
    own = np.searchsorted(levels, size[chosen], side="right") - 1
    keys, texts = [], []
    for step in (0, 1):
        level = own + step
        parts = np.zeros(len(size), dtype=np.int64)
        parts[chosen] = [rule.parts(int(levels[v + 1])) for v in level]
        offset = np.concatenate([[0], np.cumsum(parts)])
        doc = K.owners(first)
        use = parts[doc] > 0
        part = (((member[use] >> K.U(32)) * parts[doc[use]].astype(np.uint64)) >> K.U(32)).astype(np.int64)
        # members ascend, so parts of a text follow each other
        bounds = np.searchsorted(part + offset[doc[use]], np.arange(offset[-1] + 1))
        text = np.repeat(np.arange(len(size)), parts)
        number = np.arange(offset[-1]) - offset[text]
        mark = np.zeros(len(size), dtype=np.int64)
        mark[chosen] = level
        content = sums(K.mix(member[use]), bounds)
        keys.append(K.mix(K.mix(content + K.U(2)) + mark[text].astype(np.uint64) * K.U(1 << 32) + number.astype(np.uint64)))
        texts.append(text)
    return np.concatenate(keys), np.concatenate(texts)


# bitmaps that rule pairs out: two sets differ by at least as many members as their bitmaps do in bits


def bitmaps(member, first):
    """(bits of each text's bitmap, all bitmaps one after the other): parity of the members of each remainder.

    A bitmap has at least as many bits as the set has members, a power of two.
    """
    size = np.diff(first)
    width = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(width)])
    doc = K.owners(first)
    place = start[doc] + (member & (width[doc] - 1).astype(np.uint64)).astype(np.int64)
    return width, np.packbits((np.bincount(place, minlength=start[-1]) & 1).astype(np.uint8)).tobytes()


def folded(maps):
    """Bitmaps of different lengths as rows of equal length: halves are added up, as remainders are."""
    least = min(map(len, maps))
    out = np.empty((len(maps), least), dtype=np.uint8)
    for length in set(map(len, maps)):
        rows = [i for i, m in enumerate(maps) if len(m) == length]
        part = np.frombuffer(b"".join(maps[i] for i in rows), dtype=np.uint8).reshape(len(rows), -1)
        while part.shape[1] > least:
            part = part[:, :part.shape[1] // 2] ^ part[:, part.shape[1] // 2:]
        out[rows] = part
    return out.view(np.uint64)


# which sets share a key


def send_sets(rule, block, table, buckets):
    ids, active = X.ids_of(table)
    member, first = shingle_sets(table.column("text"), rule.shingle)
    use = active & (np.diff(first) > 0)
    key, doc = set_keys(member, first)[use], ids[use]
    order = np.lexsort((doc, key))
    cuts = K.group_starts(key[order])
    return X.to_buckets(block, SETS, buckets, key[order][cuts], doc[order][cuts])


def same_sets(bucket, table):
    src, h, x, _ = X.gather(table, SETS)
    if not len(h):
        return []
    order = np.argsort(h, kind="stable")
    cuts = K.group_starts(h[order])
    least = np.repeat(np.minimum.reduceat(x.view(np.int64)[order], cuts), np.diff(np.append(cuts, len(h))))
    return X.back(bucket, SETS, src[order], h[order], least)


def send_keys(rule, block, table, found, buckets):
    """Keys of one document per distinct set; and for all documents size and that document."""
    ids, active = X.ids_of(table)
    member, first = shingle_sets(table.column("text"), rule.shingle)
    size = np.diff(first)
    key = set_keys(member, first)
    _, h, x, _ = X.gather(found, SETS)
    order = np.argsort(h, kind="stable")
    stands = ids.copy()
    use = np.flatnonzero(active & (size > 0))
    stands[use] = x.view(np.int64)[order][K.lookup(key[use], h[order])]
    # one row of the smallest id with the set: ids and sets can repeat
    own = use[stands[use] == ids[use]]
    _, one = np.unique(np.column_stack([ids[own].view(np.uint64), key[own]]), axis=0, return_index=True)
    own = np.sort(own[one])
    by = np.argsort(ids.view(np.uint64), kind="stable")
    # every row's size, also of rows without an id
    out = [(block % buckets, block, SIZE, ids[by].view(np.uint64), size[by], (~active[by]).astype(np.uint64))]
    copies = use[stands[use] != ids[use]]
    if len(copies):
        by = np.argsort(ids[copies].view(np.uint64))
        out.append((block % buckets, block, SAME, ids[copies][by].view(np.uint64), stands[copies][by], None))
    by = own[np.argsort(ids[own].view(np.uint64), kind="stable")]
    if len(by):
        bounds = np.concatenate([[0], np.cumsum(size[by])])
        chosen = np.concatenate([member[first[i]:first[i + 1]] for i in by.tolist()])
        width, maps = bitmaps(chosen, bounds)
        out.append((block % buckets, block, BITMAP, ids[by].view(np.uint64), maps, width))
    keys, docs, marks = [], [], []
    for i in own[size[own] < rule.boundary].tolist():
        # a set that can spare no member has its whole set as key: larger sets may hold it
        k, n = subset_keys(member[first[i]:first[i + 1]], rule)
        keys.append(k)
        docs.append(np.full(len(k), ids[i]))
        marks.append((size[i] << 32) + n)
    k, text = part_keys(member, first, own[size[own] >= rule.small()], rule)
    keys.append(k)
    docs.append(ids[text])
    marks.append(size[text] << 32)
    keys, docs, marks = np.concatenate(keys), np.concatenate(docs), np.concatenate(marks).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    out.extend(X.to_buckets(block, KEYS, buckets, keys[order], docs[order], marks[order]))
    return out


def meet(rule, bucket, table):
    """Links that subsets prove, and per list of parts the pairs with its first document."""
    out = []
    for row in table.select(["src", "kind", "n", "h", "x", "y"]).to_pylist():
        if row["kind"] in (SAME, SIZE, BITMAP):  # only passed on
            x = row["x"] if row["kind"] == BITMAP else K.unpack(row["x"], row["n"])
            y = K.unpack(row["y"], row["n"]) if row["y"] else None
            out.append((row["src"], bucket, row["kind"], K.unpack_sorted(row["h"], row["n"]), x, y))
    _, h, x, y = X.gather(table, KEYS)
    if not len(h):
        return out
    doc, size, subset = x.view(np.int64), (y >> K.U(32)).astype(np.int64), (y & K.U(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((doc, size, h))
    h, doc, size, subset = h[order], doc[order], size[order], subset[order]
    cuts = K.group_starts(h)
    length = np.diff(np.append(cuts, len(h)))
    head = np.repeat(cuts, length)
    others = np.arange(len(h)) != head
    # of a common subset, every set that links with any links with the smallest
    proved = others & (subset > 0) & rule.linked(subset, size, size[head]) & (doc != doc[head])
    links = np.unique(np.column_stack([doc[proved], doc[head][proved]]), axis=0)
    if len(links):
        by = np.argsort(links[:, 0].view(np.uint64), kind="stable")
        out.append((0, bucket, LINKED, links[by, 0].view(np.uint64), links[by, 1], None))
    # lists of the same documents are told once
    listed = (subset == 0) & np.repeat(length > 1, length)
    if listed.any():
        mark = sums(K.mix(doc.view(np.uint64)), np.append(cuts, len(h)))
        name = np.repeat(mark, length)
        _, one = np.unique(mark, return_index=True)
        chosen = np.zeros(len(cuts), dtype=bool)
        chosen[one] = True
        listed &= np.repeat(chosen, length)
        by = np.argsort(name[listed], kind="stable")
        out.append((0, bucket, LIST, name[listed][by], doc[listed][by], size[listed][by].astype(np.uint64)))
    return out


def flat(messages, kind, names):
    """The entries of one kind as rows of longs."""

    def run(batches):
        for batch in batches:
            _, h, x, y = X.gather(pa.Table.from_batches([batch]), kind)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (h, x, y)][:len(names)], names=list(names))

    return messages.where(F.col("kind") == kind).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def flat_bitmaps(messages):
    """(own, bitmap) of one document per distinct set; ids can repeat."""

    def run(batches):
        for batch in batches:
            for row in batch.select(["n", "h", "x", "y"]).to_pylist():
                ends = np.cumsum(K.unpack(row["y"], row["n"]).astype(np.int64) // 8).tolist()
                maps = [row["x"][a:b] for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([pa.array(K.unpack_sorted(row["h"], row["n"]).view(np.int64)), pa.array(maps, pa.binary())],
                                                 names=["own", "bitmap"])

    return messages.where(F.col("kind") == BITMAP).mapInArrow(run, "own long, bitmap binary")


def may_link(pairs, maps, rule):
    """The pairs (a, b, size_a, size_b) whose bitmaps do not rule a link out."""

    def run(batches):
        for batch in batches:
            near = []
            for a, b, total in zip(batch.column("map_a").to_pylist(), batch.column("map_b").to_pylist(),
                                   (batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()).tolist()):
                both = folded([a, b])
                apart = int(np.bitwise_count(both[0] ^ both[1]).sum())
                near.append(apart * (100 + rule.percent) <= (100 - rule.percent) * total)
            kept = batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
            yield kept

    one, two = (maps.select(F.col("own").alias(f"own_{k}"), F.col("bitmap").alias(f"map_{k}")) for k in "ab")
    joined = pairs.join(one, F.col("a") == F.col("own_a")).join(two, F.col("b") == F.col("own_b"))
    return joined.select("a", "b", "size_a", "size_b", "map_a", "map_b").mapInArrow(run, "a long, b long").distinct()


# exact comparison of candidate pairs


def compare(frame, count, pairs, rule):
    """The pairs (a, b) that link, by their whole sets.

    ``b`` goes to a task of its ``a``, about LEAVES to a task; ``a`` goes to each.
    """
    leaves = pairs.groupBy("a").agg(F.count("*").alias("n"))
    pairs = pairs.join(leaves, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / LEAVES)))
    pairs = pairs.withColumn("task", F.xxhash64("a", "part"))
    asked = pairs.select(F.col("b").alias("doc"), "task", F.lit(False).alias("centre")).union(
        pairs.select(F.col("a").alias("doc"), "task", F.lit(True).alias("centre")).distinct())
    asked = asked.withColumn("to", X.block_of("doc", count))

    def send(key, table, wanted):
        out = {"task": [], "doc": [], "centre": [], "n": [], "members": []}
        if wanted.num_rows and table.num_rows:
            table = X.in_order(table)
            ids, _ = X.ids_of(table)
            docs = wanted.column("doc").to_numpy()
            some = np.flatnonzero(np.isin(ids, docs) & ~table.column("doc_id").is_null().to_numpy())
            member, first = shingle_sets(table.column("text").take(pa.array(some)), rule.shingle)
            rows = {}
            for k, i in enumerate(some.tolist()):
                rows.setdefault(int(ids[i]), []).append(k)
            packed = {}
            for doc, task, centre in zip(docs.tolist(), wanted.column("task").to_pylist(), wanted.column("centre").to_pylist()):
                for k in rows.get(doc, ()):
                    if k not in packed:
                        packed[k] = K.pack_sorted(member[first[k]:first[k + 1]])
                    for name, value in zip(out, (task, doc, centre, int(first[k + 1] - first[k]), packed[k])):
                        out[name].append(value)
        return pa.table(out, schema=pa.schema([("task", pa.int64()), ("doc", pa.int64()), ("centre", pa.bool_()),
                                               ("n", pa.int32()), ("members", pa.binary())]))

    def check(key, table):
        links = {"a": [], "b": []}
        rows = table.to_pylist()
        for one in rows:
            if one["centre"]:
                own = K.unpack_sorted(one["members"], one["n"])
                for other in rows:
                    if not other["centre"] and other["doc"] != one["doc"]:
                        found = K.lookup(K.unpack_sorted(other["members"], other["n"]), own)
                        if len(found) and len(own) and rule.linked(int((found >= 0).sum()), len(own), len(found)):
                            links["a"].append(one["doc"])
                            links["b"].append(other["doc"])
        return pa.table(links, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    sets = frame.groupBy("block").cogroup(asked.groupBy("to")).applyInArrow(
        send, "task long, doc long, centre boolean, n int, members binary")
    return sets.groupBy("task").applyInArrow(check, "a long, b long")


def size_fits(rule):
    return F.col("size_a") * 100 >= F.col("size_b") * rule.percent


def open_lists(maps, lists, labels):
    """The members of lists that hold several components, with their bitmaps; in chunks that meet pairwise.

    Two members have been compared already: one of them is the smallest.
    """
    members = lists.join(labels, lists.doc == labels.node, "left").select(
        "name", "doc", "size", F.coalesce("component", "doc").alias("component"))
    split = members.groupBy("name").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    left = members.join(split.where("low < high AND n > 2").select("name", "n"), "name")
    rows = left.join(maps, left.doc == maps.own).select("name", "doc", "size", "component", "bitmap", "n")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc"), chunks).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return rows.withColumn("first", F.least("chunk", "with")).withColumn("second", F.greatest("chunk", "with"))


def near_pairs(table, low, high, rule):
    """Matrix of the pairs of two chunks in different components that bitmaps do not rule out."""
    chunk, doc = table.column("chunk").to_numpy(), table.column("doc").to_numpy()
    size, comp = table.column("size").to_numpy(), table.column("component").to_numpy()
    bits = folded(table.column("bitmap").to_pylist())
    left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    near = np.zeros((len(left), len(right)), dtype=bool)
    for row, i in enumerate(left.tolist()):
        apart = np.bitwise_count(bits[right] ^ bits[i]).sum(axis=1).astype(np.int64)
        # linked: difference <= (1 - t) / (1 + t) * (a + b)
        near[row] = (apart * (100 + rule.percent) <= (100 - rule.percent) * (size[right] + size[i])) & (comp[right] != comp[i])
    return doc[left], doc[right], near


def hubs(near):
    """Stars of a matrix of near pairs: (rows, columns) with each member in one star at most, largest first."""
    near, rows, columns = near.copy(), [], []
    while near.any():
        by_row, by_column = near.sum(axis=1), near.sum(axis=0)
        if by_row.max() >= by_column.max():
            hub = int(by_row.argmax())
            found = np.flatnonzero(near[hub])
            rows.append(np.full(len(found), hub))
            columns.append(found)
            near[hub] = False
            near[:, found] = False
        else:
            hub = int(by_column.argmax())
            found = np.flatnonzero(near[:, hub])
            rows.append(found)
            columns.append(np.full(len(found), hub))
            near[:, hub] = False
            near[found] = False
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns])


def undecided(maps, lists, labels, rule, buckets, stars):
    """Pairs of one list and different components that may link: stars of them, or all.

    A pair is in many lists: lists send packed pairs to hash ranges, where each is told once.
    """
    def pairs(key, table):
        left, right, near = near_pairs(table, key[1].as_py(), key[2].as_py(), rule)
        row, column = hubs(near) if stars else np.nonzero(near)
        a, b = np.minimum(left[row], right[column]), np.maximum(left[row], right[column])
        mark = K.mix(K.mix(a.view(np.uint64)) * K.ODD + b.view(np.uint64))
        _, one = np.unique(mark, return_index=True)
        return X.rows(X.to_buckets(0, LIST, buckets, mark[one], a[one], b[one]))

    def once(key, table):
        _, mark, a, b = X.gather(table, LIST)
        _, one = np.unique(mark, return_index=True)
        return pa.table({"a": a[one].view(np.int64), "b": b[one].view(np.int64)})

    packed = open_lists(maps, lists, labels).groupBy("name", "first", "second").applyInArrow(pairs, X.MESSAGE)
    return packed.groupBy("key").applyInArrow(once, "a long, b long")


def settle(frame, count, maps, lists, labels, rule, buckets):
    """Labels after comparing what the first comparison of every list has left open.

    First stars, which join most members of a large group by few comparisons; then all
    pairs that are left, which are those of texts that are near but do not link.
    """
    tried = None
    for stars in (True, False):
        pairs = undecided(maps, lists, labels, rule, buckets, stars)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            break  # where no star is left, no pair is
        links = materialize(compare(frame, count, pairs, rule), "links")
        if not links.isEmpty():
            labels = materialize(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "labels")
        tried = pairs
    return labels


def boundary(docs, shingle, percent, choices=(10, 20, 30)):
    """The set size below which listing subsets costs less than lists and comparisons.

    A subset key costs 1; a large set costs its part keys and, once, the sending of all
    its members. Sizes are taken from word counts of the whole table.
    """

    def run(batches):
        for batch in pieces(batches):
            _, _, first = K.words(*K.text_bytes(batch.column("text")))
            size, count = np.unique(np.maximum(np.diff(first) - shingle + 1, 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(count)], names=["size", "docs"])

    sizes = docs.select(F.col("text")).mapInArrow(run, "size long, docs long").where(f"size < {max(choices)}")
    sizes = sizes.groupBy("size").agg(F.sum("docs").alias("docs")).collect()  # a row per size below the last choice
    cost = {}
    for choice in choices:
        rule = Rule(shingle, percent, choice)
        cost[choice] = sum(
            row["docs"] * (sum(math.comb(row["size"], k) for k in range(rule.spare(row["size"]) + 1)) if row["size"] < choice
                           else 2 * rule.parts(-(-row["size"] * 100 // percent)) + row["size"]) for row in sizes)
    return min(cost, key=lambda c: (cost[c], c))


def jaccard_components(docs, shingle=3, percent=90, id_col="doc_id", text_col="text", **sizes):
    """Documents whose shingle sets link, and the components of their links.

    Words are runs of non-blank characters, A-Z lower-cased; two documents link when 100 *
    intersection >= ``percent`` * union of their distinct ``shingle``-word shingles. Returns
    doc_id, n_shingles, component_id (smallest id reachable by links, itself included)
    and representative (smallest id with the very same set), one row per input row.
    A text with fewer words has its whole sequence as one shingle; null and blank texts have
    none and link with nothing. Rows without an id have a null component; rows with equal
    ids are one document in links. Other columns are not read. Only components are
    returned, not the linked pairs: pairs inside one component are not all compared.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rule = Rule(shingle, percent, boundary(docs, shingle, percent))
    frame, buckets, count = X.blocks(docs, **sizes)
    sets = X.resolve(X.emit(frame, lambda block, table: send_sets(rule, block, table, buckets)), same_sets)
    keys = X.answer(frame, sets, lambda block, table, found: send_keys(rule, block, table, found, buckets))
    met = materialize(X.resolve(keys, lambda bucket, table: meet(rule, bucket, table)), "met")
    same = flat(met, SAME, ("doc", "rep"))
    links = flat(met, LINKED, ("a", "b"))
    lists = materialize(flat(met, LIST, ("name", "doc", "size")).distinct(), "lists")
    # every list is first compared with its smallest document
    maps = materialize(flat_bitmaps(met), "bitmaps")
    centre = lists.groupBy("name").agg(F.min(F.struct("doc", "size")).alias("c"))
    tried = lists.join(centre, "name").where("doc != c.doc").select(
        F.col("c.doc").alias("a"), F.col("doc").alias("b"), F.least("c.size", "size").alias("size_a"),
        F.greatest("c.size", "size").alias("size_b")).where(size_fits(rule)).distinct()
    tried = may_link(tried, maps, rule)
    found = materialize(compare(frame, count, materialize(tried, "tried"), rule).union(links), "links")
    labels = materialize(components(found), "labels")
    labels = settle(frame, count, maps, lists, labels, rule, buckets)
    return report(flat(met, SIZE, ("id", "n", "none")), same, labels)


def report(rows, same, labels):
    rows = rows.select(F.when(F.col("none") == 0, F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"))
    same = same.groupBy("doc").agg(F.min("rep").alias("rep"))
    known = same.join(labels, same.rep == labels.node, "left").select("doc", "rep", F.coalesce("component", "rep").alias("component"))
    known = known.union(labels.select("node", "node", "component").join(same, F.col("node") == same.doc, "left_anti"))
    out = rows.join(known, rows.doc_id == known.doc, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                      F.coalesce("rep", "doc_id").alias("representative"))
