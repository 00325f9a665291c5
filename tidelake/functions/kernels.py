"""Small per-batch helpers that run in Python workers.

They are pickled by value, so workers need no copy of this package.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: separators of the recursive text splitter, coarse to fine
SEPARATORS = ("\n\n", "\n", " ", "")


def split_pieces(text, size, separators=SEPARATORS):
    """(start, end) spans of at most ``size`` characters that cover ``text``."""
    spans, todo = [], [(0, len(text), 0)]
    while todo:
        start, end, level = todo.pop()
        if end - start <= size:
            if end > start:
                spans.append((start, end))
            continue
        while separators[level] and text.find(separators[level], start, end) < 0:
            level += 1
        mark = separators[level]
        if not mark:
            spans.extend((at, min(at + size, end)) for at in range(start, end, size))
            continue
        cuts, at = [start], text.find(mark, start, end)
        while at >= 0:
            if at + len(mark) < end:
                cuts.append(at + len(mark))
            at = text.find(mark, at + len(mark), end)
        cuts.append(end)
        # pushed backwards so that spans come out in reading order; a piece that
        # is still too long goes on with the next finer separator
        todo.extend((cuts[i], cuts[i + 1], level + 1) for i in range(len(cuts) - 2, -1, -1))
    return spans


def merge_pieces(spans, size, overlap):
    """Join neighbouring spans into chunks up to ``size``, sharing up to ``overlap``."""
    chunks, first = [], 0
    for i, (start, end) in enumerate(spans):
        if end - spans[first][0] > size:
            chunks.append((spans[first][0], spans[i - 1][1]))
            while first < i and (spans[i - 1][1] - spans[first][0] > overlap
                                 or end - spans[first][0] > size):
                first += 1
    if spans:
        chunks.append((spans[first][0], spans[-1][1]))
    return chunks


def chunk_text(text, size, overlap):
    return merge_pieces(split_pieces(text, size), size, overlap)


def chunk_slices(texts, size, overlap):
    """For each slice of an Arrow array of texts the chunks as columns: place of the text, number, start, chunk."""
    for first, end in text_slices(texts):
        rows = [(at, number, start, text[start:stop])
                for at, text in enumerate(texts.slice(first, end - first).to_pylist(), first) if text is not None
                for number, (start, stop) in enumerate(chunk_text(text, size, overlap))]
        if rows:
            yield zip(*rows)


def token_bucket(token, dim):
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


# bytes of text that are worked on at once
TEXT_BYTES = 4 << 20


def text_slices(texts):
    """(start, end) of runs of rows of up to ``TEXT_BYTES`` of text, one row at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right")))
        yield start, end
        start = end


def hashed_texts(texts, dim):
    """Unit vectors of hashed token counts for an Arrow array of texts; NULL stays NULL.

    The tokens of a batch take several times its bytes, so it is cut into slices.
    """
    known = {}
    parts = [_hashed_slice(texts.slice(start, end - start), dim, known) for start, end in text_slices(texts)]
    return pa.concat_arrays(parts) if parts else _hashed_slice(texts, dim, known)


def _hashed_slice(texts, dim, known):
    """Tokens are split, numbered and counted by Arrow and numpy; only those not yet ``known`` are hashed one by one."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), "[ \\t\\r\\n]+")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    for word in words:
        if word not in known:
            known[word] = token_bucket(word, dim) if word else -1
    buckets = np.array([known[word] for word in words], dtype=np.int64)
    bucket = buckets[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, dtype=np.int64)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    used = bucket >= 0
    grid = np.bincount(row[used] * dim + bucket[used], minlength=len(texts) * dim).astype(np.float64)
    grid = grid.reshape(len(texts), dim)
    length = np.sqrt((grid * grid).sum(axis=1, keepdims=True))
    flat = (grid / np.where(length > 0, length, 1.0)).ravel()
    starts = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(starts, pa.array(flat), mask=texts.is_null())


def stack_vectors(column, dim=None):
    """(matrix, length of each whole vector) from an Arrow list column.

    The first ``dim`` positions count, as in ``vector.dot``; a shorter vector raises.
    """
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = int(size[0]) if dim is None and len(size) else dim or 0
    if (size < dim).any():
        raise ValueError("second vector is shorter than the first")
    first = np.cumsum(size) - size
    length = np.sqrt(np.add.reduceat(np.append(flat * flat, 0.0), first)) if len(size) else np.empty(0)
    length[size == 0] = 0.0
    return flat[first[:, None] + np.arange(dim)], length


def lloyd(rows, k, seed, rounds=10):
    """At most ``k`` centres of rows: distinct rows drawn by distance, then moved to the means of their rows."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.integers(len(rows))][None, :]
    far = ((rows - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(k, len(rows)) and far.sum() > 0:
        centres = np.vstack([centres, rows[rng.choice(len(rows), p=far / far.sum())]])
        far = np.minimum(far, ((rows - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = nearest_rows(rows, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_rows(rows, centres):
    """Number of the nearest centre of each row."""
    return ((centres ** 2).sum(1)[None, :] - 2.0 * rows @ centres.T).argmin(axis=1)


def nearest_centres(rows, tops, members, centres):
    """The centre next to each row among the ``members`` of its nearest coarse centre."""
    out, top = np.empty(len(rows), dtype=np.int32), nearest_rows(rows, tops) if len(rows) else np.empty(0, dtype=int)
    for c in np.unique(top):
        at = np.flatnonzero(top == c)
        out[at] = members[c][nearest_rows(rows[at], centres[members[c]])]
    return out


def score_matrix(questions, corpus, metric, lengths):
    """Scores, larger is nearer (distances are negated); distances are near the exact ones only."""
    if metric == "l2":
        squares = (questions ** 2).sum(1)[:, None] + (corpus ** 2).sum(1)[None, :] - 2.0 * questions @ corpus.T
        return -np.sqrt(np.maximum(squares, 0.0))
    scores = questions @ corpus.T
    if metric == "cosine":
        whole = np.linalg.norm(questions, axis=1)[:, None] * lengths[None, :]
        scores = np.divide(scores, whole, out=np.full_like(scores, np.nan), where=whole > 0)
    scores = np.round(scores, 6)
    return np.where(np.isnan(scores), -np.inf, scores)


def distance_error(questions, corpus):
    """How far a distance by ``score_matrix`` can be from the exact one: squares cancel."""
    most = (questions ** 2).sum(1).max(initial=0.0) + (corpus ** 2).sum(1).max(initial=0.0)
    return 2.0 * np.sqrt(most * questions.shape[1] * 1e-15) + 1e-6


def exact_distances(questions, corpus):
    return -np.round(np.sqrt(((questions - corpus) ** 2).sum(axis=1)), 6)


def score_error(questions, corpus, metric):
    """How far a score by ``score_matrix`` can be from the exact one before both are rounded."""
    if metric == "l2":
        return distance_error(questions, corpus)
    most = 1.0 if metric == "cosine" else np.sqrt((questions ** 2).sum(1).max(initial=0.0) * (corpus ** 2).sum(1).max(initial=0.0))
    return 2e-6 + most * questions.shape[1] * 1e-14


def fewer_copies(matrix, lengths, ids, k):
    """Positions of the rows that can be in a top k: of equal vectors the ``k`` with the smallest ids; None for all.

    ``ids`` are Arrow columns in the order of ties.
    """
    if len(matrix) <= k or any(pa.types.is_nested(column.type) for column in ids):
        return None
    whole = np.ascontiguousarray(np.column_stack([matrix, lengths]))
    _, group, count = np.unique(whole.view(np.dtype((np.void, whole.strides[0]))).ravel(), return_inverse=True, return_counts=True)
    many = count[group] > k
    if not many.any():
        return None
    at = np.flatnonzero(many)
    crowd = pa.table([pa.array(group[at]), *[column.take(pa.array(at)) for column in ids]], names=[str(i) for i in range(len(ids) + 1)])
    order = pc.sort_indices(crowd, sort_keys=[(name, "ascending") for name in crowd.column_names], null_placement="at_start").to_numpy()
    own = group[at][order]
    first = np.arange(len(own)) - np.searchsorted(own, own) < k
    return np.sort(np.concatenate([np.flatnonzero(~many), at[order[first]]]))


def better_rows(scores, floor, k, slack=0.0):
    """Positions that can still reach the top k of their question.

    ``floor`` holds each question's k-th best score so far; ties are kept, and whatever
    ``slack``, the error of a score, may hide.
    """
    if scores.shape[1] > k:
        best = -np.partition(-scores, k - 1, axis=1)[:, k - 1] - slack
        floor = np.maximum(floor, best)
    at = np.nonzero((scores + slack >= floor[:, None]) & (scores > -np.inf))
    return at[0], at[1]


# pairs whose vectors are held at once
PAIRS = 100_000


def pair_distances(questions, corpus, q, r):
    """Exact distances of the listed pairs of rows."""
    parts = [exact_distances(questions[q[low:low + PAIRS]], corpus[r[low:low + PAIRS]]) for low in range(0, len(q), PAIRS)]
    return np.concatenate(parts) if parts else np.empty(0)


def keep_top(frame, k, question, ids):
    """The k best rows of every question, ties by id."""
    frame = frame.sort_values([question, "score", *ids], ascending=[True, False] + [True] * len(ids))
    return frame.groupby(question, sort=False).head(k)


# scores held in memory at once
SCORE_CELLS = 8_000_000


def top_rows(batches, questions, names, k, metric, ids, exclude_self, carry=()):
    """Best k rows per question over an iterator of (first id column, matrix, lengths, take).

    ``take`` gives the frame of the ids of the rows at the listed positions, or of other columns.
    Distances are taken again by differences for the rows that may be among the nearest. The
    columns to ``carry`` are fetched once per row, and only for the best k of a batch.
    """
    best, pending, waiting = None, [], 0
    floor = np.full(len(names), -np.inf)
    step = max(1, SCORE_CELLS // max(1, len(names)))
    places = pd.Index(names) if exclude_self else None

    def merged():
        found = keep_top(pd.concat([*pending] if best is None else [best, *pending], ignore_index=True), k, "_q", ids)
        full = found.groupby("_q")["score"].agg(["size", "min"])
        full = full[full["size"] >= k]
        floor[full.index.to_numpy()] = full["min"].to_numpy()
        return found

    for keys, matrix, lengths, take in batches:
        slack = distance_error(questions, matrix) if metric == "l2" else 0.0
        for low in range(0, len(matrix), step):
            scores = score_matrix(questions, matrix[low:low + step], metric, lengths[low:low + step])
            if exclude_self:
                own = places.get_indexer(keys[low:low + step])
                rows = np.nonzero(own >= 0)[0]
                scores[own[rows], rows] = -np.inf
            q, r = better_rows(scores, floor, k, slack)
            if not len(r):
                continue
            found = take(r + low)
            found.insert(0, "_q", q)
            found["score"] = pair_distances(questions, matrix, q, r + low) if metric == "l2" else scores[q, r]
            if carry:
                found = keep_top(found.assign(_at=r + low), k, "_q", ids)
                rows, own = np.unique(found["_at"].to_numpy(), return_inverse=True)
                held = take(rows, carry).iloc[own].set_axis(found.index)
                found = pd.concat([found.drop(columns="_at"), held], axis=1)
            pending.append(found)
            waiting += len(found)
            if best is None or waiting > 2 * len(best):
                best, pending, waiting = merged(), [], 0
    return merged() if pending else best


def probed_cells(questions, centres, sizes, probes, k):
    """For every question the places of the ``probes`` nearest centres, and of further ones until their cells hold ``k`` rows."""
    out = []
    for question in questions:
        distance = -exact_distances(question[None, :], centres)
        # the k nearest cells hold k rows at least: none is empty
        near = np.argsort(distance, kind="stable")[:max(probes, k)]
        near = near[np.isfinite(distance[near])]
        held = np.cumsum(sizes[near]) - sizes[near]
        out.append(near[(np.arange(len(near)) < probes) | (held < k)])
    return out


def missing_values(column, dim=None):
    """Which vectors of an Arrow list column have a NULL among the first ``dim`` positions, or anywhere."""
    missing = np.zeros(len(column), dtype=bool)
    if column.flatten().null_count:
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(column)), size)
        place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        null = column.flatten().is_null().to_numpy(zero_copy_only=False)
        missing[row[null & (place < (len(row) if dim is None else dim))]] = True
    return missing


def pair_scores(questions, corpus, lengths, q, r, metric):
    """Scores of the listed pairs of rows, added up position by position as ``vector.l2`` and the others do."""
    a, b = questions[q], corpus[r]
    terms = (a - b) ** 2 if metric == "l2" else a * b
    total = np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))
    if metric == "cosine":
        whole = np.sqrt((a * a).sum(axis=1)) * lengths[r]
        return np.divide(total, whole, out=np.zeros_like(total), where=whole != 0), whole == 0
    return np.sqrt(total) if metric == "l2" else total, np.zeros(len(total), dtype=bool)


def near_in_cells(batches, questions, visits, k, metric):
    """Scored pairs that may be among the best ``k`` of a question, over an iterator of (cells, ids, matrix, lengths, missing).

    ``visits`` has the numbers of the questions that probe a cell. Yields lists for up to ``PAIRS`` pairs: question, row of the
    batch, score and whether it is unknown. The k-th best score so far bounds what is handed on; only these bounds are kept.
    Rows whose score is not a number are always handed on.
    """
    best = np.full((len(questions), k), -np.inf)
    for cells, ids, matrix, lengths, missing in batches:
        odd = missing | ~np.isfinite(matrix).all(axis=1)
        for cell in np.unique(cells):
            asked = visits.get(int(cell), ())
            rows = np.flatnonzero(cells == cell) if len(asked) else ()
            few = fewer_copies(matrix[rows], lengths[rows], [ids.take(pa.array(rows))], k) if len(rows) else None
            rows = rows if few is None else rows[few]
            step = max(1, SCORE_CELLS // max(1, len(asked)))
            for low in range(0, len(rows), step):
                some = rows[low:low + step]
                plain = matrix[some] if not odd[some].any() else np.where(odd[some][:, None], 0.0, matrix[some])
                scores = score_matrix(questions[asked], plain, metric, lengths[some])
                slack = score_error(questions[asked], plain, metric)
                scores[:, odd[some]] = -np.inf
                top = scores - slack
                if top.shape[1] > k:
                    top = np.partition(top, top.shape[1] - k, axis=1)[:, -k:]
                top = np.concatenate([best[asked], top], axis=1)
                best[asked] = np.partition(top, top.shape[1] - k, axis=1)[:, -k:]
                q, r = np.nonzero((scores + slack >= best[asked].min(axis=1)[:, None]) | (scores == -np.inf))
                for start in range(0, len(q), PAIRS):
                    number, row = asked[q[start:start + PAIRS]], some[r[start:start + PAIRS]]
                    score, unknown = pair_scores(questions, matrix, lengths, number, row, metric)
                    yield number, row, score, unknown | missing[row]
