"""Rule statistics of whole texts, one row per document."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidelake.llm import kernels as K
from tidelake.llm.op8_lines import line_spans
from tidelake.llm.op9_decontaminate import pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_letters",
          "n_upper", "n_digits", "n_marks", "n_bangs", "n_distinct"]
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
LETTERS = K.byte_table((0x41, 0x5A), (0x61, 0x7A))
UPPER = K.byte_table((0x41, 0x5A))
DIGITS = K.byte_table((0x30, 0x39))
MARKS = np.isin(np.arange(256), list(b".,;:!?"))


def per_text(values, offsets):
    """Sums of a mask over each text."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


def repeated(owner, h):
    """Mask of items whose hash comes again in the same text, and mask of all but the first."""
    key = K.mix(h + owner.astype(np.uint64) * K.ODD)
    order = np.argsort(key, kind="stable")
    cuts = K.group_starts(key[order])
    sizes = np.diff(np.append(cuts, len(key)))
    again, later = np.zeros(len(key), dtype=bool), np.ones(len(key), dtype=bool)
    again[order] = np.repeat(sizes > 1, sizes)
    later[order[cuts]] = False
    return again, later


def counts(column, window=5):
    """The COUNTS of each text as a list of arrays."""
    data, offsets = K.text_bytes(column)
    n = len(offsets) - 1
    starts, ends, first = K.words(data, offsets)
    h = K.span_hashes(data, starts, ends)
    owner = K.owners(first)
    _, word_again = repeated(owner, h)
    whole = K.window_hashes(h, window)
    at = np.flatnonzero(owner[:len(whole)] == owner[window - 1:][:len(whole)])
    again, _ = repeated(owner[at], whole[at])
    inside = K.covered(at[again], at[again] + window, len(h))
    line_starts, line_ends, first_line = line_spans(data, offsets)
    solid = np.concatenate([[0], np.cumsum(K.WORD[data])])
    with_word = solid[line_ends] > solid[line_starts]
    line_owner = K.owners(first_line)[with_word]
    _, line_again = repeated(line_owner, K.span_hashes(data, line_starts[with_word], line_ends[with_word]))
    point = (data & 0xC0) != 0x80
    return [np.diff(first), per_text(point & K.WORD[data], offsets), per_text(SYMBOLS[data], offsets),
            np.bincount(line_owner[line_again], minlength=n), per_text(inside, first), np.diff(first_line),
            per_text(point, offsets), per_text(LETTERS[data], offsets), per_text(UPPER[data], offsets),
            per_text(DIGITS[data], offsets), per_text(MARKS[data], offsets), per_text(data == 33, offsets),
            per_text(~word_again, first)]


def statistics(docs, id_col="doc_id", text_col="text"):
    """doc_id and the COUNTS of every document; a null text counts as an empty one."""

    def run(batches):
        for batch in pieces(batches):
            columns = [pa.array(c.astype(np.int64)) for c in counts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *COUNTS])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *COUNTS]))


#: shares and sizes that rules and splits look at
FEATURES = {
    "log_words": "ln(1 + n_words)", "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)", "upper": "n_upper / greatest(n_letters, 1)",
    "digits": "n_digits / greatest(n_chars, 1)", "marks": "n_marks / greatest(n_words, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)", "distinct": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def with_features(stats):
    return stats.withColumns({name: F.expr(e).cast("double") for name, e in FEATURES.items()})
