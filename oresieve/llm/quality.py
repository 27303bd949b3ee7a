"""Quality rules: counts per text, and repetition inside a text by suffix arrays over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import named, slices, small_batches

#: Words of the shortest repeat that counts.
LEAST_REPEAT = 8
#: Texts with fewer words fail; so do texts whose repeats cover a larger part of the words, or of which one repeat is longer.
LEAST_WORDS, MOST_COVERED, LONGEST_REPEAT = 20, 0.30, 200
#: Text bytes in one numpy pass; a single longer text is a pass of its own.
PASS_BYTES = 2_000_000
#: Suffixes whose groups are split at once; words compared at once.
SPLIT, RUN = 1 << 20, 64
SYMBOLS = "[#*$%&|<>]"
BLANK = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")


def suffix_array(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of all suffixes of all texts of a pass, by prefix doubling: by text, then by words; a suffix ends with its text.

    words: a number for each word; doc: the text of each word, ascending; ends: for each word, the end of its text.
    A rank is where a group of suffixes that agree so far begins in the order. Groups that are not yet alone are split by the ranks that
    lie behind what they share, some at a time, so that little more than the order and one array of ranks is held.
    """
    n = len(words)
    key = words if not n or doc[0] == doc[-1] else doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).astype(np.int32)
    del key
    sizes = np.diff(np.r_[starts, np.int32(n)])
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(starts, sizes)
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    span = 1
    while len(starts):
        total = np.cumsum(sizes, dtype=np.int64)
        cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(SPLIT, total[-1], SPLIT)) + 1, len(starts)])
        split = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            first, size = starts[a:b], sizes[a:b]
            slot = np.repeat(first - (total[a:b] - size), size) + np.arange(total[a] - size[0], total[b - 1])
            open_ = order[slot]
            after = open_.astype(np.int64) + span
            key = np.where(after < ends[open_], rank[np.minimum(after, n - 1)] + 1, 0) + np.repeat(np.arange(b - a), size) * (n + 2)
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            order[slot] = open_
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[at, len(key)])
            rank[open_] = np.repeat(slot[at], size)
            split.append((slot[at][size > 1].astype(np.int32), size[size > 1].astype(np.int32)))
        starts, sizes = (np.concatenate([x[k] for x in split]) for k in (0, 1))
        span *= 2
    return order


def _common(words: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The words that suffixes a and b share at their beginnings: word by word for all at once, then long ones by runs."""
    shared = np.zeros(len(a), np.int32)
    most = np.minimum(ends[a] - a, ends[b] - b)
    open_, k = np.flatnonzero(most > 0), 0
    while len(open_) and k < RUN:
        open_ = open_[words[a[open_] + k] == words[b[open_] + k]]
        k += 1
        shared[open_] = k
        open_ = open_[most[open_] > k]
    for i in open_.tolist():
        x, y, length, end = int(a[i]), int(b[i]), k, int(most[i])
        step = RUN
        while length < end:
            step = min(2 * step, end - length)
            differ = words[x + length : x + length + step] != words[y + length : y + length + step]
            if differ.any():
                length += int(differ.argmax())
                break
            length += step
        shared[i] = length
    return shared


def repeats(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int = LEAST_REPEAT) -> np.ndarray:
    """For each word, the length of the longest repeat of `least` words or more that starts there, else 0.

    A neighbour in the suffix array shares the longest prefix that any other suffix shares, so the larger of the two
    common prefixes is the longest repeated substring at that place. Where the words before a suffix and before its neighbour are equal,
    the common prefix is that of the place before less one; only at the others are words compared.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int32)
    order = suffix_array(words, doc, ends)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    del order
    at = np.flatnonzero(before >= 0)
    before[at[doc[before[at]] != doc[at]]] = -1
    follows = np.zeros(n, bool)
    at = np.flatnonzero(before > 0)
    at = at[at > 0]
    other = before[at]
    follows[at] = (words[at - 1] == words[other - 1]) & (doc[at - 1] == doc[at]) & (doc[other - 1] == doc[at])
    common = np.zeros(n, np.int32)
    at = np.flatnonzero(~follows & (before >= 0))
    common[at] = _common(words, ends, at, before[at])
    del at, other
    place = np.arange(n, dtype=np.int32)
    start = np.maximum.accumulate(np.where(follows, 0, place))
    common = common[start] - (place - start)
    del start, place
    longest = common.copy()
    at = np.flatnonzero(before >= 0)
    longest[before[at]] = np.maximum(longest[before[at]], common[at])
    longest[longest < least] = 0
    return longest


def covered(longest: np.ndarray) -> np.ndarray:
    """The union of the repeats' spans: whether each word lies in one. Repeats end inside their own text."""
    place = np.arange(len(longest), dtype=np.int32)
    return place < np.maximum.accumulate(np.where(longest > 0, place + longest, 0))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _words(texts: pa.Array):
    """All words of the texts in one flat array, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))].astype(np.int64)
    return flat.filter(full), kept[offsets]


def count_texts(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of COUNTS for a few texts."""
    arr = pa.array(texts, pa.large_string())
    symbols = pc.count_substring_regex(arr, SYMBOLS).to_numpy(zero_copy_only=False)
    dup = []
    for text in texts:
        lines = [x for x in text.split("\n") if x.strip(BLANK)]
        dup.append(len(lines) - len(set(lines)))
    del lines
    flat, offsets = _words(arr)
    del arr
    n = np.diff(offsets)
    chars = _sums(pc.utf8_length(flat).to_numpy(zero_copy_only=False), offsets)
    # a pass has fewer than 2^31 words, as a row's text has fewer bytes
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32) if len(flat) else np.zeros(0, np.int32)
    del flat
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    longest = repeats(ids, doc, np.repeat(offsets[1:].astype(np.int32), n))
    top = np.zeros(len(texts), np.int64)
    at = np.flatnonzero(longest)
    np.maximum.at(top, doc[at], longest[at])
    return dict(zip(COUNTS, (n, chars, symbols, np.array(dup, np.int64), _sums(covered(longest), offsets), top), strict=True))


def quality_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """The input's rows with COUNTS added as long columns; a column of the input that has the name of a new one is replaced,
    unless a prefix keeps them apart.

    No shuffle: each text is counted where it is read. A null text has no words; a row stays a row, repeated or not; an
    empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    new = [prefix + c for c in COUNTS]
    kept = [c for c in docs.columns if c.lower() not in new]
    carried = kept if text in kept else [*kept, text]
    at = carried.index(text)

    def count(batches):
        for batch in batches:
            column = batch.column(at).fill_null("")
            sizes = pc.binary_length(column).to_pylist()
            parts = [count_texts(column.slice(a, b - a).to_pylist()) for a, b in slices(sizes, PASS_BYTES)]
            counts = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *counts], names=[*kept, *new])

    schema = docs.select(*kept).schema
    for c in new:
        schema = schema.add(c, "long", False)
    return docs.select(*carried).mapInArrow(count, schema)


def verdicts(counts: DataFrame, prefix: str = "", least_words: int = LEAST_WORDS, most_covered: float = MOST_COVERED, longest: int = LONGEST_REPEAT) -> DataFrame:
    """Adds base_failed and kept. The suffix arrays' verdict limits the part of the words under repeats and the longest repeat."""
    n, rep, top = (F.col(prefix + c) for c in ("n_words", "n_repeat_words", "longest_repeat"))
    failed = (n < 20) | (100 * rep > 30 * n)
    good = (n >= least_words) & (rep <= most_covered * n) & (top <= longest)
    return counts.withColumn(prefix + "base_failed", failed).withColumn(prefix + "kept", ~failed & good)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes, with the input's columns. A null or empty text does not; repeated rows all stay or all go."""
    prefix = named("q_", [c[:2] for c in docs.columns])
    return verdicts(quality_counts(docs, text, prefix), prefix).where(F.col(prefix + "kept")).select(*docs.columns)
