"""Benchmark decontamination by edit distance.

An item is found in a text if some stretch of the text, of any length, is within a fifth of the
item's words of it in edit distance (insertions, deletions and replacements of words; case and
punctuation do not count). Such a stretch is at most a fifth shorter or longer than the item.

The CGK embedding maps edit distance to Hamming distance: a random walk reads the words of a
string, writes the current one at each of three times as many steps, and moves on or not by a
random bit of step and word. Strings with few edits meet again after each of them, so most of
what they write is the same. Bit-sampling LSH draws some steps of a walk and looks up windows that
wrote the same there as an item; that is repeated, with other walks and steps, until the target
recall is reached for edits at the threshold. Windows are as long as the item, from the first word of
a stretch on, padded past the end of the text. Candidates are verified by the exact edit distance of
the item to the best stretch around the window.

Only windows with enough pairs of neighbouring words that occur in items of their length are
embedded. A deletion or replacement spoils two pairs of an item at most, an insertion one, and the
window cuts off at most one pair for each insertion. So the window where a stretch within the
threshold starts keeps the others, and this loses none. Where an item is so long that no reasonable
number of lookups reaches the target, all windows that keep enough pairs are candidates: an exact way,
and a cheap one, as few windows keep more than half of the pairs of a long item.

Candidates of a text and an item that lie next to each other are verified together, by one edit
distance of the item to the best stretch of their joint surroundings.

Items are a stated query set: they are taken in blocks of bounded size, each of which meets all
texts in place. Texts are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import stored, text_bytes

SIMILARITY = 0.8
TARGET_RECALL = 0.99
#: Steps drawn for a lookup, and lookups on each walk.
SAMPLED_STEPS = 3
LOOKUPS_PER_WALK = 6
#: Items sent to the tasks at once, and words of theirs.
BLOCK_ITEMS = 2_000
BLOCK_WORDS = 200_000
#: Words of embedded windows and cells of compared pairs at once: bounds the memory of a task.
WINDOW_WORDS, PAIR_CELLS = 1_000_000, 2_000_000
#: Items that would need more lookups are searched exactly.
MOST_REPEATS = 120
TRIALS = 500
WORD = re.compile(r"\w+")
_SEED = 20240229


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def allowed_edits(n: int, similarity: float) -> int:
    return int(np.floor((1 - similarity) * n + 1e-9))


def best_stretches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``a`` the edit distance to the best stretch of the row of ``b``, and where that
    starts, the first of equally good ones. What is -2 in ``b`` is outside its text."""
    pairs, n = a.shape
    m = b.shape[1]
    # One number for edits and start, so that one pass finds the least of both, edits first.
    edit = m + 1
    kind = np.int32 if (2 * n + m + 2) * edit < 2**31 else np.int64
    steps = np.arange(m + 1, dtype=kind)
    row = np.tile(steps, (pairs, 1))
    inside = np.flatnonzero((b == -2).any(axis=1))
    for k in inside:  # no stretch starts before its text
        row[k, : int(np.argmax(b[k] != -2))] = (n + 1) * edit
    for i in range(n):
        best = np.empty_like(row)
        best[:, 0] = row[:, 0] + edit
        replaced = row[:, :-1] + (a[:, i : i + 1] != b) * kind(edit)
        np.minimum(replaced, row[:, 1:] + kind(edit), out=best[:, 1:])
        # Insertions: the least of best[k] + (j - k) edits over k <= j.
        best -= steps * kind(edit)
        row = np.minimum.accumulate(best, axis=1)
        row += steps * kind(edit)
    return np.divmod(row.min(axis=1), edit)


def walk(strings: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """CGK embedding of rows of word codes, padded on the right: what each wrote in twice as many
    steps as it has words (later steps mostly find the string at its end), -1 past its end."""
    count, n = strings.shape
    out = np.full((2 * n, count), -1, np.int64)
    at = np.zeros(count, np.int64)
    flat = np.concatenate([strings, np.full((count, 1), -1, np.int64)], axis=1).ravel()
    base = np.arange(count) * (n + 1)
    for step in range(2 * n):
        word = np.where(at < lengths, flat[base + at], -1)
        out[step] = word
        bits = (word + 1).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits ^= np.uint64((seed * 1_000_003 + step) * 0xD1B54A32D192ED03 & (2**64 - 1))
        bits ^= bits >> np.uint64(29)
        bits *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.minimum(at + (bits >> np.uint64(63)).view(np.int64), lengths)
    return out


def _lookup_keys(embedded: np.ndarray, lengths: np.ndarray, lookup: int) -> np.ndarray:
    """What was written at some steps, drawn as shares of the length, with the length."""
    draw = np.random.default_rng([_SEED, lookup])
    rows = np.arange(len(lengths))
    key = lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for share in draw.random(SAMPLED_STEPS):
        written = embedded[(share * 2 * lengths).astype(np.int64), rows]
        key = (key ^ written.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


@lru_cache(maxsize=512)
def repeats_for(n: int, edits: int, recall: float) -> int | None:
    """Lookups needed for strings of ``n`` words at ``edits`` edits, from simulated ones: random
    strings, edited at random, looked up with the walks of the first lookups. None if
    ``MOST_REPEATS`` do not reach the recall."""
    if edits == 0:
        return 1
    draw = np.random.default_rng([_SEED, n, edits])
    a = draw.integers(1 << 20, 1 << 40, (TRIALS, n))
    b = np.empty_like(a)
    for k in range(TRIALS):
        string = a[k].tolist()
        for _ in range(edits):
            kind, at = draw.integers(3), int(draw.integers(len(string)))
            word = int(draw.integers(1 << 41, 1 << 42))
            if kind == 0:
                string[at] = word
            elif kind == 1:
                string.insert(at, word)
            elif len(string) > 1:
                del string[at]
        string = (string + draw.integers(1 << 42, 1 << 43, n).tolist())[:n]
        b[k] = string
    missed, length = np.ones(TRIALS, bool), np.full(TRIALS, n)
    for lookup in range(MOST_REPEATS):
        if lookup % LOOKUPS_PER_WALK == 0:
            seed = lookup // LOOKUPS_PER_WALK
            wrote = walk(a, length, seed), walk(b, length, seed)
        own = [_lookup_keys(w, length, lookup) for w in wrote]
        missed &= own[0] != own[1]
        if missed.mean() <= 1 - recall:
            return lookup + 1
    return None


@dataclass
class _Items:
    """A block of items: codes of all their words, and items by length."""

    codes: dict[str, int]
    pairs: np.ndarray  # sorted, code of the first word times number of words plus the second
    in_length: dict[int, np.ndarray]  # which of these occur in items of a length
    ids: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # numbers of items, their words
    similarity: float
    repeats: dict[int, int]  # lookups by length; a longer item is searched exactly
    tables: list[tuple[np.ndarray, np.ndarray]]  # for each lookup: sorted keys, their items


def _prepare(rows: list[tuple[int, str]], similarity: float, recall: float) -> _Items:
    codes: dict[str, int] = {}
    groups: dict[int, list] = {}
    for k, (_, text) in enumerate(rows):
        words = [codes.setdefault(w, len(codes)) for w in words_of(text)]
        if words:
            groups.setdefault(len(words), []).append((k, words))
    by_length = {
        n: (np.array([k for k, _ in own]), np.array([w for _, w in own], np.int64))
        for n, own in sorted(groups.items())
    }
    own = {n: w[:, :-1].ravel() * len(codes) + w[:, 1:].ravel() for n, (_, w) in by_length.items()}
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *own.values()]))
    in_length = {n: np.isin(pairs, p) for n, p in own.items()}
    counts: dict[int, int] = {}
    for n in by_length:
        repeats = repeats_for(n, allowed_edits(n, similarity), recall)
        if repeats is None:
            break  # longer ones need still more
        counts[n] = repeats
    looked_up = [by_length[n] for n in counts]
    numbers = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in looked_up)])
    tables = []
    for own, keys in _lookups([w for _, w in looked_up], counts):
        order = np.argsort(keys, kind="stable")
        tables.append((keys[order], numbers[own][order]))
    ids = np.array([i for i, _ in rows], np.int64)
    return _Items(codes, pairs, in_length, ids, by_length, similarity, counts, tables)


def _lookups(groups: list[np.ndarray], repeats: dict[int, int]) -> Iterator[tuple]:
    """For each lookup the strings that take part, and their keys. A group has strings of one
    length; they are numbered through."""
    lengths = np.array([g.shape[1] for g in groups for _ in range(len(g))], np.int64)
    strings = np.full((len(lengths), int(lengths.max(initial=1))), -1, np.int64)
    at = 0
    for g in groups:
        strings[at : at + len(g), : g.shape[1]] = g
        at += len(g)
    own = np.array([repeats[n] for n in lengths.tolist()], np.int64)
    for lookup in range(int(own.max(initial=0))):
        rows = np.flatnonzero(own > lookup)
        if lookup % LOOKUPS_PER_WALK == 0:
            walked = rows
            wrote = walk(strings[rows], lengths[rows], lookup // LOOKUPS_PER_WALK)
        here = wrote if len(rows) == len(walked) else wrote[:, np.isin(walked, rows)]
        yield rows, _lookup_keys(here, lengths[rows], lookup)


def _found_by_lookups(groups: list[np.ndarray], items: _Items) -> tuple[np.ndarray, np.ndarray]:
    """Candidates: numbers of window and item, each pair once."""
    found, size = [np.zeros(0, np.int64)], len(items.ids)
    for (rows, own), (keys, number) in zip(_lookups(groups, items.repeats), items.tables, strict=False):
        low = np.searchsorted(keys, own, "left")
        count = np.searchsorted(keys, own, "right") - low
        hit = np.flatnonzero(count)
        n = count[hit]
        before = np.cumsum(n) - n
        at = np.repeat(low[hit] - before, n) + np.arange(int(n.sum()))
        found.append(np.repeat(rows[hit], n) * size + number[at])
    return np.divmod(np.unique(np.concatenate(found)), size)


def _dense_starts(pairs: np.ndarray, n: int, least: int) -> np.ndarray:
    """Starts of windows of ``n`` words that hold at least ``least`` of the pairs, given by the
    sorted places of their first words; ``least`` is above zero."""
    if len(pairs) < least:
        return np.zeros(0, np.int64)
    first, last = pairs[: len(pairs) - least + 1], pairs[least - 1 :]
    low, size = last - (n - 2), np.maximum(first - last + n - 1, 0)
    before = np.cumsum(size) - size
    return np.unique(np.repeat(low - before, size) + np.arange(int(size.sum())))


def _windows(codes: np.ndarray, ends: np.ndarray, items: _Items) -> Iterator[tuple[int, np.ndarray]]:
    """For each length of items the starts of the windows to look at. ``codes`` are those of all
    texts in a row, -1 for words that no item has; ``ends`` where each text ends."""
    both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    pair = codes[both] * len(items.codes) + codes[both + 1]
    number = np.searchsorted(items.pairs, pair)
    hit = number < len(items.pairs)
    hit[hit] = items.pairs[number[hit]] == pair[hit]
    both, number = both[hit], number[hit]
    for n in items.by_length:
        k = allowed_edits(n, items.similarity)
        least = n - 1 - 2 * k
        if n == 1:
            starts = np.flatnonzero(codes >= 0)
        elif least < 1:  # not with a similarity of 0.8
            starts = np.arange(len(codes))
        else:
            starts = _dense_starts(both[items.in_length[n][number]], n, least)
        starts = starts[(starts >= 0) & (starts < len(codes))]
        # A window may reach past the end of its text, but for the edits allowed.
        yield n, starts[ends[np.searchsorted(ends, starts, "right")] >= starts + n - k]


def _around(codes: np.ndarray, low: np.ndarray, size: int, begin: np.ndarray, end: np.ndarray,
            outside: int) -> np.ndarray:
    """Rows of ``size`` words from ``low`` on, as far as they are from ``begin`` to ``end``."""
    place = low[:, None] + np.arange(size)
    fine = (place >= begin[:, None]) & (place < end[:, None])
    return np.where(fine, codes[np.clip(place, 0, len(codes) - 1)], outside)


def _candidates(codes: np.ndarray, ends: np.ndarray, items: _Items) -> Iterator[tuple]:
    """``(n, starts, items)``: places of windows and the numbers of the items they may hold."""
    waiting: list[tuple] = []  # of one length each: windows, and the places that have them
    words, longest = 0, max(items.repeats, default=1)  # rows are padded to the longest
    for n, starts in _windows(codes, ends, items):
        numbers = items.by_length[n][0]
        at_once = max(1, WINDOW_WORDS // max(longest, len(numbers)))
        for a in range(0, len(starts), at_once):
            own = starts[a : a + at_once]
            if n not in items.repeats:
                yield n, np.repeat(own, len(numbers)), np.tile(numbers, len(own))
                continue
            windows = _around(codes, own, n, own, ends[np.searchsorted(ends, own, "right")], -1)
            # Equal windows are embedded once.
            rows = np.ascontiguousarray(windows).view(np.dtype((np.void, 8 * n))).ravel()
            _, first, of = np.unique(rows, return_index=True, return_inverse=True)
            waiting.append((windows[first], own, of))
            words += len(first) * longest
            if words >= WINDOW_WORDS:
                yield from _looked_up(waiting, items)
                waiting, words = [], 0
    yield from _looked_up(waiting, items)


def _looked_up(waiting: list[tuple], items: _Items) -> Iterator[tuple]:
    if not waiting:
        return
    window, item = _found_by_lookups([w for w, _, _ in waiting], items)
    before = 0
    for windows, places, of in waiting:
        here = (window >= before) & (window < before + len(windows))
        own, number = window[here] - before, item[here]
        before += len(windows)
        order, count = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(windows))
        start, each = np.cumsum(count) - count, count[own]
        at = np.repeat(start[own] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        starts, number, n = places[order[at]], np.repeat(number, each), windows.shape[1]
        fits = np.isin(number, items.by_length[n][0])  # keys hold the length, but are hashes
        yield n, starts[fits], number[fits]


def _verified(codes: np.ndarray, ends: np.ndarray, items: _Items) -> dict[tuple, tuple]:
    """By text and item: fewest edits, first word of the stretch."""
    begin = np.concatenate(([0], ends[:-1]))
    best: dict[tuple, tuple] = {}
    seen: dict[tuple, tuple] = {}  # equal surroundings are compared once
    for n, starts, numbers in _candidates(codes, ends, items):
        k = allowed_edits(n, items.similarity)
        text = np.searchsorted(ends, starts, "right")
        order = np.lexsort((starts, numbers, text))
        starts, numbers, text = starts[order], numbers[order], text[order]
        apart = (np.diff(text) != 0) | (np.diff(numbers) != 0) | (np.diff(starts) > n)
        first = np.concatenate(([0], np.flatnonzero(apart) + 1))[: len(starts)]
        last = np.concatenate((first[1:], [len(starts)]))[: len(first)] - 1
        text, number = text[first], numbers[first]
        low = np.maximum(starts[first] - k, begin[text])
        size = np.minimum(starts[last] + n + 2 * k, ends[text]) - low
        words = items.by_length[n][1][np.searchsorted(items.by_length[n][0], number)]
        jobs: dict[tuple, list] = {}
        for j in range(len(first)):
            key = (int(number[j]), codes[low[j] : low[j] + size[j]].tobytes())
            jobs.setdefault(key, []).append(j)
        todo = sorted((key for key in jobs if key not in seen), key=lambda key: len(key[1]))
        while todo:  # those of like sizes together
            width = len(todo[0][1]) // 8
            take = max(1, PAIR_CELLS // (2 * width))
            part, todo = todo[:take], todo[take:]
            here = [key for key in part if len(key[1]) <= 16 * width]
            todo = part[len(here) :] + todo
            own = np.array([jobs[key][0] for key in here])
            around = _around(codes, low[own], int(size[own].max()), low[own], (low + size)[own], -2)
            for key, edits, at in zip(here, *best_stretches(words[own], around), strict=True):
                seen[key] = (int(edits), int(at))
        for key, places in jobs.items():
            edits, at = seen[key]
            if edits > k:
                continue
            for j in places:
                value = (edits, int(low[j] - begin[text[j]]) + at)
                own_key = (int(text[j]), key[0])
                if value < best.get(own_key, (n + 1, 0)):
                    best[own_key] = value
    return best


#: Words of texts looked through at once; a longer text is looked through by itself.
WORDS_AT_ONCE = 500_000


def _contaminated(sent):
    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = sent.value
        get, unknown = items.codes.get, repeat(-1)
        ids, parts, n = [], [], 0

        def found() -> Iterator[pa.RecordBatch]:
            ends = np.cumsum([len(x) for x in parts])
            best = sorted(_verified(np.concatenate(parts), ends, items).items())
            if best:
                yield pa.record_batch(
                    [
                        pa.array([ids[text] for (text, _), _ in best], pa.int64()),
                        pa.array([int(items.ids[i]) for (_, i), _ in best], pa.int64()),
                        pa.array([edits for _, (edits, _) in best], pa.int32()),
                        pa.array([at for _, (_, at) in best], pa.int64()),
                    ],
                    ["doc_id", "item_id", "edits", "first_word"],
                )

        for batch in batches:
            for doc_id, data in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(data.as_py().decode("utf-8", "replace"))
                if not words:
                    continue
                parts.append(np.array(list(map(get, words, unknown)), np.int64))
                ids.append(doc_id.as_py())
                n += len(words)
                if n >= WORDS_AT_ONCE:
                    yield from found()
                    ids, parts, n = [], [], 0
        if parts:
            yield from found()

    return of_partition


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks that fit into a task; they come to the driver partition by partition."""
    block, n = [], 0
    for row in items.toLocalIterator():
        size = len(words_of(row[1]))
        if block and (len(block) >= BLOCK_ITEMS or n + size > BLOCK_WORDS):
            yield block
            block, n = [], 0
        block.append((row[0], row[1]))
        n += size
    if block:
        yield block


def contaminated(
    docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY,
    recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, edits, first_word)``: each text and item found in it, with the fewest
    edits and the number of the word where that stretch starts (the first of equal ones).

    Items without words or without an id are never found; equal items are each found. Missing,
    empty and much shorter texts hold no stretch. Repeated rows give repeated results, a row without
    an id gives results without one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    named = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_id).cast("long"), F.col(item_text)
    )
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col))
    schema = "doc_id long, item_id long, edits int, first_word long"
    found = None
    for block in _blocks(named):
        sent = spark.sparkContext.broadcast(_prepare(block, similarity, recall))
        own = picked.mapInArrow(_contaminated(sent), schema)
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], schema) if found is None else found


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                        **options) -> DataFrame:
    """The rows in which no item is found, with all their columns. Rows without an id stay."""
    found = stored(contaminated(docs, items, id_col=id_col, **options), "contaminated")
    bad = found.where("doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
