import random

import numpy as np
import pytest
from conftest import SF_DIR

from almanac.llm import decontaminate as d
from almanac.llm.queries import queries


def plain_distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        before, row = row, [i]
        for j, e in enumerate(y, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != e)))
    return row[-1]


def best_stretch(words, own):
    """Fewest edits of any stretch, and the first place where one with so few starts."""
    row = [(0, j) for j in range(len(words) + 1)]
    for i, c in enumerate(own, 1):
        before, row = row, [(i, 0)]
        for j, e in enumerate(words, 1):
            row.append(min((before[j][0] + 1, before[j][1]), (row[-1][0] + 1, row[-1][1]),
                           (before[j - 1][0] + (c != e), before[j - 1][1])))
    return min(row)


def brute_force(docs, items, similarity=0.8):
    """All items against all texts, stretches of any length."""
    out = set()
    for doc_id, text in docs:
        words = d.words_of(text or "")
        for item_id, item in items:
            own = d.words_of(item or "")
            if item_id is None or not own or not words:
                continue
            edits, at = best_stretch(words, own)
            if edits <= d.allowed_edits(len(own), similarity):
                out.add((doc_id, item_id, edits, at))
    return out


def found_in(docs_df, items_df, **options):
    return {tuple(r) for r in d.contaminated(docs_df, items_df, **options).collect()}


def test_best_stretches():
    """In one pass, with what is outside a text left out; brute force tries all stretches."""
    draw = np.random.default_rng(0)
    a, b = draw.integers(0, 4, (200, 7)), draw.integers(0, 4, (200, 13))
    cut = [(draw.integers(0, 4), draw.integers(9, 14)) for _ in b]
    for row, (low, high) in zip(b, cut, strict=True):
        row[:low] = row[high:] = -2
    edits, at = d.best_stretches(a, b)
    for k, (low, high) in enumerate(cut):
        x, y = a[k].tolist(), b[k].tolist()
        every = [(plain_distance(x, y[i:j]), i) for i in range(low, high + 1) for j in range(i, high + 1)]
        assert (edits[k], at[k]) == min(every)
        assert best_stretch(y[low:high], x) == (edits[k], at[k] - low)


def test_windows_lose_nothing():
    """The window where a stretch within the threshold starts passes the pair filter."""
    draw = random.Random(2)
    for _ in range(300):
        n = draw.randint(1, 14)
        item = [draw.choice("abcdefgh") for _ in range(n)]
        own = list(item)
        for _ in range(d.allowed_edits(n, 0.8)):
            k = draw.randrange(len(own))
            draw.choice((lambda: own.__setitem__(k, "x"), lambda: own.insert(k, "y"),
                         lambda: own.pop(k) if len(own) > 1 else None))()
        text = [draw.choice("abz") for _ in range(5)] + own + ["z"] * 6
        items = d._prepare([(1, " ".join(item))], 0.8, 0.9)
        codes = np.array([items.codes.get(w, -1) for w in text])
        ((_, starts),) = d._windows(codes, np.array([len(text)]), items)
        k = d.allowed_edits(n, 0.8)
        for at in range(len(text) - n + 1):
            if any(plain_distance(text[at : at + m], item) <= k for m in range(n - k, n + k + 1)):
                assert at in starts


def edited(words, edits, draw, word):
    own = list(words)
    for _ in range(edits):
        k = draw.randrange(len(own))
        draw.choice((lambda: own.__setitem__(k, word()), lambda: own.insert(k, word()), lambda: own.pop(k)))()
    return own


@pytest.mark.parametrize("n,count", [(12, 60), (60, 40), (400, 12), (1000, 6)])
def test_recall_at_the_threshold(spark, n, count):
    """Planted passages with as many edits as allowed are nearly all found, whatever their length."""
    draw = random.Random(n)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i in range(count)]
    docs = []
    for i, text in items:
        own = edited(text.split(), d.allowed_edits(n, 0.8), draw, word)
        docs.append((i, " ".join([word() for _ in range(30)] + own + [word() for _ in range(30)])))
    docs += [(count + i, " ".join(word() for _ in range(200))) for i in range(30)]
    found = found_in(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string"))
    expected = brute_force([(i, t) for i, t in docs if n < 100 or i < count],
                           items) if n < 100 else {r for i in range(count) for r in brute_force(docs[i : i + 1], items[i : i + 1])}
    assert {(i, i) for i in range(count)} <= {r[:2] for r in expected}
    assert found <= expected and len(found) >= 0.95 * len(expected)
    if d.repeats_for(n, d.allowed_edits(n, 0.8), d.TARGET_RECALL) is None:
        assert found == expected  # the exact way
    else:
        assert n < 200


ITEM = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, ITEM), (2, ITEM), (3, None), (4, "  !! "), (None, ITEM), (5, "alpha"), (6, "beta gamma delta epsilon zeta")]
DOCS = [
    (1, f"Here: {ITEM.upper()}!!! the end"), (2, None), (3, ""), (4, "one two three"),
    (5, "word " * 20_000 + ITEM.replace("five", "5") + " word" * 20_000),
    (None, f"x {ITEM}"), (1, f"Here: {ITEM.upper()}!!! the end"), (6, "plain text about nothing"),
    (7, "ALPHA"), (8, "beta, gamma... delta? zeta"), (9, "beta gamma delta epsilon eta zeta eta"),
]


def test_edge_cases(spark, texts):
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    rows = d.contaminated(texts(DOCS), items).collect()
    assert {tuple(r) for r in rows} == brute_force(DOCS, ITEMS)
    assert len([r for r in rows if r["doc_id"] == 1]) == 4  # two items, the row twice
    assert d.contaminated(texts([]), items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(texts(DOCS), none).count() == 0


def test_items_in_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found_in(texts(DOCS), items) == brute_force(DOCS, ITEMS)


def test_remove(spark, texts):
    docs = texts(DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = d.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = {i for i, *_ in brute_force(DOCS, ITEMS)} - {None}
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(
        str(i) for i, _ in DOCS if i not in bad
    )


@pytest.mark.parametrize("n,edits", [(12, 2), (30, 6), (55, 11)])
def test_repeats_reach_the_target(n, edits):
    low, high = d.repeats_for(n, edits, 0.9), d.repeats_for(n, edits, 0.99)
    assert 1 <= low <= high <= d.MOST_REPEATS


def test_exact_way_equals_brute_force(spark, monkeypatch):
    """As if no number of lookups were enough, in small pieces, with repeated words."""
    monkeypatch.setattr(d, "repeats_for", lambda *_: None)
    for name in ("WINDOW_WORDS", "PAIR_CELLS", "WORDS_AT_ONCE"):
        monkeypatch.setattr(d, name, 50)
    draw = random.Random(5)
    items = [(i, " ".join(draw.choice("abcdef") for _ in range(draw.randint(1, 12)))) for i in range(12)]
    docs = [(i, " ".join(draw.choice("abcdefxyz") for _ in range(draw.randint(0, 60)))) for i in range(30)]
    frames = (spark.createDataFrame(docs, "doc_id long, text string").coalesce(2),
              spark.createDataFrame(items, "item_id long, text string"))
    assert found_in(*frames) == brute_force(docs, items)
    assert found_in(*frames, similarity=0.5) == brute_force(docs, items, 0.5)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    found = {tuple(r) for r in queries()["op4_decontamination"](spark, SF_DIR).collect()}
    # Plain distances only where texts share a pair of words, else no window can be close.
    pairs = {i: set(zip(w := d.words_of(t), w[1:], strict=False)) for i, t in items}
    expected = set()
    for doc_id, text in docs:
        w = d.words_of(text)
        own = set(zip(w, w[1:], strict=False))
        near = [(i, t) for i, t in items if len(own & pairs[i]) >= 0.5 * len(pairs[i])]
        expected |= brute_force([(doc_id, text)], near) if near else set()
    assert found == expected and found


def test_insertions_and_deletions(spark):
    """Copies with words put in or left out are found, also where the text ends with them."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    items, docs = [], []
    for i in range(24):
        own = [word() for _ in range(20)]
        items.append((i, " ".join(own)))
        for _ in range(3):
            k = draw.randrange(len(own) // 2)
            own.insert(k, word()) if i % 2 else own.pop(k)
        around = [word() for _ in range(6)] if i % 3 else []
        docs.append((i, " ".join(around + own + around)))
    found = found_in(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string"))
    expected = brute_force(docs, items)
    assert len(expected) == len(items) and {r[2] for r in expected} <= {1, 2, 3}
    assert found <= expected and len(found) >= 0.95 * len(items)
