import hashlib
import inspect
import random
import re

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from almanac.llm import pii
from almanac.llm.queries import queries

# The patterns as they are stated.
STATED = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_force(text):
    out = []
    for kind, pattern in enumerate(STATED):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                0: lambda m=m: True,
                1: lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                2: lambda m=m, x=digits: 16 <= len(x) <= 19 and sum(
                    sum(divmod(2 * int(c), 10)) if k % 2 else int(c)
                    for k, c in enumerate(reversed(x))
                ) % 10 == 0,
                3: lambda m=m, x=digits: 8 <= len(x) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


def test_patterns_equal_the_stated_ones():
    draw = random.Random(1)
    for _ in range(20_000):
        text = "".join(draw.choice("1234567890..@@+- ()ab%é") for _ in range(draw.randint(0, 60)))
        assert pii.base_spans(text) == brute_force(text)


@pytest.mark.parametrize("text", ["1" * 50_000, "a" * 50_000 + "@", "@" * 20_000, "1." * 20_000, "+1" + "(" * 20_000])
def test_long_junk_is_no_trouble(text):
    pii.base_spans(text)
    pii._graph([text], [[]])


def test_messages_are_exact_on_a_chain():
    draw = np.random.default_rng(0)
    node, tables = draw.normal(size=(4, 3)), draw.normal(size=(3, 3, 3))
    edges = np.array([[0, 1], [1, 2], [2, 3]])
    joint = np.zeros((3,) * 4)
    for x in np.ndindex(*joint.shape):
        joint[x] = sum(node[i, x[i]] for i in range(4)) + sum(
            tables[k][x[a], x[b]] for k, (a, b) in enumerate(edges)
        )
    p = np.exp(joint) / np.exp(joint).sum()
    for i in range(4):
        one = p.sum(axis=tuple(j for j in range(4) if j != i))
        assert np.allclose(pii.marginals(node, edges, tables)[i], one, atol=1e-3)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def spans_of(text, model):
    return [(pii.KINDS[k], text[a:b], base) for k, a, b, base in pii.all_spans([text], model)[0]]


def test_field_adds_and_keeps(model):
    both = "call +1 (988) 555-2485 or write to ab.c@mail.example.org from 10.1.2.3 please"
    assert spans_of(both, model) == [
        ("email", "ab.c@mail.example.org", True), ("ip", "10.1.2.3", True),
        ("phone", "+1 (988) 555-2485", True),
    ]
    # The pattern takes the address' first digits for the number's and gives it up.
    swallowed = "now +1 (826) 555-4081 190.137.223.204 then"
    added = [(kind, text) for kind, text, base in spans_of(swallowed, model) if not base]
    assert added and all(kind == "phone" and text in swallowed and "555-4081" in text for kind, text in added)
    assert spans_of("version 3.14 of 2024, chapter 7, 24be64439e3c", model) == []


def test_repeats_speak_for_each_other():
    """What is unclear alone follows a distant token that repeats it."""
    width = pii.LABELS
    node = np.zeros((int(pii._OFFSETS[-1]), width))
    skip = np.full((width, width), -1.0)
    np.fill_diagonal(skip, 4.0)
    model = pii.Model(node, np.zeros((width, width)), skip)
    text = "x 4785380592391139 far from here x(4785380592391139)x"
    assert [s[:3] for s in pii.all_spans([text], model)[0] if s[3]] == [(2, 2, 18), (2, 35, 51)]
    far = "mail a.b@example.com words in between A.B@EXAMPLE.COM"
    assert len(pii.all_spans([far], model)[0]) == 2
    held = "id 4785380592391139 and again 4785-3805 9239x1139 4785380592391139."
    assert all(s[0] == 2 for s in pii.all_spans([held], model)[0])


def test_any_repeat_reaches_all_others():
    """However many there are, and whichever of them is recognised."""
    width = pii.LABELS
    skip = np.full((width, width), -1.0)
    np.fill_diagonal(skip, 4.0)
    model = pii.Model(np.zeros((int(pii._OFFSETS[-1]), width)), np.zeros((width, width)), skip)
    unclear, clear = "4785x3805x9239x1139", "4785380592391139"
    for at in (0, 40, 199):
        words = [f"{unclear} then"] * 200
        words[at] = f"{clear} then"
        added = [s for s in pii.all_spans([" ".join(words)], model)[0] if not s[3]]
        assert len(added) == 199 and {s[0] for s in added} == {2}


def test_documents_settle_by_themselves(model):
    """A text has the same spans whatever texts are looked at with it."""
    draw = random.Random(2)
    piece = lambda: draw.choice(["+1 (826) 555-4081", "190.137.223.204", "a.b@c.de", "4785 3805 9239 1139", "12", "x9", "call", "555-4081"])
    docs = [" ".join(piece() for _ in range(draw.randint(1, 60))) for _ in range(40)]
    assert pii.all_spans(docs, model) == [pii.all_spans([d], model)[0] for d in docs]


def test_messages_that_swing_come_to_rest():
    """Strong potentials around loops that want neighbours to differ."""
    draw = np.random.default_rng(3)
    edges = np.array([(a, b) for a in range(9) for b in range(a + 1, 9)])
    tables = np.tile(np.where(np.eye(5), -9.0, 9.0), (len(edges), 1, 1))
    p = pii.marginals(draw.normal(size=(9, 5)), edges, tables)
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1)


def test_the_sample_needs_no_sort_and_is_bounded(spark, texts, monkeypatch):
    rows = [(i, f"mail a{i}@b.cd or +1 (826) 555-4{i:03d} now 12 34") for i in range(200)]
    monkeypatch.setattr(pii, "SAMPLE_TOKENS", 40)
    sizes = []
    real = pii._learn
    monkeypatch.setattr(pii, "_learn", lambda g: sizes.append(len(g.label)) or real(g, steps=3))
    pii.fit(texts(rows))
    assert 0 < sizes[0] <= 40
    monkeypatch.setattr(pii, "SAMPLE_TOKENS", 10**6)
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 20)
    pii.fit(texts(rows))
    assert 40 < sizes[1] < 2000
    assert not re.search(r"orderBy|sortWithin|limit", inspect.getsource(pii.fit).split('"""')[2])


def test_edge_cases(texts, model):
    rows = [(1, None), (2, ""), (3, "a@b.cd " * 3000), (3, "a@b.cd " * 3000), (None, "+49 30 1234567"), (4, "é@ß 🙂 a@b.cd")]
    out = texts(rows).select("doc_id", pii.spans(F.col("text"), model).alias("s"), pii.redact(F.col("text"), model).alias("t")).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and by[1]["s"] == [] and by[1]["t"] == "" and by[2]["s"] == []
    assert len(by[3]["s"]) == 3000 and by[3]["t"] == "<email> " * 3000
    assert by[None]["t"] == "<phone>"
    assert [(s["start"], s["end"]) for s in by[4]["s"]] == [(6, 12)]
    assert texts([]).select(pii.spans(F.col("text"), model)).count() == 0


def test_nothing_to_learn_from(texts):
    model = pii.fit(texts([(1, "no digits here")]))
    assert [s[3] for s in pii.all_spans(["a@b.cd 12"], model)[0]] == [True]


def test_overlapping_spans_are_replaced_once():
    found = [(0, 0, 5, True), (2, 3, 9, True), (1, 20, 22, False)]
    assert pii._replaced("abcdefghijklmnopqrstuvwxyz", found) == "<email>jklmnopqrst<ip>wxyz"


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries()["op5_pii"](spark, SF_DIR).collect():
        base = brute_force(docs[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))
