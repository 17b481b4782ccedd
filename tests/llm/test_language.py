import random
import zlib

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from almanac.llm import language as lang
from almanac.llm.queries import queries

ENGLISH = "the quick brown fox jumps over the lazy dog and then walks back home with its friends".split()
GERMAN = "der schnelle braune fuchs springt über den faulen hund und geht dann wieder nach hause".split()
GREEK = "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και μετά γυρίζει σπίτι".split()


def training(n=60, seed=1):
    draw = random.Random(seed)
    kinds = {"en": ENGLISH, "de": GERMAN, "el": GREEK}
    return [
        (i, " ".join(draw.choice(words) for _ in range(30)), name)
        for i, (name, words) in enumerate([*kinds.items()] * n)
    ]


def documents(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "x", "x") for r in rows],
        "doc_id long, text string, lang string, score string, p string, place string",
    )


def plain_subwords(text):
    """Subwords as they are meant, one by one."""
    lower = lambda c: c.lower() if len(c.lower()) == 1 else c
    marked = "\0" + "".join(lower(c) if c.isalpha() else "\0" for c in text) + "\0"
    return [
        marked[i : i + n]
        for n in lang.ORDERS for i in range(len(marked) - n + 1)
        if "\0" not in marked[i + 1 : i + n - 1] and marked[i : i + n].strip("\0")
    ]


@pytest.mark.parametrize("piece", [7, 50, 400_000])
def test_subwords(piece, monkeypatch):
    """Pieces of any size give the subwords of the whole text, each as often as it occurs."""
    monkeypatch.setattr(lang, "_PIECE", piece)
    known = {}
    texts = ["", "a", "ab", "Ab  cd, Éfg! x1y", "der Straße ŒUVRE İstanbul " * 3, "漢字かな ab"]
    for text in texts:
        for sub in plain_subwords(text):
            key = np.array([ord(c) for c in sub], np.uint64)
            known[sub] = int(lang._slots(key)[lang.ORDERS.index(len(sub))][0])
    for text in texts:
        expected = np.zeros(lang.SLOTS)
        for sub in plain_subwords(text):
            expected[known[sub]] += 1
        used, share = lang._counts(text.encode())
        assert np.array_equal(used, np.flatnonzero(expected))
        assert np.allclose(share, expected[used] / max(1, expected.sum()))
    draw = np.random.default_rng(0)
    table = np.vstack([draw.normal(size=(lang.SLOTS, 3)), np.zeros((1, 3))])
    got = lang._averages([t.encode() for t in texts], table)
    for text, row in zip(texts, got, strict=True):
        used, share = lang._counts(text.encode())
        assert np.allclose(row, share @ table[used])


def test_learns_and_rejects(spark):
    model = lang.fit(documents(spark, training()))
    assert model.languages == ["de", "el", "en"] and 0 < model.accept_from <= 1
    rows = training(seed=9) + [(900, "qqq zzz xxx 111 www", None), (901, None, "en"), (902, " 12 ½ Ⅷ ² !", "en"),
                               (903, "", None), (904, "the dog " * 100_000, None), (0, "the lazy dog", "en")]
    out = documents(spark, rows).select("doc_id", "lang", "text", lang.predict(F.col("text"), model).alias("r")).collect()
    assert all(r["r"]["lang"] == r["lang"] for r in out if r["lang"] and r["doc_id"] < 900)
    assert all(0 <= r["r"]["score"] <= 1 for r in out)
    assert [tuple(r["r"]) for r in out if r["doc_id"] in (901, 902, 903)] == [("und", 0.0, False)] * 3
    assert [r["r"]["lang"] for r in out if r["doc_id"] == 904] == ["en"]
    for r in out:
        assert r["r"]["accepted"] == (r["r"]["lang"] != "und" and r["r"]["score"] >= model.accept_from)


def test_nothing_to_learn(spark):
    rows = [(1, None, "en"), (2, "12 34", "en"), (3, "some words", None), (None, "", "de")]
    for own in (rows, []):
        df = documents(spark, own)
        assert lang.fit(df) is None
        assert df.select(lang.predict(F.col("text"), None).alias("r")).where("r.lang <> 'und'").count() == 0
    only = lang.fit(documents(spark, [(1, "eins zwei", "de"), (None, "drei", "de")]))
    assert only.languages == ["de"] and only.temperature == 1.0


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(lang, "SAMPLE_ROWS", 60)
    docs = documents(spark, training(400))
    rows = lang._sample(docs, "doc_id").groupBy("lang").count().collect()
    assert all(8 <= r["count"] <= 40 for r in rows) and len(rows) == 3
    monkeypatch.setattr(lang, "SAMPLE_SLOTS", 500)
    assert lang.fit(docs) is not None


def test_calibration():
    """Margins ten times too large are brought back, and enough of the accepted are right."""
    draw = np.random.default_rng(6)
    margins = draw.normal(size=(4000, 3)) * 2
    y = np.array([draw.choice(3, p=p) for p in lang._softmax(margins)])
    m = lang.Model(["a", "b", "c"], np.zeros((1, 1)), np.zeros((1, 3)), np.zeros(3))
    lang.calibrate(m, margins * 10, y, right=0.95)
    assert 8 <= m.temperature <= 13
    p = lang._softmax(margins * 10 / m.temperature)
    kept = p.max(axis=1) >= m.accept_from
    assert 0.2 < kept.mean() < 1 and (p.argmax(axis=1) == y)[kept].mean() >= 0.95


def test_query_on_held_out_rows(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").collect()}
    rows = queries()["op11_language"](spark, SF_DIR.replace("0.001", "0.01")).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]
    accepted = [ok for ok, r in zip(right, held, strict=True) if r["accepted"]]
    assert np.mean(right) > 0.97 and np.mean(accepted) > 0.97 and len(accepted) > 0.8 * len(right)
