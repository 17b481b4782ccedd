import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF_DIR
from pyspark.sql import functions as F

from almanac.llm import bpe
from almanac.llm.common import forget_tables, stored_by
from almanac.llm.queries import queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
HARD = [
    (1, "hello  world\n\n x"), (2, None), (3, ""), (4, "a" * 5000 + " " * 3000 + "éé\x85 　x"),
    (4, "it's we'll 'S ''s 12³ \x1c\x1f  \t"), (None, "x y​z \U0001f600\U0001f600 é"),
    (5, "a" * 5000 + " " * 3000 + "éé\x85 　x"), (5, "don't\r\n\r\nstop \n"), (6, "der die das " * 3000),
]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_ids_equal_the_library(texts, reference, monkeypatch):
    encoded = bpe.encode(texts(HARD), RANKS, public_tokenizers.PATTERN)
    found = Counter(
        (r[0], bytes(r[1]), bytes(r[2]))
        for r in encoded.select("doc_id", "ids", bpe.decode(F.col("ids"), RANKS)).collect()
    )
    assert found == Counter(
        (i, np.array(reference.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode())
        for i, t in HARD
    )


def test_blocks_of_any_size_give_the_same(texts, reference, monkeypatch):
    pack = bpe._pack(3, public_tokenizers.PATTERN)
    import pyarrow as pa

    batch = pa.record_batch([
        pa.array([i for i, _ in HARD], pa.int64()),
        pa.array([(t or "").encode() for _, t in HARD], pa.binary()),
    ], ["doc_id", "text"])
    for size in (1, 50, 10**9):
        monkeypatch.setattr(bpe, "BLOCK_WORDS", size)
        rows = pa.Table.from_batches(list(pack(iter([batch]))))
        out = []
        for block in rows.column("block").unique().to_pylist():
            of_block = rows.filter(pa.compute.equal(rows.column("block"), pa.scalar(block)))
            part = of_block.column("share").to_numpy()
            words = of_block.filter(pa.array(part >= 0))
            ids = pa.Table.from_batches(
                list(bpe._encode_share(RANKS)((), words.to_batches())),
                schema=words.schema,
            )
            out += bpe._reassemble(of_block.filter(pa.array(part < 0)), ids).to_pylist()
        assert [(r["doc_id"], r["ids"]) for r in out] == [
            (i, np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in HARD
        ]


def test_long_words_merge_as_short_ones_do(reference):
    for word in (b"ab" * 300, b"hello world" * 60, b"aaaa" * 999, "éß".encode() * 400):
        ranks = bpe._ranks(RANKS)
        assert bpe.merge_long(word, ranks) == bpe._encoding(RANKS).encode_ordinary(word.decode())


def test_digests_and_arrays(spark, texts, reference):
    sent = spark.sparkContext.broadcast(RANKS)
    out = bpe.encode(
        texts(HARD), RANKS, public_tokenizers.PATTERN, then=bpe.digests(sent), schema=bpe.DIGESTS
    ).where("doc_id = 1").first()
    ids = reference.encode_ordinary(HARD[0][1])
    assert out["n_tokens"] == len(ids)
    assert out["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert out["decoded_sha256"] == hashlib.sha256(HARD[0][1].encode()).hexdigest()
    packed = spark.createDataFrame([(np.array(ids, "<u4").tobytes(),), (None,)], "ids binary")
    arrays = [r[0] for r in packed.select(bpe.id_array(F.col("ids"))).collect()]
    assert arrays == [ids, None]


def test_empty_table_and_unknown_id(spark, texts):
    assert bpe.encode(texts([]), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="no token"):
        list(bpe.decoded([np.array([60_000], "<u4").tobytes()], RANKS))
    assert list(bpe.decoded([None, b""], RANKS)) == [None, b""]


def test_registered(spark):
    out = queries()["op1_bpe"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = out.join(docs, "doc_id").where(F.sha2("text", 256) != F.col("decoded_sha256"))
    assert (out.count(), wrong.count()) == (docs.count(), 0)


def test_tables_are_forgotten_but_not_their_files(spark):
    kept = stored_by(spark.range(10), "some", "id", 2)
    files = kept.inputFiles()
    assert forget_tables(spark) >= 1 and forget_tables(spark) == 0
    assert spark.read.parquet(*files).count() == 10


def test_query_equals_the_library(spark, reference):
    """The ids of every document, and what they decode to."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries()["op1_bpe"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        packed = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
