import base64
import gzip
import hashlib
import io
import json
import zlib

import pytest
from conftest import SF_DIR, plan_of
from pyspark.sql import functions as F

from almanac.llm import warc
from almanac.llm.common import shared_path
from almanac.llm.queries import queries


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(spark, rows):
    return spark.createDataFrame(
        rows, "record_id string, warc_type string, target_uri string, warc_date string, "
        "refers_to string, payload_digest string, payload binary, doc_id string",
    )


ROWS = [
    ("urn:a", "response", "http://a/", "2024-01-01T00:00:00Z", None, "AA", b"<p>hello\r\n\r\nthere</p>", "x"),
    ("urn:b", "revisit", "http://b/\r\nX: y", "2024-01-01T00:00:00Z", "urn:a", "AA", None, "x"),
    ("urn:c", None, None, None, None, None, None, "x"),
    ("urn:c", "response", "http://ä/ß", "2024", None, "CC", "ü".encode() * 3_000_000, "x"),
    (None, "response", "u" * 9000, "2024", None, "DD", b"", "x"),
]


def test_round_trip(spark):
    path = shared_path(spark, "t")
    warc.write_warc(record(spark, ROWS).repartition(3), path)
    found = {(r["record_id"], r["payload_digest"]): r for r in warc.read_warc(spark, path).collect()}
    assert len(found) == 5
    assert bytes(found["urn:a", "AA"]["payload"]) == ROWS[0][6]
    b = found["urn:b", "AA"]
    assert (b["warc_type"], b["refers_to"], bytes(b["payload"])) == ("revisit", "urn:a", b"")
    assert b["target_uri"] == "http://b/%0D%0AX: y"
    assert found["urn:c", None]["warc_type"] == "response"
    assert bytes(found["urn:c", "CC"]["payload"]) == ROWS[3][6]
    assert found[None, "DD"]["target_uri"] == "u" * 9000


def test_conditions_reach_the_source(spark):
    path = shared_path(spark, "t")
    warc.write_warc(record(spark, ROWS), path)
    some = warc.read_warc(spark, path, payload=False, once=True).where("warc_type = 'revisit' and record_id in ('urn:b', 'q')")
    assert [r["record_id"] for r in some.collect()] == ["urn:b"]
    assert "= revisit" not in plan_of(some)
    rest = warc.read_warc(spark, path, once=True).where("length(target_uri) > 5000 and warc_type = 'response'")
    assert rest.count() == 1
    named = warc.read_warc(spark, path, wanted={"warc_type": ["revisit"], "record_id": ["urn:b", "q"]})
    assert [r["record_id"] for r in named.collect()] == ["urn:b"]
    with pytest.raises(ValueError):
        warc.read_warc(spark, path, wanted={"payload": ["x"]})


def test_one_frame_in_several_places(spark):
    """Conditions of one use do not reach another."""
    path = shared_path(spark, "t")
    warc.write_warc(record(spark, ROWS), path)
    every = warc.read_warc(spark, path)
    revisits = every.where("warc_type = 'revisit'").select("record_id")
    assert (every.count(), revisits.count(), every.count()) == (5, 1, 5)
    others = every.where("warc_type = 'response'").select("record_id")
    assert revisits.union(others).count() == 5 and others.union(every.select("record_id")).count() == 9
    named = warc.read_warc(spark, path, wanted={"warc_type": ["response"]})
    assert named.where("record_id = 'urn:a'").count() == 1 and named.count() == 4


def test_unwanted_payloads_are_not_decompressed(monkeypatch):
    rows = [dict(zip(("record_id", "warc_type", "target_uri", "warc_date", "refers_to", "payload_digest", "payload"), r, strict=False)) for r in ROWS]
    data = b"".join(warc._record({**r, "warc_type": r["warc_type"] or "response"}) for r in rows)
    unpacked = []
    real = zlib.decompress
    monkeypatch.setattr(warc.zlib, "decompress", lambda x, w: unpacked.append(len(x)) or real(x, w))
    heads = [head for head, _ in warc._records(io.BytesIO(data))]
    assert len(heads) == 5 and not unpacked
    assert [len(whole()) > 0 for _, whole in warc._records(io.BytesIO(data))] == [True] * 5


def test_other_gzip_members_can_be_read():
    """Archives of other writers have no sizes in their members."""
    texts = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" + bytes([k]) * 5 + b"\r\n\r\n" for k in range(65, 70)]
    texts.append(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3000000\r\n\r\n" + bytes(range(250)) * 12_000)
    data = b"".join(gzip.compress(t) for t in texts)
    cut = [t.rstrip(b"\r\n") if k < 5 else t for k, t in enumerate(texts)]
    packed = (data, gzip.compress(b"".join(texts)), gzip.compress(b"".join(texts[:2])) + gzip.compress(b"".join(texts[2:])), b"".join(texts))
    for file in packed:  # a member for each record, one for all, two, none
        assert [whole()[: len(c)] for (_, whole), c in zip(warc._records(io.BytesIO(file)), cut, strict=True)] == cut
        assert [head[:15] for head, _ in warc._records(io.BytesIO(file))] == [b"WARC/1.1\r\nWARC-"] * 6
    # The format's own readers take our members.
    ours = warc._record(dict.fromkeys(warc.HEADERS) | {"warc_type": "response", "payload": b"x"})
    assert gzip.decompress(ours).startswith(b"WARC/1.1\r\nWARC-Type: response")
    with pytest.raises(ValueError, match="ends within"):
        [whole() for _, whole in warc._records(io.BytesIO(data[:-500]))]


def test_only_committed_archives_are_read(spark, tmp_path):
    warc.write_warc(record(spark, ROWS[:1]), str(tmp_path))
    (manifest,) = tmp_path.glob(warc.MANIFEST.format("*"))
    names = json.loads(manifest.read_text())
    (tmp_path / "left-behind.warc.gz").write_bytes((tmp_path / names[0][0]).read_bytes())
    assert warc.read_warc(spark, str(tmp_path)).count() == 1


def test_archives_roll(spark, tmp_path):
    many = spark.range(300).select(
        F.concat(F.lit("urn:"), "id").alias("record_id"), F.lit("response").alias("warc_type"),
        *(F.lit(None).cast("string").alias(c) for c in ("target_uri", "warc_date", "refers_to", "payload_digest")),
        F.rpad(F.lit("x"), 500, "y").cast("binary").alias("payload"),
    )
    spark.dataSource.register(warc.WarcDataSource)
    many.coalesce(1).write.format("warc").mode("append").option("path", f"file://{tmp_path}").option("roll_bytes", 5000).save()
    (manifest,) = tmp_path.glob(warc.MANIFEST.format("*"))
    assert len(json.loads(manifest.read_text())) > 3
    assert warc.read_warc(spark, str(tmp_path)).distinct().count() == 300


def test_appending_keeps_and_overwriting_replaces(spark, tmp_path):
    path = str(tmp_path)
    ids = lambda: sorted(r["record_id"] for r in warc.read_warc(spark, path).collect())
    warc.write_warc(record(spark, ROWS[:1]), path)
    warc.write_warc(record(spark, ROWS[1:2]), path)
    assert ids() == ["urn:a", "urn:b"]
    warc.write_warc(record(spark, ROWS[2:3]), path, mode="overwrite")
    assert ids() == ["urn:c"] and len(list(tmp_path.glob("*.warc.gz"))) == 1
    warc.write_warc(record(spark, []), path)
    assert ids() == ["urn:c"]


def test_archives_of_other_writers(spark, tmp_path):
    """A folder without manifests: plain and compressed files, also below; all record types keep
    their payload."""

    def other(kind, name, content_type, block):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{name}>\r\nContent-Type: {content_type}\r\n"
                f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    info = other("warcinfo", "i", "application/warc-fields", b"software: x\r\n\r\nformat: y")
    page = other("response", "r", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore")
    asked = other("request", "q", "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n")
    plain = other("resource", "s", "text/plain", b"hello")
    (tmp_path / "below").mkdir()
    (tmp_path / "a.warc").write_bytes(info + page)
    (tmp_path / "below" / "b.warc.gz").write_bytes(gzip.compress(plain) + gzip.compress(asked))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(other("metadata", "m", "text/x", b"") + plain))
    (tmp_path / "notes.txt").write_text("no archive")
    found = sorted((r["record_id"], r["warc_type"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert found == [
        ("urn:i", "warcinfo", b"software: x\r\n\r\nformat: y"), ("urn:m", "metadata", b""), ("urn:q", "request", b""),
        ("urn:r", "response", b"body\r\n\r\nmore"), ("urn:s", "resource", b"hello"), ("urn:s", "resource", b"hello"),
    ]
    some = warc.read_warc(spark, str(tmp_path), payload=False).where("warc_type = 'resource'")
    assert some.count() == 2
    assert warc.read_warc(spark, str(tmp_path / "a.warc")).count() == 2


def test_digest_is_native(spark):
    data = [b"", b"a", b"\x00" * 20, "ü".encode() * 999, None]
    df = spark.createDataFrame([(d,) for d in data], "d binary")
    got = df.select("d", warc.base32_sha1(F.col("d")).alias("x"))
    assert {r["x"] for r in got.collect()} == {digest(d or b"") for d in data}
    assert "EvalPython" not in plan_of(got)


def plain_pages(rows, least=0):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        own = i is not None and len(data) >= least and first[data] != i
        out.append((i, len(data), digest(data), "revisit" if own else "response", first[data] if own else None))
    return sorted(out, key=str)


PAGES = [
    (4, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (9, None, "<p>same</p>"),
    (5, "x", None), (6, "x", ""), (None, "x", "<p>same</p>"), (None, "x", "<p>lone</p>"), (7, "x", "é" * 200_000), (2, "x", "other"),
]


def test_pages_and_edge_cases(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x", "x") for p in PAGES], "page_id long, url string, html string, id string, payload string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    out = queries()["op8_warc"](spark, str(tmp_path))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in out.select(*columns).collect()), key=str) == plain_pages(PAGES)
    pages.limit(0).write.parquet(str(tmp_path / "none/pages.parquet"))
    assert queries()["op8_warc"](spark, str(tmp_path / "none")).count() == 0
    large = warc.page_records(pages, "2024", least=12)
    assert large.where("warc_type = 'revisit'").count() == 0


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    out = queries()["op8_warc"](spark, SF_DIR)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_pages(rows)
