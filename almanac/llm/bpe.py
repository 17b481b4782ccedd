"""Byte-level BPE encoding and decoding by distinct words.

Texts are taken apart into pre-tokens (words), and each distinct word is encoded once:

1. Each task packs its texts into blocks: the distinct words, and for every text the sequence of
   its words, position by position, as numbers of words. Blocks are written to the shared folder.
2. The words of all blocks are shuffled by word, so that all copies of a word meet, and each
   distinct word is encoded once.
3. The ids go back to the blocks and are put together by position. The blocks are stored in buckets,
   so that the sequences are not shuffled.

One row for every position would move over ten bytes a word; a packed sequence takes one and a half
after compression. Nothing grows with the corpus but the number of blocks and of shares of words.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import release, stored_by, text_bytes

#: Words of a block: bounds the memory of a task. A longer text is a block of its own.
BLOCK_WORDS = 3_000_000
#: Longer words are merged with a heap, in n log n.
LONG_WORD = 256
ROWS_OUT = 2_000

_ASCII_OF = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


def read_ranks(path: str) -> bytes:
    """A rank file (base64 of the token, rank) as it is; read once, on the driver."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


@lru_cache(maxsize=2)
def _encoding(data: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        "ranks", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(data), special_tokens={}
    )


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: always the adjacent pair of least rank merges, the leftmost first."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (rank := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(queue, (rank, a, end[b]))

    queue: list[tuple[int, int, int]] = []
    for a in range(n - 1):
        offer(a)
    while queue:
        _, a, stop = heapq.heappop(queue)
        b = end[a]
        if not alive[a] or b >= n or end[b] != stop:
            continue
        alive[b] = False
        end[a] = stop
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


def _encode_word(word: str, data: bytes) -> list[int]:
    if len(word) > LONG_WORD:
        return merge_long(word.encode(), _ranks(data))
    return _encoding(data).encode_ordinary(word)


def splitter(pattern: str):
    """Finds the words of a text. ASCII texts take the same pattern with its classes spelt out,
    which the faster engine can run."""
    whole, plain = regex.compile(pattern), pattern
    for name, letters in _ASCII_OF.items():
        plain = re.sub(
            r"\[\^[^]]*\]", lambda m, n=name, x=letters: m[0].replace(n, x), plain
        ).replace(name, f"[{letters}]")
    try:
        ascii_only = None if r"\p" in plain else re.compile(plain, re.ASCII)
    except re.error:
        ascii_only = None

    def words(text: str) -> list[str]:
        return (ascii_only if ascii_only and text.isascii() else whole).findall(text)

    return words


def _packed(*columns: pa.Array) -> bytes:
    out = io.BytesIO()
    batch = pa.record_batch(list(columns), [f"c{i}" for i in range(len(columns))])
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(out, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


def _planes(x: np.ndarray) -> list[pa.Array]:
    """Numbers below 2**32 as four bytes apart: the high ones compress to almost nothing."""
    raw = np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4)
    return [pa.array(np.ascontiguousarray(raw[:, i])) for i in range(4)]


def _joined(batch: pa.RecordBatch, first: int) -> np.ndarray:
    raw = np.stack([batch.column(first + i).to_numpy() for i in range(4)], axis=1)
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


BLOCKS = "block binary, share int, payload binary"


def _pack(shares: int, pattern: str):
    """Texts to blocks. A block has a row of share -1 with its texts, and a row for each share of
    its words, dealt by a hash of the word."""

    def close(ids: list, sequences: list, index: dict) -> Iterator[tuple]:
        block = uuid.uuid4().bytes
        codes = np.concatenate(sequences)
        lengths = pa.array([len(x) for x in sequences], pa.int32())
        names = list(index)
        often = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[often] = np.arange(len(names))
        words = pa.array(names, pa.string())
        share = np.fromiter((zlib.crc32(x.encode()) % shares for x in names), np.int64, len(names))
        by_word = pc.sort_indices(words).to_numpy().astype(np.int64)
        order = by_word[np.argsort(share[by_word], kind="stable")]  # by share, then by word
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        place_of_rank = place[often] if len(names) else place
        yield (block, -1, b"".join(
            len(x).to_bytes(8, "little") + x
            for x in (
                _packed(pa.array(ids, pa.int64()), lengths),
                _packed(*_planes(rank[codes])),
                _packed(*_planes(place_of_rank)),
            )
        ))
        edges = np.searchsorted(share[order], np.arange(shares + 1))
        for k in np.flatnonzero(np.diff(edges)):
            yield block, int(k), _packed(words.take(pa.array(order[edges[k] : edges[k + 1]])))

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        ids, sequences, index, n = [], [], {}, 0

        def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for block, share, payload in found:
                yield pa.record_batch(
                    [
                        pa.array([block], pa.binary()),
                        pa.array([share], pa.int32()),
                        pa.array([payload], pa.binary()),
                    ],
                    ["block", "share", "payload"],
                )

        for batch in batches:
            for doc_id, data in zip(batch.column(0), batch.column(1), strict=True):
                found = split(data.as_py().decode("utf-8", "replace"))
                if sequences and n + len(found) > BLOCK_WORDS:
                    yield from rows(close(ids, sequences, index))
                    ids, sequences, index, n = [], [], {}, 0
                add = index.setdefault
                sequences.append(
                    np.fromiter((add(x, len(index)) for x in found), np.uint32, len(found))
                )
                ids.append(doc_id.as_py())
                n += len(found)
        if sequences:
            yield from rows(close(ids, sequences, index))
        ids, sequences, index = [], [], {}
        release()

    return of_partition


def _encode_share(data: bytes):
    """All copies of a share of the words: each distinct word is encoded once."""

    def of_share(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for block, share, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                out = []
                for word in _unpacked(payload.as_py()).column(0).to_pylist():
                    if (ids := known.get(word)) is None:
                        ids = known[word] = _encode_word(word, data)
                    out.append(ids)
                lengths = np.fromiter(map(len, out), np.int64, len(out))
                flat = np.fromiter((i for ids in out for i in ids), np.uint32, lengths.sum())
                yield pa.record_batch(
                    [
                        pa.array([block.as_py()], pa.binary()),
                        pa.array([share.as_py()], pa.int32()),
                        pa.array(
                            [_packed(pa.array(lengths, pa.int32()))
                             + b"|ids|" + _packed(*_planes(flat))],
                            pa.binary(),
                        ),
                    ],
                    ["block", "share", "payload"],
                )

        known.clear()
        release()

    return of_share


def _reassemble(block: pa.Table, shares: pa.Table) -> pa.Table:
    """The texts of a block, by the ids of its words. Word numbers follow the shares in order."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    if block.num_rows == 0:
        raise RuntimeError("ids came back for a block that is not there")
    payload, parts = block.column("payload")[0].as_py(), []
    while payload:
        size = int.from_bytes(payload[:8], "little")
        parts.append(payload[8 : 8 + size])
        payload = payload[8 + size :]
    docs = _unpacked(parts[0])
    doc_ids, lengths = docs.column(0), docs.column(1).to_numpy()
    codes = _joined(_unpacked(parts[1]), 0)
    place_of_rank = _joined(_unpacked(parts[2]), 0)
    sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    order = np.argsort(shares.column("share").to_numpy())
    for row in order:
        one = shares.column("payload")[int(row)].as_py()
        head = io.BytesIO(one)
        with pa.ipc.open_stream(head) as stream:
            sizes.append(next(iter(stream)).column(0).to_numpy().astype(np.int64))
        flat.append(_joined(_unpacked(one[one.index(b"|ids|", head.tell()) + 5 :]), 0))
    size, flat = np.concatenate(sizes), np.concatenate(flat)
    if len(size) != len(place_of_rank):
        raise RuntimeError("some words of a block came back without ids")
    start = np.cumsum(size) - size
    start, size = start[place_of_rank], size[place_of_rank]  # by rank
    ends = np.cumsum(lengths)
    out = []
    for a, b in zip(ends - lengths, ends, strict=True):
        one = []
        for c in range(a, b, 1_000_000):  # a very long text in pieces
            own = codes[c : min(b, c + 1_000_000)]
            n = size[own]
            before = np.cumsum(n) - n
            at = np.repeat(start[own] - before, n) + np.arange(int(n.sum()))
            one.append(flat[at].tobytes())
        out.append(b"".join(one))
    return pa.table([doc_ids, pa.array(out, pa.binary())], schema=schema)


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    then: Callable[[pa.Table], pa.Table] | None = None, schema: str = "doc_id long, ids binary",
) -> DataFrame:
    """``(doc_id, ids)``: the ids of every text as packed little-endian unsigned 32-bit numbers,
    the form training shards store; ``id_array`` makes an array of them.

    Each match of ``pattern`` is encoded by itself, without special tokens. Missing and empty
    texts have no ids (empty binary). Every row comes back, also without an id or repeated. Other
    columns are not looked at. ``ranks`` is a rank file's content; its tokens bound what is sent
    to the executors. ``then`` works on the tables of results where they are made, and ``schema`` is
    that of what it makes of them; this spares another Python process for each task.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col))
    partitions = picked.rdd.getNumPartitions()
    shares = max(16, 2 * partitions)
    packed = picked.mapInArrow(_pack(shares, pattern), BLOCKS)
    # In buckets, so that the sequences stay where they are and only ids come to them.
    blocks = stored_by(packed, "blocks", "block", max(8, partitions), compression="uncompressed")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def of_share(key, batches):
        yield from _encode_share(sent.value)(key, batches)

    words = (
        blocks.where("share >= 0")
        .withColumn("key", F.col("share"))
        .groupBy("key")
        .applyInArrow(_drop_key(of_share), BLOCKS)
    )
    return (
        blocks.where("share < 0")
        .groupBy("block")
        .cogroup(words.groupBy("block"))
        .applyInArrow(_then(then), schema)
    )


def _then(finish: Callable[[pa.Table], pa.Table] | None):
    def of_block(block: pa.Table, shares: pa.Table) -> pa.Table:
        found = _reassemble(block, shares)
        return finish(found) if finish else found

    return of_block


def _drop_key(function):
    def of_group(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        yield from function(key, (b.select(["block", "share", "payload"]) for b in batches))

    return of_group


def id_array(ids: Column) -> Column:
    """Packed ids as an array."""

    @F.arrow_udf("array<long>")
    def of_batch(data: pa.Array) -> pa.Array:
        return pa.array(
            (None if x is None else np.frombuffer(x, "<u4").astype(np.int64) for x in data.to_pylist()),
            pa.list_(pa.int64()),
        )

    return of_batch(ids)


@lru_cache(maxsize=2)
def _token_table(data: bytes) -> tuple[pa.Array, np.ndarray]:
    ranks = _ranks(data)
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    table = pa.array(tokens, pa.large_binary())
    return table, pc.fill_null(pc.binary_length(table), 0).to_numpy()


def decoded(ids: list[bytes | None], ranks: bytes) -> Iterator[bytes | None]:
    """The bytes of packed ids, joined from the table of tokens."""
    table, length = _token_table(ranks)
    for x in ids:
        if not x:
            yield x
            continue
        found = np.frombuffer(x, "<u4")
        if int(found.max()) >= len(table):
            raise ValueError(f"no token has the id {int(found.max())}")
        piece = table.take(pa.array(found.astype(np.int64)))
        if piece.null_count:
            raise ValueError("an id has no token")
        yield piece.buffers()[2].to_pybytes()[: int(length[found].sum())]


def decode(ids: Column, ranks: bytes) -> Column:
    """The bytes of packed ids, joined from the table of tokens (its size is that of the
    vocabulary, whatever the corpus). An id outside the table is an error; missing ids stay
    missing, none give no bytes."""
    sent = SparkSession.active().sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def of_batch(data: pa.Array) -> pa.Array:
        return pa.array(decoded(data.to_pylist(), sent.value), pa.binary())

    return of_batch(ids)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(sent, with_ids: bool = False) -> Callable[[pa.Table], pa.Table]:
    """Number of tokens, and SHA-256 of the packed ids and of the bytes they decode to. ``sent``:
    the ranks, as broadcast. The ids themselves follow if asked for."""

    def of_table(encoded: pa.Table) -> pa.Table:
        ids = encoded.column("ids").to_pylist()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        out = pa.table({
            "doc_id": encoded.column("doc_id"),
            "n_tokens": pa.array((len(x) // 4 for x in ids), pa.int64()),
            "ids_sha256": pa.array(map(sha, ids), pa.string()),
            "decoded_sha256": pa.array(map(sha, decoded(ids, sent.value)), pa.string()),
        })
        return out.append_column("ids", encoded.column("ids")) if with_ids else out

    return of_table
