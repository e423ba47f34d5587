"""Encoding, token files and counts against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from storyflow.llm import bpe, byte_pieces, token_counts, token_file
from storyflow.llm.queries import BYTE_BPE, WORD_BPE

PARTS = ["a", "B", " ", "  ", "\n", "é", "é", "Σ", "σ", "İ", "'s", "'LL", ".", "!!", "1", "٣", "\x1c", "\x85", " ", "　", "日",
         "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "😀", "̈", "\x00", "x" * 150, " x", "\t", "\r\n", "the", "ﬁ"]


def made(n, longest, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, longest))) for _ in range(n)]


def parted(flat, sizes):
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("longest", [2, 6, 14])
def test_ids_equal_the_library(longest):
    rows = made(3000, longest) + ["", None]
    for path, got in ((WORD_BPE, bpe.encoder(WORD_BPE).encode_all(pa.array(rows))), (BYTE_BPE, byte_pieces.encode_all(BYTE_BPE, pa.array(rows)))):
        lib = Tokenizer.from_file(path)
        assert parted(*got) == [e.ids for e in lib.encode_batch([r or "" for r in rows], add_special_tokens=False)]


def test_long_words_take_the_heap_with_the_same_result():
    ranks = bpe.Ranks(WORD_BPE)
    rng = random.Random(1)
    for n in (1, 2, 3, 40, 99, 100, 101, 3000):
        ids = ranks.symbols("".join(rng.choices("abtheinr", k=n)))
        assert ranks._heap(list(ids)) == ranks._scan(list(ids))[0]
    bounds = ranks._scan(ranks.symbols("thequickbrown"))[1]
    assert bounds[0] == 0 and bounds == sorted(bounds)


def test_round_trip_keeps_rows_and_extra_columns(spark, documents):
    rows = [(1, "Hello World's"), (1, "Hello World's"), (2, None), (3, ""), (None, "x"), (4, "ab " * 20000)]
    docs = documents(rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    got = bpe.decode(bpe.encode(docs, WORD_BPE), WORD_BPE).collect()
    lib = Tokenizer.from_file(WORD_BPE)
    want = sorted((str(i), lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert all(r.decoded == lib.decode(list(r.ids), skip_special_tokens=False) for r in got)
    assert bpe.encode(docs.limit(0), WORD_BPE).count() == 0


def test_decode_passes_over_unknown_ids(spark):
    df = spark.createDataFrame([([320, None, 10**6, -1],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, WORD_BPE).collect()] == ["a</w>", "", ""]


def test_counts_equal_the_library(spark, documents):
    rows = [(k, t) for k, t in enumerate(made(200, 30))] + [(7, "twice"), (7, "twice"), (900, None), (None, ""), (901, "word " * 9000)]
    rows += [(1000 + k, "Zxqv flurbish") for k in range(150)]
    lib = Tokenizer.from_file(BYTE_BPE)
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    docs = documents(rows).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "pre")
    got = token_counts.token_counts(docs.repartition(3), BYTE_BPE).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(docs.limit(0), BYTE_BPE).count() == 0


def test_frequencies_beyond_the_packed_bits():
    found, sizes, packed = token_counts._postings(np.full(10_000, 3), np.zeros(10_000, np.int64))
    assert found.tolist() == [3] and int((packed & ((1 << token_counts.FREQ_BITS) - 1)).sum()) == 10_000 and sizes.sum() == len(packed)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 1000])
def test_elias_fano_boundaries(n):
    rng = np.random.default_rng(n)
    sizes = rng.integers(0, 50, n)
    if n > 2:
        sizes[1] = 20_000
    ends, ids = np.cumsum(sizes), rng.integers(0, 60_000, int(sizes.sum()))
    data = token_file.pack(ids, ends, 2)
    got = token_file.Segment(data)
    assert got.ends().tolist() == ends.tolist() and got.ids.tolist() == ids.tolist()
    assert [got.end(i) for i in range(n)] == ends.tolist()
    if n == 1000:
        assert got.document(5).tolist() == ids[ends[4] : ends[5]].tolist()
        assert len(data) - 2 * len(ids) < 2 * n  # bytes for all boundaries


def test_token_file_in_id_order(spark, documents, monkeypatch, tmp_path):
    rows = [(k * 3 % 101, t) for k, t in enumerate(made(101, 20))] + [(5, None), (6, ""), (None, "first"), (500, "long " * 5000)]
    lib = Tokenizer.from_file(BYTE_BPE)
    folder = str(tmp_path / "tokens")
    token_file.write_tokens(documents(rows).repartition(4), folder, BYTE_BPE)
    got = sorted(token_file.documents(token_file.read_tokens(spark, folder)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    assert len(got) == len(rows)
    starts = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == starts[:-1].tolist()
    want = sorted(zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for _, t in rows)
    assert sorted(r.ids_crc32 for r in got) == want
    token_file.write_tokens(documents(rows).limit(0), folder + "0", BYTE_BPE)
    assert token_file.documents(token_file.read_tokens(spark, folder + "0")).count() == 0


def test_the_byte_symbols_cover_the_vocabulary():
    assert len(set(bpe.byte_symbols())) == 256 and public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE


def test_what_is_decoded_at_once_does_not_grow_with_a_batch():
    """A batch of ten thousand long lists came out as one batch of all their texts."""
    import types

    ids = pa.array([[320] * 1000] * 3000 + [None, [], [320] * (bpe.TOKENS + 5)], pa.list_(pa.int32()))
    frame = types.SimpleNamespace(schema=types.SimpleNamespace(fields=[]), columns=["ids"], mapInArrow=lambda run, out: run)
    got = list(bpe.decode(frame, WORD_BPE)(iter([pa.record_batch([ids], ["ids"])])))
    assert max(len(b.column("ids").flatten()) for b in got if b.num_rows > 1) <= bpe.TOKENS and len(got) > 11
    assert pa.concat_arrays([b.column("ids") for b in got]).equals(ids)
    texts = [t for b in got for t in b.column("decoded").to_pylist()]
    assert texts == [" ".join(["a</w>"] * len(x or [])) for x in ids.to_pylist()]


def test_a_worker_that_is_through_holds_no_batch(monkeypatch):
    """Workers outlive their stage; the last batch stayed with them while the next stage ran."""
    import types

    from storyflow.llm import common

    held, ids = [], [320] * 1000
    for module in (bpe, common):
        monkeypatch.setattr(module, "trimmed", lambda: held.append(pa.total_allocated_bytes()))
    frame = types.SimpleNamespace(schema=types.SimpleNamespace(fields=[]), columns=["ids"], mapInArrow=lambda run, out: run)
    assert [b.num_rows for b in bpe.decode(frame, WORD_BPE)(iter([]))] == []
    before, rows = pa.total_allocated_bytes(), 0
    for batch in bpe.decode(frame, WORD_BPE)(pa.record_batch([pa.array([ids] * 3000, pa.list_(pa.int32()))], ["ids"]) for _ in range(2)):
        rows += batch.num_rows  # the last one is still held, as Spark's writer holds it
    assert rows == 6000 and held[-1] - before < 1 << 20
