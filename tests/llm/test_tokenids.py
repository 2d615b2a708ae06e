"""Simple-8b files of token ids: exact round trips, the library's ids, nulls, ties, empty tables."""

from __future__ import annotations

import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sirenlens.llm import tokenids
from sirenlens.llm.common import prepared
from sirenlens.llm.tokens import tokenizer_path
from sirenlens.session import shared_dir

DOCS = "doc_id long, text string, ids int, start int, value int, path string, last int, h int"


@pytest.fixture(scope="module")
def sp(spark):
    return prepared(spark)


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out.no_truncation()
    return out


def texts(rng):
    alphabet = ["a", "Word", "é", "é", "«x»", "“q”", "日本", " ", "  ", "\n", "\t", " ", "　", " ", " ",
                "\u0085", "\x1c", "'s", "12", "!?", "<|endoftext|>", "😀", "ß", "x" * 50]
    out = ["".join(rng.choice(alphabet) + rng.choice(["", "", " "]) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*out, "", " ", "a  b", " a", "a ", "a b", None, "long " * 40_000, "é a à b"]


@pytest.mark.parametrize("top", [1, 2, 256, 50257, 1 << 31, 1 << 60, (1 << 64) - 1])
def test_words_give_back_every_id(top):
    rng = np.random.default_rng(7)
    for n in (0, 1, 119, 120, 121, 4095, 4096, 4097, 20_000):
        ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        ids[rng.random(n) < 0.5] = 0
        words, sizes = tokenids.pack(ids)
        counts = np.minimum(tokenids.BLOCK, n - tokenids.BLOCK * np.arange(len(sizes)))
        assert tokenids.unpack(words, sizes, counts).tolist() == ids.tolist()
        assert sizes.sum() == len(words)


def test_any_blocks_are_read_without_the_others():
    ids = np.random.default_rng(3).integers(0, 1 << 62, 5 * tokenids.BLOCK + 17, dtype=np.uint64)
    words, sizes = tokenids.pack(ids)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.array([tokenids.BLOCK, 17])
    got = tokenids.unpack(words[offset[4] :], sizes[4:], counts)
    assert got.tolist() == ids[4 * tokenids.BLOCK :].tolist()


def test_a_word_holds_as_many_ids_as_fit():
    assert len(tokenids.pack(np.zeros(240, np.uint64))[0]) == 2
    assert len(tokenids.pack(np.full(9, 40_000, np.uint64))[0]) == 3
    assert len(tokenids.pack(np.full(8, 30_000, np.uint64))[0]) == 2
    assert len(tokenids.pack(np.full(2, 1 << 63, np.uint64))[0]) == 4


def test_pieces_give_the_librarys_ids(library):
    column = pa.array(texts(random.Random(1)))
    encoder = tokenids.Encoder("byte_bpe_50k.json", 0)
    for part in (column, column.slice(5, 90), column):
        ids, counts = encoder.encode(part)
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in part.to_pylist()]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_documents_come_back_in_order(sp, library, monkeypatch):
    rng = random.Random(2)
    found = texts(rng)
    rows = [(k * 3 % 1000, t, 1, 2, 3, "p", 4, 5) for k, t in enumerate(found)]
    rows += [(None, "no id", 1, 2, 3, "p", 4, 5)] * 3 + [(7, "twice", 1, 2, 3, "p", 4, 5)] * 200
    docs = sp.createDataFrame(rows, DOCS).repartition(5)
    files = tokenids.write_ids(docs, f"file:{shared_dir(sp).removeprefix('file:')}/ids-{uuid.uuid4().hex}")
    got = sorted(tokenids.read_ids(files).collect(), key=lambda r: r.start)
    ids_of = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    assert sorted((r.doc_id is None, r.doc_id, tuple(r.ids)) for r in got) == sorted(
        (d is None, d, tuple(ids_of(t))) for d, t, *_ in rows
    )
    order = [(r.doc_id is None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids)
    digests = {r.start: r for r in tokenids.read_digests(files).collect()}
    assert len(digests) == len(got)
    for r in got:
        d = digests[r.start]
        assert (d.doc_id, d.n_tokens) == (r.doc_id, len(r.ids))
        assert d.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_no_documents_are_no_files(sp):
    files = tokenids.write_ids(sp.createDataFrame([], DOCS), f"{shared_dir(sp)}/ids-{uuid.uuid4().hex}")
    assert files.count() == 0
    assert tokenids.read_ids(files).count() == tokenids.read_digests(files).count() == 0


def test_a_damaged_file_is_refused(sp):
    folder = f"{shared_dir(sp)}/ids-{uuid.uuid4().hex}"
    path = tokenids.write_ids(sp.createDataFrame([(1, "a b c")], "doc_id long, text string"), folder).first().path
    name = path.removeprefix("file:")
    with open(name, "rb") as file:
        content = bytearray(file.read())
    content[-40] ^= 1
    with open(name, "wb") as file:
        file.write(content)
    with pytest.raises(ValueError, match="whole file"):
        tokenids.read_file(path)
