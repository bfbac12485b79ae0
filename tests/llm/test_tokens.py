import functools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import tokens
from brindle.llm.queries import VOCABULARY, tokenizer_path

from .rows import empty, table


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_packing(bits, ids):
    ids = np.array(ids, np.uint64) & np.uint64((1 << bits) - 1)
    data = tokens.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert tokens.unpack(data, bits, len(ids)).tolist() == ids.tolist()
    plain = sum(int(v) << (i * bits) for i, v in enumerate(ids)).to_bytes(len(data), "little")
    assert data == plain


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def plain(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("abZ09 .,'!|\"\t\n\r\x0b\x0c\x1c\x85  　 é日’-") + ["'s", " the", "don't", "<|endoftext|>", "́"]), max_size=24).map("".join), min_size=1, max_size=4))
def test_pieces_encode_as_the_whole(texts):
    got, n = tokens.encoder(tokenizer_path()).encode(pa.array(texts), 2)
    assert got.tolist() == [x for t in texts for x in plain(t)]
    assert n.tolist() == [len(plain(t)) for t in texts]


def test_added_tokens():
    """Their strings get their one id wherever they stand, as in the library."""
    mark = "<|endoftext|>"
    texts = [f"a{mark}b", f" {mark} x", f"a {mark}  b\n", mark * 3, mark[:-1], f"<|{mark}|>", f"é{mark}日\t{mark}\n\n", "", f"{mark[:7]}", f"{mark[7:]}{mark}", f"word  {mark}{' y' * 100}{mark}"]
    got, n = tokens.encoder(tokenizer_path()).encode(pa.array(texts), 2)
    assert got.tolist() == [x for t in texts for x in plain(t)] and n.tolist() == [len(plain(t)) for t in texts]
    assert plain(texts[0]) == [64, 50256, 65, 2]


def test_tokenizers_whose_added_tokens_take_space(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.add_special_tokens([AddedToken("<x>", lstrip=True)])
    t.save(str(tmp_path / "t.json"))
    texts = ["a  <x> b", "", " <x><|endoftext|>", "c <x>"]
    got, _ = tokens.Encoder(str(tmp_path / "t.json")).encode(pa.array(texts), 2)
    assert got.tolist() == [x for s in texts for x in [*t.encode(s, add_special_tokens=False).ids, 2]]


@pytest.mark.parametrize("bits,block", [(16, 64), (17, 64), (11, 8)])
def test_shards(tmp_path, monkeypatch, bits, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (5, 0, 130, 1, 64, 700)]
    out = tokens.ShardWriter(str(tmp_path), "a.bits", bits)
    for a, b in ((0, 2), (2, 6)):
        out.add(pa.array(range(a, b)), np.concatenate(docs[a:b]), np.array([len(d) for d in docs[a:b]]))
    out.close()
    back = tokens.ShardReader(str(tmp_path), "a.bits")
    whole = np.concatenate(docs)
    assert all((back.document(k) == d).all() for k, d in enumerate(docs))
    for a, b in ((0, 0), (3, 70), (63, 65), (128, 900), (899, 900)):
        assert (back.ids(a, b) == whole[a:b]).all()
    assert [p.name for p in tmp_path.iterdir()] == ["a.bits"]


def test_torn_file(tmp_path):
    (tmp_path / "x.bits").write_bytes(tokens.MAGIC + b"0" * 40)
    with pytest.raises(ValueError):
        tokens.ShardReader(str(tmp_path), "x.bits")


def test_round_trip(spark):
    df = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect()]
    got = sorted(tokens.tokenize(df, tokenizer_path(), VOCABULARY).collect(), key=lambda r: r["start"])
    start = 0
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, got):
        ids = plain(t)
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.tokenize(empty(spark), tokenizer_path(), VOCABULARY).count() == 0
