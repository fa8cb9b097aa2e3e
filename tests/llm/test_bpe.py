import base64

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import Encoder, encoder, piece_starts, read_ranks
from tidemark.llm.encoding import decode_ids, encode_texts, vocabulary

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def coder():
    return encoder(vocabulary())


@pytest.fixture(scope="module")
def other():
    with open(vocabulary(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lists(coder, texts):
    ids, counts = coder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts)]


ODD = ["", None, " ", "\n", "  a", "a  b \n\n c  ", "'s", "it's we'll I'VE 'sample' ''s '' 'llama", "x's's", "<|endoftext|>", "é漢字🙂 ́ñ", "١٢٣ ½ Ⅳ", "​  　", "\r\n\t\x1c\x85", "a" * 5000, "=" * 5001, " " * 4999 + "x", "🙂" * 700]


def test_odd_texts(coder, other):
    assert lists(coder, ODD) == [other.encode_ordinary(t) if t else [] for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'sdtmlvreaBZ09 \n\t.,=_é漢🙂́ ", max_size=40), min_size=1, max_size=5))
def test_texts_do_not_touch(coder, other, texts):
    assert lists(coder, texts) == [other.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "ba", "aa", "abc", "c", "bc", "aab"]), min_size=1, max_size=25))
def test_backtracking_equals_merging(parts):
    coder = Encoder([b"a", b"b", b"c", b"ab", b"aa", b"bc", b"aab", b"abc", b"baa", b"abab"])
    piece = "".join(parts).encode()
    assert coder.piece(piece) == coder.merged(piece)


def test_round_trip(coder):
    ids, _ = coder.encode(pa.array([t or "" for t in ODD]))
    assert coder.decode(ids) == "".join(t or "" for t in ODD).encode()
    assert coder.decode(np.array([], np.int64)) == b""


def test_pieces():
    points = np.array([ord(c) for c in "a  b"], np.uint32)
    assert piece_starts(points, np.array([0])).tolist() == [True, True, True, False]


def test_ranks_without_gap(tmp_path):
    path = tmp_path / "v.tiktoken"
    path.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="gap"):
        read_ranks(str(path))


def test_in_spark(spark, other):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, ODD[5], "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode_texts(df, ["doc_id"], count="n").collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.n or not ODD[r.doc_id]}
    assert all(r.ids == (other.encode_ordinary(ODD[i]) if ODD[i] else []) and r.n == len(r.ids) for i, r in by_id.items() if i)
    assert encode_texts(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="clash"):
        encode_texts(df, ["ids"])
    back = {r.doc_id: r.text for r in decode_ids(encode_texts(df.where("ids = 'x'"), ["doc_id"]), ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
