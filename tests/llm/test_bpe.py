import base64

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from embera.llm import bpe
from embera.llm.shared import tokenizer_file

DATA = tokenizer_file()
RANKS = bpe.parse_ranks(DATA)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(DATA, P.PATTERN)


def ids(text):
    return np.array(REF.encode_ordinary(text), dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\t'sdtrellé中1२ 　.!😀\r x<|endoftext|>"), max_size=60) | st.text(max_size=40), max_size=6))
def test_like_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = list(CODEC.encode(texts))
    assert got == [ids(t) for t in texts]
    assert [CODEC.decode(g) for g in got] == [t.encode() for t in texts]


def test_merges_of_lower_rank_go_first():
    # the pair of "x" + "xx" has a lower rank than "xx" itself
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"xx": 400, b"xxx": 5, b"ab": 300, b"abab": 2}
    data = b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items())
    ref = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(data, r"\S+|\s+")
    for t in ("xxxxxxx", "xxxx ababab", "abababab", "xabxxab"):
        assert np.frombuffer(list(codec.encode([t]))[0], dtype="<u4").tolist() == ref.encode_ordinary(t)


def test_spaces_among_white_space():
    ranks = {bytes([b]): b for b in range(256)} | {b"\n ": 300, b" \n": 301, b"\n \n": 302}
    data = b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items())
    ref = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(data, P.PATTERN)
    for t in ("x\n \ny", "x\n \n y", "\n \n", "a \n b", "a\n b", "a\t \n \tb c"):
        assert np.frombuffer(list(codec.encode([t]))[0], dtype="<u4").tolist() == ref.encode_ordinary(t)


def test_table(spark):
    texts = [None, "", "a  b", "word " * 30000, "<|endoftext|>", "x" * 5000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] * 2, "doc_id long, text string, ids string")
    coded = bpe.encode(df, DATA, P.PATTERN, check=True)
    for r in coded.collect():
        t = texts[r["doc_id"]] or ""
        assert bytes(r["ids"]) == ids(t) and bytes(r["decoded"]) == t.encode() and r["n_tokens"] * 4 == len(r["ids"])
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(coded, DATA).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), DATA, P.PATTERN).collect() == []


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    codec = bpe.Codec(DATA, P.PATTERN)
    texts = [" ".join(f"w{i}q{j}" for i in range(40)) for j in range(6)]
    for t in texts:
        assert list(codec.encode([t])) == [ids(t)]
    assert len(codec.chunks) <= 100
