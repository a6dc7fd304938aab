import hashlib
import os
import random

import numpy as np
import pytest

from embera.llm import pieces as P

S = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
FILE = "piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"
WORDS = [" ", "  ", "▁", "\n", "\t", "a", "the", "é", "日本", "\U0001f600", "̀", "\0", "<s>", "</s>", "<0x41>", "ﬁ", "　", "​", "ing", " of", "한국", "1234"]


@pytest.fixture(scope="module")
def model():
    with open(public.path(FILE), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return S.SentencePieceProcessor(model_file=public.path(FILE))


def spans(codec, text):
    start, pairs = codec.pairs(text)
    flat = np.frombuffer(pairs, dtype="<u4").reshape(-1, 2)
    ends = start + np.cumsum(flat[:, 1])
    return list(zip(flat[:, 0].tolist(), (ends - flat[:, 1]).tolist(), ends.tolist(), strict=True))


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_like_the_library_with_spans(model, library, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 50)  # both generations are used
    codec = P.Codec(model)
    for text in odd_texts(1, 1500):
        got = spans(codec, text)
        assert [i for i, _, _ in got] == library.encode(text)
        assert got == [(s.id, s.begin, s.end) for s in library.encode(text, return_type="proto").pieces]
        assert b"".join(text.encode()[a:b] for _, a, b in got) == text.encode()


def test_long_text_without_spaces(model, library):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnop日本語") for _ in range(60_000))
    assert [i for i, _, _ in spans(P.Codec(model), text)] == library.encode(text)


def test_decodes_like_the_library(model, library):
    codec, rng = P.Codec(model), random.Random(3)
    for _ in range(3000):  # any ids, also bytes that are no text
        ids = [rng.choice([0, 1, 2, 3, 68, 198, 230, 255, 259, 261, 260, 29871, rng.randrange(32000)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def other_rules(model, charsmap=b"", dummy=1, squeeze=0, escape=1, byte_fallback=1):
    """The model with other rules of normalisation."""
    out = b""
    for number, value in P.fields(model):
        if number == 3:
            value = field(1, b"own") + field(2, charsmap) + field(3, dummy) + field(4, squeeze) + field(5, escape)
        elif number == 2:
            value += field(35, byte_fallback)
        elif number == 1 and not byte_fallback and value[2 : 2 + value[1]].startswith(b"<0x"):
            value = field(1, b"\xee\x80\x80" + value[2 : 2 + value[1]]) + b"\x15\x00\x00\x80\xff" + field(3, 1)
        out += field(number, value)
    return out


def compiled_map():
    """A published character map, as the library ships it."""
    spec = S.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    rules = next(v for k, v in P.fields(spec) if k == 3)
    return dict(P.fields(rules))[2]


@pytest.mark.parametrize("dummy,squeeze,mapped,fallback", [(1, 1, True, 1), (1, 0, True, 1), (0, 1, True, 1), (0, 0, False, 1), (1, 1, False, 1), (1, 0, False, 0), (1, 1, True, 0)])
def test_compiled_maps_and_other_rules(model, dummy, squeeze, mapped, fallback):
    own = other_rules(model, compiled_map() if mapped else b"", dummy, squeeze, 1, fallback)
    library = S.SentencePieceProcessor(model_proto=own)
    codec = P.Codec(own)
    texts = odd_texts(4, 400) + ["①㌔ ½ ＡＢＣ ｱﾞ", "é 각", " 　 a ​ b  ", "   "]
    for text in texts:
        want = library.encode(text, return_type="proto").pieces
        assert spans(codec, text) == [(s.id, s.begin, s.end) for s in want], text
        ids = [s.id for s in want]
        assert codec.decode(ids) == library.decode(ids), text


def test_refuses_what_it_does_not_know(model):
    unigram = b"".join(field(n, v + field(3, 1) if n == 2 else v) for n, v in P.fields(model))
    with pytest.raises(ValueError):
        P.Model(unigram)


def test_tables(spark, model, library):
    texts = [None, "", "A  b", "x" * 5000 + " y", "A  b"]
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids int, starts string")
    rows = {r["doc_id"]: r for r in P.encode(df, model, check=True).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == library.encode(t or "", add_eos=True) and rows[i]["decoded"] == (t or "")
        assert rows[i]["ends"][-1] == len((t or "").encode()) == rows[i]["starts"][-1] and rows[i]["n_tokens"] == len(rows[i]["ids"])
    without = P.encode(df, model, end=False)
    assert {r["doc_id"]: r["ids"] for r in without.collect()} == {i: library.encode(t or "") for i, t in enumerate(texts)}
    back = P.decode(without.withColumn("ids", P.F.when(P.F.col("doc_id") != 2, P.F.col("ids"))), model)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: "" if i == 2 else t or "" for i, t in enumerate(texts)}
    assert P.encode(df.limit(0), model).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_query(spark, library):
    from embera.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_pieces"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r["source_bytes"] == len(texts[r["doc_id"]].encode())
