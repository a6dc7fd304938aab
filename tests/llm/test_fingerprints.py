import hashlib
import random
import unicodedata

import xxhash

from embera.llm import fingerprints as P


def written_out(text):
    """The fingerprint by its description, step by step."""
    out, gap = [], True
    for c in unicodedata.normalize("NFKC", text).casefold():
        if c.isspace():
            gap = True
            continue
        out += [" ", c] if gap and out else [c]
        gap = False
    return xxhash.xxh3_128("".join(out).encode()).hexdigest()


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        f = written_out
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), f(text), f(edited), float(f(text) == f(edited)), float(f(text) == f(after))))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    return sorted((tuple(r) for r in P.fingerprint_documents(df).collect()), key=str)


def test_like_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i * 3 - 50, rnd.choice([None, "", "A b", "ａ　B ", "x" * 5000, "é😀 " * rnd.randint(1, 9), f"t {rnd.randint(0, 5)}"])) for i in range(120)]
    rnd.shuffle(rows)
    for size in (7, 4000):
        monkeypatch.setattr(P, "RANGE", size)
        assert run(spark, rows) == brute(rows)
    # ids that doubles can't tell apart
    near = [((1 << 62) + i, t) for i, (_, t) in enumerate(rows)]
    monkeypatch.setattr(P, "RANGE", 7)
    assert run(spark, near) == brute(near)
    assert run(spark, rows[:1]) == brute(rows[:1])
    assert run(spark, [(None, "abcd"), (1, "efgh")]) == brute([(None, "abcd"), (1, "efgh")])


def test_folding_and_empty(spark):
    assert P.fingerprint("Ｓtraße\n A\tb ") == P.fingerprint("STRASSE a B") != P.fingerprint("strasse ab")
    assert P.fingerprint(None) == P.fingerprint("") == P.fingerprint(" \n")
    assert run(spark, []) == []


def test_bytes_are_compared(spark, monkeypatch):
    """With a fingerprint of no bits, every different text is told apart by its bytes."""
    rows = [(i, f"text {i % 3}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def clash(batches):
        for b in batches:
            yield P.pa.RecordBatch.from_arrays([b.column(0), P.pa.array(["0" * 32] * b.num_rows)], names=["doc_id", "fingerprint"])

    def members(bits):
        def run(batches):
            for b in batches:
                forms = [P.zstandard.compress(P.canonical(t.as_py())) for t in b.column(1)]
                yield P.pa.RecordBatch.from_arrays([b.column(0), P.pa.array(["0" * 32] * b.num_rows), P.pa.array(forms, P.pa.binary())], names=["doc_id", "fingerprint", "form"])

        return run

    monkeypatch.setattr(P, "_fingerprints", clash)
    monkeypatch.setattr(P, "_members", members)
    monkeypatch.setattr(P, "GROUP", 4)
    assert sorted(r["doc_id"] for r in P.collisions(df).collect()) == [i for i in range(9) if i % 3]
