import os
import zlib

import numpy as np
import pytest

from embera.llm import quality as Q

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    train, test = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0")
    model = Q.fit(docs, train)
    got = Q.score_documents(docs, model).join(test, "doc_id").select("quality", "quality_score", "text_score", "meta_score", "keep").toPandas()
    assert len(got) > 300
    good = got["quality"] == 1
    assert got.loc[good, "keep"].mean() >= 0.99  # clean documents stay
    assert got.loc[~good, "keep"].mean() <= 0.1
    for view, least in (("quality_score", 0.97), ("text_score", 0.97), ("meta_score", 0.9)):
        assert ((got[view] >= 0.5) == good).mean() >= least, view
    # both views hand over documents, and more of them in every round
    totals = [[sum(view) for view in handed] for handed in model.handed]
    print("handed", model.handed)
    assert len(totals) == Q.ROUNDS and all(t > 0 for t in totals[0])
    assert all(b > a for x, y in zip(totals, totals[1:]) for a, b in zip(x, y, strict=True))


def test_repetition_and_short_texts():
    assert Q.word_repetition(b"") == Q.word_repetition(b"one") == (0.0, 0.0, 0.0, 0.0)
    assert Q.word_repetition(b"a b c d") == (0.0, 0.0, 0.0, 0.0)
    same, root, pairs, most = Q.word_repetition(b"No no\nNO no no")
    assert (same, root, pairs, most) == (1.0, 1.0, 0.75, 0.8)
    assert len(Q.text_view(None)) == len(Q.text_view("ab")) == len(Q.text_view("a b c")) == Q.TEXT


def test_without_labels_and_bad_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "x" * 200000, "de", None), (None, "abc", "en", "s"), (2, "again", "en", "s")]
    names = ["y", "id", "row", "s", "f", "meta", "part", "sums", "n_chars", "_s", "_id", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *(f"1 as `{n}`" for n in names))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.fit(docs, none) is None
    two = spark.createDataFrame([(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r["keep"] for r in Q.score_documents(docs, Q.fit(docs, two)).collect()] == [True] * 5  # no good document held apart
    assert [r["keep"] for r in Q.score_documents(docs, None).collect()] == [True] * 5
    rng = np.random.default_rng(0)
    many = [(i, ("!!! ### " * int(rng.integers(3, 30))) if i % 2 else "a plain text of words " * int(rng.integers(2, 20)), "en", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(150)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(spark.createDataFrame(many, "doc_id long, text string, lang string, source string"), labels)
    got = Q.score_documents(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["quality_score"] <= 1 for r in got)
    clash = docs.selectExpr("*", "'x' as keep", "'x' as quality_score", "'x' as text_score")
    scored = Q.score_documents(clash, model)
    assert scored.columns == [*docs.columns, "text_score", "meta_score", "quality_score", "keep"] and scored.where("keep").count() == sum(r["keep"] for r in got)
    again = {r["doc_id"]: r["keep"] for r in Q.score_documents(spark.createDataFrame(many, "doc_id long, text string, lang string, source string"), model).collect()}
    assert all(again[i] == (i % 2 == 0) for i in again)
    assert Q.score_documents(docs.limit(0), model).collect() == []


def sites(n, seed):
    """Documents whose sources tell as much as their texts; junk of unlabelled ones has another form."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad, labelled = bool(rng.random() < 0.4), i < n // 3
        junk = "!!! ### $$$ " if labelled or rng.random() < 0.3 else "zq xw qz wx "
        text = junk * int(rng.integers(5, 30)) if bad else " ".join(rng.choice(["some", "plain", "words", "about", "things", "people", "said"], int(rng.integers(20, 90))))
        source = f"{'bad' if bad == (rng.random() < 0.95) else 'good'}{rng.integers(3)}"
        rows.append((i, text, "en", source, len(text), bad))
    return rows


def plain(views, y, pool, rounds):
    """Co-training by sorted lists and sums over single rows."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    held = Q.held_apart(y)
    train = [v[~held].astype(float) for v in views]
    t, fixed = y[~held], [(v.mean(axis=0), v.std(axis=0) + 0.05) for v in train]
    z = lambda v, x: np.c_[(x - fixed[v][0]) / fixed[v][1], np.ones(len(x))]
    each = np.where(t == 1, 0.5 * len(t) / (t == 1).sum(), 0.5 * len(t) / (t == 0).sum())

    def step(v, w, x, label, weight):
        p = sigmoid(x @ w)
        hold = np.full(len(w), Q.PENALTY * weight.sum())
        hold[-1] = 1e-6
        odds = np.maximum(np.abs(x @ w), 1e-6)
        bound = np.tanh(odds / 2) / (2 * odds)
        return w - np.linalg.solve((x * (weight * bound)[:, None]).T @ x + np.diag(hold + 1e-3), x.T @ (weight * (p - label)) + hold * w)

    w = [np.zeros(v.shape[1] + 1) for v in views]
    for v in (0, 1):
        for _ in range(Q.FIRST):
            w[v] = step(v, w[v], z(v, train[v]), t, each)
    given, base = [{}, {}], np.log((y[held] == 1).sum() / (y[held] == 0).sum())
    for _ in range(rounds):
        for v in (0, 1):
            a, b = Q._platt(z(v, views[v][held]) @ w[v], y[held])
            odds = np.clip(a * (z(v, pool[v]) @ w[v]) + b - base, -30, 30)
            bins = sorted(np.floor((o + 30) * Q.BINS) for i, o in enumerate(odds) if i not in given[v])
            quota = len(bins) / (4 * rounds)
            low = bins[int(np.ceil(quota * (1 - t.mean()))) - 1]
            high = bins[::-1][int(np.ceil(quota * t.mean())) - 1]
            for i, o in enumerate(odds):
                if o <= min(-Q.SURE, (low + 1) / Q.BINS - 30):
                    given[v].setdefault(i, 0)
                elif o >= max(Q.SURE, high / Q.BINS - 30):
                    given[v].setdefault(i, 1)
        for v in (0, 1):
            own = given[1 - v]
            many = [max(1, sum(c == k for c in own.values())) for k in (0, 1)]
            weight = [min(1.0, each[t == k].sum() / many[k]) for k in (0, 1)]
            x = np.r_[z(v, train[v]), z(v, pool[v][list(own)])] if own else z(v, train[v])
            for _ in range(Q.STEPS):
                # labelled rows hold weights back by their number, as their class weights add up to it
                w[v] = step(v, w[v], x, np.r_[t, list(own.values())], np.r_[each, [weight[c] for c in own.values()]])
    return w, [[sum(c == k for c in g.values()) for k in (0, 1)] for g in given]


def test_rounds_move_labels_and_change_the_views(spark):
    rows = sites(900, 4)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(20)
    labels = spark.createDataFrame([(r[0], int(not r[5]), 0) for r in rows[:300]], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    # both views label documents of both classes, and more of them round by round
    assert len(model.handed) == Q.ROUNDS and all(min(h) > 0 for h in model.handed[-1])
    assert all(sum(b) >= sum(a) for x, y in zip(model.handed, model.handed[1:]) for a, b in zip(x, y)) and sum(map(sum, model.handed[-1])) > sum(map(sum, model.handed[0]))
    order = sorted(rows[:300], key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    half = lambda x: x.astype("<f2").astype(np.float32)
    view = lambda some: (half(np.stack([Q.text_view(r[1]) for r in some])), Q.meta_view(np.array([Q.meta_places(r[1], r[2], r[3], r[4]) for r in some])))
    own, pool, y = view(order), view(rows[300:]), np.array([float(not r[5]) for r in order])
    w, handed = plain(own, y, pool, Q.ROUNDS)
    assert model.handed[-1] == handed
    for v in (0, 1):
        assert np.abs(model.models[v].w - w[v]).max() < 0.02 * max(1, np.abs(w[v]).max())
    # junk of the new form is known by its sources only, until the metadata view teaches the text view
    alone = Q.CoTrained(own, y, lambda of: None)
    new = [r for r in rows[300:] if r[5] and r[1].startswith("zq")]
    rate = lambda m: float((m.score(*view(new))[0] < 0.5).mean())
    assert not alone.handed and rate(model) > 0.9 and rate(model) >= rate(alone)
    taught = lambda m: float(m.models[0].odds(view(new)[0]).mean())
    assert taught(model) < taught(alone) - 0.1  # steps follow a bound of the loss, so they don't overshoot


def test_cuts():
    counts = np.zeros(2 * 30 * Q.BINS + 1, dtype=int)
    counts[[100, 200, 2800, 2900]] = 30, 30, 30, 30
    bad, good = Q.cuts_of(counts, 0.5, 1)  # 15 of each class: the outer bins as a whole
    assert abs(bad - (101 / Q.BINS - 30)) < 1e-9 and abs(good - (2900 / Q.BINS - 30)) < 1e-9
    middle = np.zeros_like(counts)
    middle[1500] = 10
    assert Q.cuts_of(middle, 0.5, 1) == (-Q.SURE, Q.SURE)  # nobody is sure
