"""Mixtures of languages; accuracy on texts not learnt from."""

import itertools
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from textwarden.llm import language as L

SF = "/root/testdata/sf0.01"
EN = "the house and the garden are with three other things in the street that they know "
DE = "das haus und der garten sind mit drei anderen dingen in der straße die sie kennen "
FR = "la maison et le jardin avec trois autres choses dans cette rue qui nous sont connues "
SCHEMA = "doc_id long, text string, lang string, lang_pred string, mixture string"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, n, "x", "y") for i, (t, n) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr"), ("zzz", None), (None, "en")])]
    return L.train(spark.createDataFrame(rows, SCHEMA), "text", "lang")


def predicted(spark, model, texts):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)
    got = L.identify(docs, {"doc_id": "doc_id"}, "text", model).collect()
    assert len(got) == len(texts)
    return {r["doc_id"]: r for r in got}


def test_single_and_mixed(spark, model):
    assert model[0] == ["de", "en", "fr"]
    got = predicted(spark, model, [EN, DE.upper(), FR, EN * 3 + DE * 2, "", None, "12 !?", "x", EN * 9000])
    assert [got[i]["lang_pred"] for i in range(4)] == ["en", "de", "fr", "en"]
    assert got[0]["mixture"] == {"en": 1.0} and got[8]["lang_pred"] == "en"
    assert set(got[3]["mixture"]) == {"en", "de"}
    assert abs(got[3]["mixture"]["en"] - 0.6) < 0.1 and abs(got[3]["score"] - got[3]["mixture"]["en"]) < 1e-9
    assert [got[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and got[5]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_gain_tells_language_from_noise(spark, model):
    """Texts of the corpus, short and mixed ones are likelier under their mixture than under the background, noise is not."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trained = L.train(docs, "text", "lang")
    told = L.identify(docs, {"doc_id": "doc_id"}, "text", trained).filter("gain IS NOT NULL").collect()
    assert len(told) > 900 and min(r["gain"] for r in told) > 0
    r = np.random.default_rng(1)
    noise = ["".join(r.choice(list("qxzjkvwyäßçœø"), 400)) for _ in range(5)] + ["".join(map(chr, r.integers(0x4E00, 0x9000, 300))), "".join(map(chr, r.integers(0x410, 0x44F, 300)))]
    assert max(r["foreign"] for r in told) == 0
    partly = "ZKIQPTDWXXUFBQSMKLHQ WWXQ Shhely that, the outhing."  # a code and a short text
    got = predicted(spark, trained, [*noise, "", None, partly])
    assert max(got[i]["gain"] for i in range(7)) < -20 and got[7]["gain"] is got[8]["gain"] is None
    assert min(got[i]["foreign"] for i in range(7)) > 0.9 and got[9]["gain"] < 0 and got[9]["foreign"] < 0.8
    # a model of three sentences knows too little to tell
    small = predicted(spark, model, [EN, EN[:30], EN * 2 + FR, *noise])
    assert min(small[i]["gain"] for i in range(3)) > 5 and min(r["gain"] for r in small.values()) > -20


def test_no_labels(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = L.train(none, "text", "lang")
    assert model[0] == []
    got = predicted(spark, model, [EN, "", None])
    assert [got[i]["lang_pred"] for i in range(3)] == [None, "und", "und"]
    assert L.identify(none, {"doc_id": "doc_id"}, "text", model).count() == 0


def test_shares_climb_the_likelihood():
    r = np.random.default_rng(0)
    likely, counts = r.random((50, 3)) + 0.01, r.integers(1, 9, 50).astype(float)
    pi, value = L.shares(counts, likely, np.full(3, 1 / 3))
    assert abs(pi.sum() - 1) < 1e-9 and value >= counts @ np.log(likely @ np.full(3, 1 / 3))
    best = max(
        counts @ np.log(likely @ np.array([a, b, 1 - a - b]))
        for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41)
    )
    assert value > best - 0.5


@pytest.mark.parametrize("every", [L.EVERY_SET, 2])
def test_the_set_is_the_best_of_all(every, monkeypatch):
    """Four related languages: against all subsets, each fitted for very long."""
    monkeypatch.setattr(L, "EVERY_SET", every)
    r, sizes = np.random.default_rng(5), []
    common = r.random(300) ** 3
    likely = common[:, None] * (1 + 0.9 * r.random((300, 4)) ** 2) + 1e-6
    likely /= likely.sum(axis=0)
    for _ in range(30):
        pi = r.dirichlet(np.full(4, 0.4))
        counts = r.multinomial(int(r.integers(50, 20_000)), likely @ pi).astype(float)
        at = np.flatnonzero(counts)
        c, p = counts[at], likely[at]
        price = 0.5 * np.log(c.sum() + 1)

        def value(chosen):
            w = np.full(len(chosen), 1 / len(chosen))
            for _ in range(1500):
                w = w * ((c / (p[:, chosen] @ w)) @ p[:, chosen]) / c.sum()
            return c @ np.log(p[:, chosen] @ w) - price * (len(chosen) - 1)

        values = {s: value(list(s)) for k in range(1, 5) for s in itertools.combinations(range(4), k)}
        got = L.mixture(c, p)
        sizes.append(len(got))
        assert values[tuple(sorted(got))] > max(values.values()) - 0.1
        assert abs(sum(got.values()) - 1) < 1e-6
    assert len(set(sizes)) > 2


def test_counts_do_not_depend_on_pieces(monkeypatch):
    letters = np.unpackbits(np.frombuffer(L.letter_bits(), np.uint8)).view(bool)
    text = "abcdefgh" * 50
    whole = L.trigram_counts(text, letters)
    assert whole.sum() == 400
    assert L.trigram_counts(" 1!", letters) is None
    # a long text's pieces add a frame each, no more
    monkeypatch.setattr(L, "PIECE", 100)
    assert abs(int(L.trigram_counts(text, letters).sum()) - 400) <= 3 * 4


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_accuracy_on_held_out_texts(spark):
    got = entry.queries()["op3_language_mixture"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
