from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from rowforge.llm import language
from rowforge.llm.queries import QUERIES

SENTENCES = {
    "en": "the weather was good and the people of the town were walking along the river with their dogs",
    "de": "das wetter war gut und die leute der stadt gingen mit ihren hunden am ufer des flusses entlang",
    "ru": "погода была хорошая и жители города гуляли вдоль реки со своими собаками весь день",
}


def corpus(n=60):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = list(SENTENCES)[i % 3]
        words = SENTENCES[lang].split()
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(20, 60))), lang))
    return rows


def model(spark, rows, **options):
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), **options)


def test_held_out_accuracy(spark):
    out = QUERIES["op1_language_centroids"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_foreign_texts_are_rejected_and_odd_ones_undetermined(spark):
    m = model(spark, corpus())
    found = m.predict(["The people were walking with the dogs of the town and the weather was good", "погода была хорошая и жители города",
                       "这是一个普通的中文文本这是一个普通的中文文本", None, "", "12 !! 34", "x", "word " * 20000])
    assert list(found["lang_pred"][:2]) == ["en", "ru"] and not found["rejected"][:2].any()
    assert found["rejected"][2] and found["score"][2] < 0.2
    assert list(found["lang_pred"][3:6]) == ["und"] * 3 and list(found["score"][3:6]) == [0.0] * 3
    assert found["lang_pred"][6] in SENTENCES and found["lang_pred"][7] in SENTENCES


def test_training_does_not_hang_on_the_order_of_rows(spark):
    rows = corpus()
    a, b = model(spark, rows), model(spark, rows[::-1])
    assert a.languages == b.languages and np.allclose(a.means, b.means) and np.allclose(a.radii, b.radii)


def test_a_repeated_id_does_not_widen_the_sample(spark):
    rows = [(1, SENTENCES["en"], "en")] * 500 + corpus(30)
    m = model(spark, rows, sample=20)
    assert set(m.languages) == set(SENTENCES)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", None), (2, None, "en"), (None, "12", "en")]])
def test_nothing_learned(spark, rows):
    m = model(spark, rows)
    assert m.languages == [] and list(m.predict(["some text", None])["lang_pred"]) == ["und", "und"]


def test_stage_keeps_columns(spark):
    rows = [(*r, "s", i) for i, r in enumerate(corpus())] + [(99, None, None, None, None), (100, "这是一个普通的中文文本" * 9, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, score long")
    kept = language.drop_rejected(df, language.train(df.where("doc_id < 99")))
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(60))


def test_grams_cover_whole_texts():
    at, n = language.grams("Ab, aB!")
    assert n.sum() == 7 + 6 + 5  # gap a b gap a b gap
    assert language.grams("!!")[0].size == 0
    assert language.grams("𐐀b")[0].size > 0


def brute_force(m, text):
    """Language and cosine of the closest centroid, gram by gram and place by place."""
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    if not words:
        return "und", 0.0
    line = " " + " ".join(words) + " "
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            total = 0
            for c in line[i : i + n]:
                total = (total * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            counts[(total + n) * 0xD6E8FEB86659FD93 % 2**64 >> 40 & language.PLACES - 1] += 1
    weights = {p: (1 + math.log(n)) * m.idf[p] for p, n in counts.items()}
    length = math.sqrt(sum(x * x for x in weights.values()))
    cosines = [sum(x * float(mean[p]) for p, x in weights.items()) / length for mean in m.means]
    best = max(range(len(cosines)), key=lambda k: cosines[k])
    return m.languages[best], cosines[best], 1 - cosines[best] > m.radii[best]


def test_query_agrees_with_brute_force(spark):
    """Every 40th document of the query's result against all centroids, without vectors."""
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang")
    m = language.train(docs.where(~language.held_out(docs["doc_id"], 3, 1)))
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id % 40 = 0").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op1_language_centroids"](spark, path).collect()}
    assert len(texts) > 20
    for key, text in texts.items():
        lang, cosine, *_ = brute_force(m, text or "")
        assert got[key]["lang_pred"] == lang and abs(got[key]["score"] - cosine) < 1e-4, key


def test_predictions_agree_with_brute_force(spark):
    m = model(spark, corpus())
    some = ["the dogs", "Die Hunde, der Fluß!", "река и GOROD", "il tempo era bello e la gente della città camminava lungo il fiume",
            "x", "a1b2", "İstanbul ǅ ß", "这是 一个", "the " * 5000]
    found = m.predict(some)
    for text, row in zip(some, found.itertuples()):
        lang, cosine, rejected = brute_force(m, text)
        assert abs(row.score - max(0.0, cosine)) < 1e-4 and row.rejected == rejected, text
        assert row.lang_pred == lang or cosine < 1e-4, text
