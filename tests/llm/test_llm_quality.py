from __future__ import annotations

import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from rowforge.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_stop_words": sum(w.lower() in q.STOP_WORDS for w in words),
    }


def figures(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = q.quality(df).select("row.doc_id", "q.*").collect()
    return {r["doc_id"]: r.asDict() for r in rows}


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "a b c a b c",
    "a a a a",
    "x y z\nx y z\n\nx y z\n",
    "é ü #tag $5 100% <b> | été     end",
    "the the the of of of",
    "a\rb\rc a\tb c",
    "😀 😀 😀 😀 word",
    " ".join(f"w{i % 7}" for i in range(20000)),
    " ".join(f"w{i}" for i in range(20000)),
]


def test_figures_agree_with_brute_force(spark):
    got = figures(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, text and text[:40]
        assert got[i]["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (got[i]["base_failed"] and got[i]["kept"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\t", max_size=40), min_size=20, max_size=60))
def test_random_texts(spark, texts):
    got = figures(spark, texts)
    for i, text in enumerate(texts):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, repr(text)


def test_clean_text_is_kept_and_each_rule_rejects(spark):
    clean = " ".join(f"the{i} of word{i} and thing{i}" for i in range(40))
    texts = [
        clean,
        " ".join(f"w{i}### $$$" for i in range(100)),
        " ".join(f"word{i}" for i in range(100)),  # no stop words
        "\n".join(["the line of words and more"] * 30),
        " ".join("x" for _ in range(100)),
    ]
    got = figures(spark, texts)
    assert [got[i]["kept"] for i in range(5)] == [True, False, False, False, False]
    assert not got[1]["passed"]["symbols"] and not got[2]["passed"]["stop_words"]


def test_columns_are_carried_whatever_their_names(spark):
    text = " ".join(f"the{i} of word{i} and thing{i}" for i in range(40))
    df = spark.createDataFrame(
        [(1, text, 7, "x", 1), (1, text, 7, "x", 1), (2, None, None, None, None)],
        "doc_id long, text string, w int, row string, q int",
    )
    kept = q.drop_low_quality(df)
    assert kept.columns == df.columns
    assert [tuple(r) for r in kept.collect()] == [(1, text, 7, "x", 1)] * 2
    assert q.drop_low_quality(df.limit(0)).collect() == []


def test_figures_are_computed_once(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for plan in (q.drop_low_quality(docs), q.quality(docs).where("q.kept and q.n_words > 3 and not q.base_failed")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("sort_array") == 1 and text.count("regexp_extract_all") == 1


def test_filter_on_the_verdict_ends(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    kept = {r[0] for r in q.drop_low_quality(docs).select("doc_id").collect()}
    assert {r[0] for r in q.quality(docs).where("q.kept").select("row.doc_id").collect()} == kept
