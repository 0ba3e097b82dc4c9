"""Inverted indexes: lists of bounded length, files read, added documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowforge.sources.postings import Postings, posting_lists


@pytest.fixture(scope="module")
def made_up():
    rng = random.Random(6)
    names = [f"w{i}" for i in range(400)]
    return {i: ["the", *(rng.choice(names) for _ in range(rng.randint(0, 20)))] for i in range(500)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id long, words array<string>")


@pytest.fixture(scope="module")
def index(spark, made_up, tmp_path_factory):
    some = {i: w for i, w in made_up.items() if i < 300}
    root = str(tmp_path_factory.mktemp("postings"))
    first = Postings.create(frame(spark, some), root, "id", F.col("words"), list_ids=16, rows_per_file=40)
    rest = {i: w for i, w in made_up.items() if i >= 300}
    first.append(frame(spark, rest), "id", F.col("words"), list_ids=16)
    return Postings.open(spark, root)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_searches(index, made_up):
    assert ids(index.search(["W7", "w9", "none"])) == [i for i, w in made_up.items() if {"w7", "w9"} & set(w)]
    assert ids(index.search(["the", "w7"], every=True)) == [i for i, w in made_up.items() if "w7" in w]
    assert ids(index.search(["w7", "none"], every=True)) == [] == ids(index.search(["none"]))
    assert ids(index.search(["the"])) == list(made_up)
    assert [tuple(r) for r in index.frequency(["the"]).collect()] == [("the", 500)]


def test_a_search_opens_few_files_and_no_text(index):
    files = index.store.files().count()
    assert files > 10 and len(index.search(["w7"]).inputFiles()) <= 4


def test_a_frequent_word_is_cut_into_lists(index):
    lists = index.lists(["the"]).select("ids", "first_id", "n").collect()
    assert len(lists) > 30 and max(len(r["ids"]) for r in lists) <= 16
    assert all(r["ids"] == sorted(r["ids"]) and r["first_id"] == r["ids"][0] and r["n"] == len(r["ids"]) for r in lists)


def test_nulls_and_repeats(spark):
    rows = [(1, ["a", "a", None]), (1, ["a"]), (2, None), (None, ["a"]), (3, [])]
    lists = posting_lists(spark.createDataFrame(rows, "id long, words array<string>"), "id", F.col("words"))
    assert [(r["word"], r["ids"]) for r in lists.collect()] == [("a", [1])]


def test_lists_are_whole_and_full_and_made_once(spark, made_up, tmp_path):
    """However the ids are sliced, a word has its ids in order in full lists; the words of a
    text are split once, not for every step that counts, samples or writes the lists."""
    splits = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        splits.add(1)
        return text.split(" ")

    # ids come twice, in no order, with the same words and with others
    rows = [(7 * i % 500 - 250, " ".join(made_up[i])) for i in range(500)]
    rows += [(i, " ".join(made_up[j])) for j, (i, _) in enumerate(rows[:60])]
    expected = {}
    for i, text in rows:
        for word in text.split(" "):
            expected.setdefault(word, set()).add(i)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    index = Postings.create(docs, str(tmp_path), "id", split(F.col("text")), list_ids=16, rows_per_file=100)
    assert splits.value == len(rows)
    found = {}
    for r in index.store.rows().orderBy("word", "first_id").collect():
        assert r["first_id"] == r["ids"][0] and r["n"] == len(r["ids"])
        found.setdefault(r["word"], []).append(r["ids"])
    assert {w: [i for ids in lists for i in ids] for w, lists in found.items()} == {w: sorted(ids) for w, ids in expected.items()}
    assert all(len(ids) == 16 for lists in found.values() for ids in lists[:-1])
    assert all(len(lists[-1]) <= 16 for lists in found.values())
