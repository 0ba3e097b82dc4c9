from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rowforge.llm import packing


def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


ODD = [
    "",
    "Hello, World! it's 12345 é é ﬁ Σς ΑΣ\n\n\tnew  line",
    "<|endoftext|> a<|endoftext|>b <|startoftext|>",
    "a b c\u0085d\x1ce\x0bf\r\ng",
    "中文 テスト 한국어 😀😀 👩‍👩‍👧",
    " ́x ' 's 'S don't",
    "x" * 30000,
    "word " * 3000,
    "\n \n",
]


def test_ids_of_fragments_are_ids_of_texts():
    t, words = tokenizer(), packing.WordIds(packing.tokenizer_path())
    rng = random.Random(5)
    texts = ODD + ["The, THE; the!! İstanbul Σ ΟΔΥΣΣΕΥΣ ß ẞ Ÿ ÀÉ, é. a's, O'Neil's l'été. x|y a| | ½ ²", "é" * 50 + ",", "ŀ ǆ Ǆ ŉ, ſt"] + ["".join(rng.choice("aé '<|>12.\n\t ßΣ") for _ in range(200)) for _ in range(300)]
    for text, ids in zip(texts, words.of(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:60])


def test_ids_of_letters_of_every_block_before_marks_and_digits():
    """Letters, marks, digits and combining signs of many blocks, next to each other."""
    t, words = tokenizer(), packing.WordIds(packing.tokenizer_path())
    rng = random.Random(9)
    letters = [chr(c) for c in [*range(0x41, 0x250), *range(0x300, 0x345), *range(0x370, 0x400), *range(0x1E00, 0x1F00)]]
    texts = [f"{x}, {x}.{x}1 a{x}-" for x in letters] + [
        "".join(rng.choice(rng.choice([letters, "İiıI", ",.!-'", "09 "])) for _ in range(60)) for _ in range(2000)
    ]
    for text, ids in zip(texts, words.of(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_store_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    words, t = packing.WordIds(packing.tokenizer_path()), tokenizer()
    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(40))
        assert np.frombuffer(words.of([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(words.kept) + len(words.older) <= 50 + 2 * 41 + 2


def test_a_word_is_encoded_once_whatever_marks_follow_it(monkeypatch):
    words, asked = packing.WordIds(packing.tokenizer_path()), []
    encode_words = words._encode_words
    monkeypatch.setattr(words, "_encode_words", lambda w: asked.extend(w) or encode_words(w))
    t = tokenizer()
    for text in ["Thelorn, oughtier!", "thelorn. Oughtier;", "(thelorn) thelorn's oughtier***"]:
        assert np.frombuffer(words.of([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == ["oughtier", "thelorn"]


def test_special_tokens_are_those_written_in_lower_case():
    t, words = tokenizer(), packing.WordIds(packing.tokenizer_path())
    texts = ["<|ENDOFTEXT|> A,b", "a<|StartOfText|>b", "Ab<|endoftext|>Cd, e", "<|endoftext |> x|>", "A<|b, C<"]
    for text, ids in zip(texts, words.of(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_two_million_characters_are_split_at_a_time(monkeypatch):
    """A worker holds several Arrow arrays of what it splits."""
    words, seen = packing.WordIds(packing.tokenizer_path()), []
    monkeypatch.setattr(words, "_of_batch", lambda texts: seen.append(texts) or [b""] * len(texts))
    texts = ["word " * 50_000] * 20 + ["word " * 500_000] + ["a"] * 3
    assert words.of(texts) == [b""] * len(texts) and sum(seen, []) == texts
    assert all(len(batch) == 1 or sum(map(len, batch)) <= 1 << 21 for batch in seen)


def test_slots_need_no_python_workers(spark):
    slots = packing.plan_slots({2048: 3, 1000: 5, 7: 2})
    frame = packing._slot_table(spark, slots)
    assert [tuple(r) for r in frame.collect()] == slots
    assert [t for _, t in frame.dtypes] == ["bigint"] * 6
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    assert packing._slot_table(spark, []).collect() == []


def test_ids_do_not_hang_on_the_batches_of_texts(monkeypatch):
    t, words = tokenizer(), packing.WordIds(packing.tokenizer_path())
    texts = ["", "one, two\nthree", "", "", "x" * 50, "four. five", "", "one two"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for size in (1, 15, 60, 1 << 20):
        monkeypatch.setattr(packing, "BATCH_CHARS", size)
        assert [np.frombuffer(x, "<u4").tolist() for x in words.of(texts)] == want
    assert words.of([]) == [] and words.of([""]) == [b""]


def placed(slots, counts, capacity):
    bins = {}
    for length in counts:
        for rank in range(counts[length]):
            (slot,) = [s for s in slots if s[0] == length and s[1] <= rank < s[2]]
            _, first, _, sequence, per, at = slot
            j = rank - first
            bins.setdefault(sequence + j // per, []).append((at + j % per * length, length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def best_fit(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [i for i, r in enumerate(rooms) if r >= length]
            if fitting:
                rooms[min(fitting, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(capacity - length)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 25), max_size=12))
def test_plan_on_counts_is_best_fit_on_pieces(counts):
    assert placed(packing.plan_slots(counts, 30), counts, 30) == best_fit(counts, 30)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, t) for t in ODD], [(i % 3, t) for i, t in enumerate(ODD * 20)], [(None, "x y"), (None, "x y")]])
def test_every_piece_is_packed_once_without_gaps(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "'x' as piece")
    got = packing.pack(df).collect()
    t = tokenizer()
    want = []
    for key, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.append((key, k, at, len(part), zlib.crc32(part.tobytes())))
    order = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([tuple(r)[:5] for r in got], key=order) == sorted(want, key=order)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(w[3] for w in want)
    assert len(bins) <= max(1, 1.3 * total / 2048 + 1) or not rows
