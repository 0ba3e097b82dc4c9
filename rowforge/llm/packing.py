"""Best-fit packing planned on a histogram of lengths.

Documents become token ids, an end id follows, and only documents longer than a sequence
are cut, into pieces of a whole sequence. The plan needs nothing but the number of pieces
of each length: at most ``capacity`` figures, whatever the number of documents. Best-fit
decreasing runs on those counts, whole groups of equal sequences at a time, and yields
slots: so many pieces of a length, from this rank on, go to these sequences at this
offset. A piece takes the slot that its rank within its length falls into.

Ranks come from counts per length and bucket, so a frequent length is never ordered in one
task.

Defined cases: a null text is an empty one, and an empty one has just the end id; equal
rows are packed separately; a null id is carried; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import durable, durable_narrow

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"

#: Fragments whose ids a Python worker keeps at a time, and the longest of them.
KEPT_WORDS = 500_000
KEPT_LENGTH = 40
#: Characters of texts that are split at a time, or one longer text; Arrow holds
#: several times as much, and every core of an executor has a worker of its own.
BATCH_CHARS = 1 << 21
#: Letters whose lower case does not hang on their neighbours; texts with others are left
#: to the tokenizer as they are, and so are texts that may hold one of its special tokens.
_PLAIN = re.compile("[^\x00-\u012f\u0131-\u017f]")
_SPECIAL = "<|"
#: Lower-case Latin letters, and the punctuation that never shares a token with a letter
#: before it.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
_WORD = re.compile(f"[{_LETTERS}]+")
_WORD_BEFORE_MARK = f"([{_LETTERS}])([!-&(-/:-@\\[-`{{-~])"

PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"

#: Buckets that the pieces of a length are dealt to, at least; and pieces per bucket.
MIN_BUCKETS = 64
BUCKET_ROWS = 500_000


class WordIds:
    """Token ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no token reaches across a space or a line break,
    nor from a word to the punctuation behind it, so the ids of a text are those of its
    fragments in order. Fragments come back often: those of a batch of texts are numbered,
    only the distinct ones are looked up, and a bounded number of them is kept, those used
    last.
    """

    def __init__(self, path: str):
        # a task has one core; threads of the tokenizer would only wait for work on others
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _encode(self, fragments: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(fragments, add_special_tokens=False)
        return {f: np.array(x.ids, "<u4").tobytes() for f, x in zip(fragments, found)}

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters: a run of them is one text, as each ends with an end."""
        out: dict[str, bytes] = {}
        runs = [words[at : at + 256] for at in range(0, len(words), 256)]
        texts = self.tokenizer.encode_batch_fast([" ".join(run) for run in runs], add_special_tokens=False)
        for run, text in zip(runs, texts):
            ids = np.array(text.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(run):
                out |= self._encode(run)
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(run, ends):
                out[word] = raw[start:end]
                start = end
        return out

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        found = {f: self.older[f] for f in missing if f in self.older}
        words, others = [], []
        for fragment in missing:
            if fragment not in found:
                (words if _WORD.fullmatch(fragment) else others).append(fragment)
        return found | self._encode_words(words) | self._encode(others)

    def of(self, texts: list[str]) -> list[bytes]:
        return list(self.each(texts))

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of one text after the other; those of a batch are held at a time."""
        batch: list[str] = []
        size = 0
        for text in texts:
            if batch and size + len(text) > BATCH_CHARS:
                yield from self._of_batch(batch)
                batch, size = [], 0
            batch.append(text)
            size += len(text)
        if batch:
            yield from self._of_batch(batch)
        # the next texts may be long in coming, and the worker keeps what its pool has grown to
        pa.default_memory_pool().release_unused()

    def _of_batch(self, texts: list[str]) -> list[bytes]:
        lower = pa.array(
            [t if _SPECIAL in t or _PLAIN.search(t) else t.lower() for t in texts], pa.large_string()
        )
        apart = pc.if_else(
            pc.match_substring(lower, _SPECIAL), lower, pc.replace_substring_regex(lower, _WORD_BEFORE_MARK, r"\1 \2")
        )
        split = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        numbered = split.values.dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.kept) > KEPT_WORDS // 2:
            self.kept, self.older = {"": b""}, self.kept
        kept = self.kept
        fresh = self._learn([w for w in words if w not in kept])
        kept.update(fresh)
        ids = pa.array([kept[w] for w in words], pa.large_binary()).take(numbered.indices)
        for w in fresh:
            if len(w) > KEPT_LENGTH:
                del kept[w]
        _, places, raw = ids.buffers()
        ends = np.frombuffer(places, np.int64)[split.offsets.to_numpy()].tolist()
        return [raw[start:end].to_pybytes() for start, end in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary lies; asked for on the worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """``piece, start, length, crc32`` of every piece."""
    step = 4 * capacity
    return [
        (i, at // 4, len(part) // 4, zlib.crc32(part))
        for i, at in enumerate(range(0, len(ids), step))
        for part in [ids[at : at + step]]
    ]


def pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    tokenizer: str | None = None, end_id: int = END_ID,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of the whole texts."""

    @F.pandas_udf(PIECES)
    def cut_texts(texts: pd.Series) -> pd.Series:
        encoder, end = _word_ids(tokenizer or tokenizer_path()), end_id.to_bytes(4, "little")
        return pd.Series([cut(ids + end, capacity) for ids in encoder.each(texts)], dtype=object)

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select(F.col("key").alias(key), F.inline(cut_texts("text")))


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on counts: ``length, first, last, sequence, per_sequence, offset``.

    Pieces of ``length`` with ranks from ``first`` up to but not including ``last`` fill
    sequences from ``sequence`` on, ``per_sequence`` in each, the first at ``offset``.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    open_groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, how many)
    rooms = 0  # bit r is set when a group with room r is open
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                first, many = open_groups[room].pop()
                if not open_groups[room]:
                    rooms &= ~(1 << room)
            else:
                room, first = capacity, sequences
                many = -(-left // (capacity // length))
                sequences += many
            per = min(room // length, left)
            filled = min(many, left // per)
            slots.append((length, rank, rank + filled * per, first, per, capacity - room))
            rank += filled * per
            left -= filled * per
            for rest, start, size in ((room - per * length, first, filled), (room, first + filled, many - filled)):
                if size and rest:
                    open_groups[rest].append((start, size))
                    rooms |= 1 << rest
    return slots


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    tokenizer: str | None = None, end_id: int = END_ID,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    spark = docs.sparkSession
    cut_pieces = durable(pieces(docs, key, text, capacity, tokenizer, end_id))
    n_buckets = max(MIN_BUCKETS, cut_pieces.count() // BUCKET_ROWS)
    dealt = cut_pieces.withColumn(
        "bucket", F.pmod(F.xxhash64(F.col(key), "piece"), F.lit(n_buckets)).cast("int")
    )
    counts = durable_narrow(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    # one row per length, so at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slot_table(spark, plan_slots(histogram, capacity))

    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead")
    )
    order = Window.partitionBy("length", "bucket").orderBy(key, "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("inside", F.row_number().over(order) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("ahead") + F.col("inside"))
    )
    place = F.col("rank") - F.col("first")
    return (
        ranked.join(
            # a few slots per length and room: bounded by the capacity alone
            F.broadcast(slots),
            (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")),
        )
        .select(
            key,
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("sequence") + F.floor(place / F.col("per_sequence"))).cast("long").alias("sequence_id"),
            (F.col("at") + place % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
        )
    )


def _slot_table(spark: SparkSession, slots: list[tuple]) -> DataFrame:
    # an Arrow table is a local relation; a list of rows would start a second set of Python workers
    names = ["slot_length", "first", "last", "sequence", "per_sequence", "at"]
    columns = np.array(slots, np.int64).reshape(len(slots), len(names)).T
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names))
