"""Language identification by nearest centroid.

A text is a vector of character n-grams (runs of 1 to 3 letters or gaps), hashed to a fixed
number of places, weighted by damped frequency times inverse document frequency, and of
length 1. Each language has several centroids, the means of clusters of its training texts.
The language of the closest centroid by cosine wins, and the text is rejected when it lies
too far from that centroid: beyond the distance that covers nearly all training texts of
that language by more than ``REACH`` of the way to having nothing in common.

Training reads a bounded sample, ``SAMPLE`` documents of each language in the order of a
hash of their ids, one for each id; every language is clustered in a task of its own.
Prediction reads whole texts of all documents and holds only the centroids: languages x
clusters x places.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected, as
is every text when nothing was learned; a null id is never held out; equal rows are judged
each for itself; other columns are carried unread; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Documents of a language that training reads, at most.
SAMPLE = 240
CLUSTERS = 4
PLACES = 1 << 13
#: Share of the way from the language's own distance to 1, beyond which a text is rejected.
REACH = 0.6
#: Share of the training texts of a language that define its distance.
COVER = 0.99

UNDETERMINED = "und"
GAP = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of every code point of the basic plane, a gap for all others."""
    table = np.full(0x10000, GAP, np.uint32)
    for code in range(0x10000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(text: str | None, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the n-grams of a text; none when it has no letter."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = codes >= 0x10000
    mapped = _letters()[np.where(wide, GAP, codes)]
    if wide.any():
        odd, where = np.unique(codes[wide], return_inverse=True)
        alpha = np.array([c if chr(c).isalpha() else GAP for c in odd.tolist()], np.uint32)
        mapped[wide] = alpha[where]
    letter = mapped != GAP
    if not letter.any():
        return none
    # one gap between words, one before and one after the text
    first_gap = ~letter
    first_gap[1:] &= letter[:-1]
    inner = mapped[letter | first_gap]
    inner = inner[int(inner[0] == GAP) : len(inner) - int(inner[-1] == GAP)]
    kept = np.concatenate([[GAP], inner, [GAP]]).astype(np.uint64)
    found = []
    total = np.zeros(len(kept), np.uint64)
    for n in (1, 2, 3):
        if len(kept) < n:
            break
        total = total[: len(kept) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + kept[n - 1 :]
        mixed = (total + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        found.append((mixed >> np.uint64(40)) & np.uint64(places - 1))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=places)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _vectors(all_grams: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(all_grams), len(idf)), np.float32)
    for row, (at, n) in zip(out, all_grams):
        if len(at):
            weights = (1 + np.log(n)) * idf[at]
            row[at] = weights / np.sqrt((weights * weights).sum())
    return out


def cluster(x: np.ndarray, clusters: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length 1 and the cluster of every row.

    Starts from the rows farthest from those chosen before, so it needs no luck.
    """
    centre = x.mean(axis=0)
    chosen = [int(np.argmax(x @ centre))]
    while len(chosen) < min(clusters, len(x)):
        closest = (x @ x[chosen].T).max(axis=1)
        # the middle of the far half: an odd text alone is no cluster
        far = np.argsort(closest, kind="stable")
        chosen.append(int(far[len(far) // 4]))
    means = x[chosen]
    label = np.full(len(x), -1)
    for _ in range(rounds):
        new = (x @ means.T).argmax(axis=1)
        if (new == label).all():
            break
        label = new
        means = np.stack([x[label == k].sum(axis=0) if (label == k).any() else means[k] for k in range(len(means))])
        means /= np.linalg.norm(means, axis=1, keepdims=True)
    return means, label


@dataclass(frozen=True)
class Centroids:
    """What prediction needs: a language, a centroid and its radius per cluster."""

    languages: list[str]
    means: np.ndarray
    radii: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        found = [grams(text, len(self.idf)) for text in texts]
        lang = [UNDETERMINED] * len(texts)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = [i for i, (at, _) in enumerate(found) if len(at)]
        if rows and self.languages:
            cosine = _vectors([found[i] for i in rows], self.idf) @ self.means.T
            best = cosine.argmax(axis=1)
            for i, k, c in zip(rows, best.tolist(), cosine[np.arange(len(rows)), best].tolist()):
                lang[i] = self.languages[k]
                score[i] = min(1.0, max(0.0, c))
                rejected[i] = 1 - c > self.radii[k]
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether a row is kept from training, by a checksum of its id."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    sample: int = SAMPLE, clusters: int = CLUSTERS, places: int = PLACES,
    reach: float = REACH, cover: float = COVER,
) -> Centroids:
    """Centroids from a bounded sample of the documents with a language."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    ).withColumn("turn", F.xxhash64("id"))
    # one row per language; rows that share an id are drawn as one
    ids = known.groupBy("lang").agg(F.approx_count_distinct("turn").alias("n"))
    counts = {r["lang"]: r["n"] for r in ids.collect()}
    if not counts:
        return Centroids([], np.zeros((0, places)), np.zeros(0), np.zeros(places))
    every = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, n // sample))])
    drawn = known.where(F.pmod(F.col("turn"), F.element_at(every, F.col("lang"))) == 0)
    first = F.min(F.struct("id", "text")).alias("d")
    drawn = drawn.groupBy("lang", "turn").agg(first).select("lang", "turn", "d.id", "d.text")

    @F.pandas_udf("struct<places:array<int>,numbers:array<int>>")
    def count_grams(texts: pd.Series) -> pd.DataFrame:
        found = [grams(t, places) for t in texts]
        return pd.DataFrame({"places": [f[0].astype(np.int32) for f in found], "numbers": [f[1].astype(np.int32) for f in found]})

    order = Window.partitionBy("lang").orderBy("turn", "id")
    counted = (
        drawn.select("lang", "turn", "id", count_grams("text").alias("g"))
        .withColumn("n", F.row_number().over(order))
        .where((F.col("n") <= sample) & (F.size("g.places") > 0))
        .select("lang", "n", "g.places", "g.numbers")
    )
    counted = counted.persist()
    try:
        n_docs = counted.count()
        # one row per place at most
        df = counted.select(F.explode("places").alias("p")).groupBy("p").count().collect()
        idf = np.full(places, np.log(1.0 + n_docs), np.float64)
        for p, n in df:
            idf[p] = np.log((1.0 + n_docs) / n)

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("n")
            x = _vectors(list(zip(rows["places"], rows["numbers"])), idf)
            means, label = cluster(x, clusters)
            away = 1 - (x * means[label]).sum(axis=1)
            return pd.DataFrame(
                {"lang": rows["lang"].iloc[0], "cluster": range(len(means)),
                 "mean": [m.astype("<f4").tobytes() for m in means], "radius": float(np.quantile(away, cover))}
            )

        fitted = counted.groupBy("lang").applyInPandas(fit, "lang string, cluster int, mean binary, radius double")
        rows = sorted(fitted.collect(), key=lambda r: (r["lang"], r["cluster"]))
    finally:
        counted.unpersist()
    return Centroids(
        [r["lang"] for r in rows],
        np.stack([np.frombuffer(r["mean"], "<f4") for r in rows]) if rows else np.zeros((0, places), np.float32),
        np.array([r["radius"] + reach * (1 - r["radius"]) for r in rows]),
        idf,
    )


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """``row`` (the document as it came) and ``l``: ``lang_pred``, ``score``, ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        parts = [shared.value.predict(list(texts[at : at + 128])) for at in range(0, len(texts), 128)]
        return pd.concat(parts, ignore_index=True) if parts else shared.value.predict([])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.select("row", predict(F.col("row")[text]).alias("l"))


def drop_rejected(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """The documents whose language is close to a learned one, with their columns."""
    return identify(docs, model, text).where(~F.col("l.rejected")).select("row.*")
