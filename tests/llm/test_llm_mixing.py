from __future__ import annotations

import pytest

from rowforge.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def targets_by_rounds(sizes, budget, weights, repeats):
    """Shares by weight, the excess shared again until no share is too large."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        rest = budget - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: repeats * sizes[s] for s in over}


ROWS = [
    (i, ["a", "b", "c", "é", None][i % 5] if i % 3 else "a", " ".join("w" * (1 + i % 4) for _ in range(5 + (i * 37) % 90)))
    for i in range(600)
]


def test_targets_and_taken(spark):
    got = mixing.mix(docs(spark, ROWS)).collect()
    sizes = {}
    for _, s, t in ROWS:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets_by_rounds(sizes, 1.5 * sum(sizes.values()), mixing.WEIGHTS, 2)
    source = {i: s for i, s, _ in ROWS}
    assert len(got) == len(ROWS)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == len(ROWS[r["doc_id"]][2].split())
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        taken[source[r["doc_id"]]] += r["taken"]
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 95


def test_reruns_agree_however_rows_lie(spark):
    def run(df):
        return sorted((r["doc_id"], r["taken"]) for r in mixing.mix(df).collect())

    assert run(docs(spark, ROWS)) == run(docs(spark, ROWS[::-1]).repartition(7))


def test_stage_repeats_documents_as_often_as_taken(spark):
    df = docs(spark, ROWS).selectExpr("*", "1 as size", "2 as copies", "3 as row")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    found = {}
    for r in mixed.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
        assert r["text"] == ROWS[r["doc_id"]][2] and r["size"] == 1
    assert found == {k: n for k, n in copies.items() if n}


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "a", None)],
        [(1, "a", ""), (2, None, " \n")],
        [(None, None, "x y"), (None, "a", "z")],
        [(1, "a", "x y z")] * 6,
        [(1, "a", "w " * 100_000), (2, "b", "x")],
    ],
)
def test_odd_tables(spark, rows):
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert len(mixing.mixed_documents(docs(spark, rows)).collect()) == sum(r["copies"] for r in got)
