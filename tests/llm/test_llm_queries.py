"""Registered queries: their SQL, their columns, and their guard."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from rowforge.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT / "tests"))
SMALL = "/root/testdata/sf0.001"

COLUMNS = {
    "op1": ["doc_id", "held_out", "lang_pred", "score"],
    "op2": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op4": ["page_id", "url", "text", "n_chars"],
    "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op6": ["doc_id", "size", "source_size", "target", "taken"],
    "op7": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8": ["conv_id", "turn", "call_id", "message"],
    "op9": ["vec_id", "n_links", "component_id", "kept"],
    "op11": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op12": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13": [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ],
    "op10": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    from oracle import compare, connect

    df = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)
    assert compare(df, connect(SMALL), ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_the_agreed_columns(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)


def test_every_operator_has_one_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_other_queries_do_not_need_this_subpackage(tmp_path):
    """A copy without the subpackage and the pipeline still offers everything else."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as e\n"
        "names = e.queries(); assert names and not any(n.startswith('op') and n[2].isdigit() for n in names)\n"
        "assert 'pipeline' not in names and e.oracle_sql()\n"
    )
    copy = tmp_path / "repo"
    copy.mkdir()
    (copy / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (copy / "rowforge").mkdir()
    for part in (ROOT / "rowforge").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (copy / "rowforge" / part.name).symlink_to(part)
    subprocess.run([sys.executable, "-c", code, str(copy)], check=True, timeout=120, cwd=tmp_path)
