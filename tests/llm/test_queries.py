"""Every registered query of the training-data operators: columns, rows and forms of its results."""

from __future__ import annotations

import re
import zlib

import pytest

from factloom.llm.queries import QUERIES
from tests.conftest import SMALL

LONG, INT, TEXT, FLAG = "bigint", "int", "string", "boolean"
#: Columns that a result has at least.
COLUMNS = {
    "op1_mix_sources": {"doc_id": LONG, "n_tokens": LONG, "expected": "double", "copies": LONG},
    "op2_robust_outliers": {
        "doc_id": LONG, "n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG,
        "base_failed": FLAG, "kept": FLAG,
    },
    "op3_nn_descent": {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": FLAG},
    "op4_line_dedup": {"doc_id": LONG, "n_lines": LONG, "n_dropped": LONG, "kept_sha256": TEXT},
    "op5_simhash": {"doc_id": LONG, "fingerprint": TEXT, "component_id": LONG},
    "op6_shards": {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": TEXT, "shard": INT, "slot": LONG, "grown_shard": INT},
    "op7_languages": {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": "double"},
    "op8_token_files": {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG},
    "op9_licenses": {"path": TEXT, "doc_id": LONG},
    "op10_pieces": {"doc_id": LONG},
    "op11_merkle_manifest": {
        "doc_id": LONG, "leaf": TEXT, "subroot": TEXT, "root": TEXT, "proof_sha256": TEXT, "folded_root": TEXT, "verified": FLAG,
    },
    "op12_phrase_mining": {"lang": TEXT, "rank": LONG, "phrase": TEXT, "a": LONG, "l": LONG, "r": LONG, "n": LONG, "score": LONG},
    "op13_exact_search": {"query_id": LONG, "rank": INT, "vec_id": LONG, "score": LONG},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, small_docs, name):
    result = QUERIES[name](spark, SMALL)
    kinds = dict(result.dtypes)
    assert COLUMNS[name].items() <= kinds.items()
    rows = result.collect()
    ids = {r.doc_id for r in small_docs.select("doc_id").collect()}
    if "doc_id" in kinds:
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name == "op5_simhash":
        assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id for r in rows)
        assert any(r.fingerprint[0] == "0" for r in rows)
    if name == "op7_languages":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op11_merkle_manifest":
        assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows)
