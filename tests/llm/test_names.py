"""Columns of the user keep their values, whatever their names and case."""

import pytest

from goldweave.llm import exact_dedup, jaccard_join, language_id, pii, secret_scan, sharding
from goldweave.llm.ids import free_mark, free_name

OPERATORS = {
    "pii": lambda df: pii.pseudonymize(df, "key"),
    "language": language_id.keep_identified,
    "dedup": exact_dedup.keep_one_copy,
    "secrets": secret_scan.redact_secrets,
    "shards": lambda df: sharding.assign_shards(df, "doc_id"),
    "join": jaccard_join.keep_representatives,
}


def test_free_names():
    assert free_mark(["_A_x", "b"], "_a") == "_a__" and free_mark([], "_a") == "_a"
    assert free_name(["PII", "pii_"], "pii") == "pii__"


@pytest.mark.parametrize("name", OPERATORS)
def test_values_are_kept(shouted, name):
    got = OPERATORS[name](shouted)
    own = [c for c in shouted.columns if c not in ("text", "n_chars")]
    assert got.columns[: len(shouted.columns)] == shouted.columns
    held = {tuple(r[c] for c in own) for r in shouted.collect()}
    rows = got.collect()
    assert rows and all(tuple(r[c] for c in own) in held for r in rows)
