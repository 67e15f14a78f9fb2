"""Registered queries against their DuckDB SQL on the smallest tables; ALL_ORACLES=1 adds the slow ones."""

import os

import pytest
from oracle import compare

from stratalog.plans import registry

SLOW = {n for n in registry.ORACLES if n.startswith("mt_")} - {"mt_proof_path", "mt_event_shard_root"} | {"kv_rabbit_get", "kv_next_key_chain", "kv_check_consistency"}
NAMES = [n for n in registry.ORACLES if n not in SLOW or os.environ.get("ALL_ORACLES")]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, name):
    assert compare(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir) == ""


def test_entry_points_import_and_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
