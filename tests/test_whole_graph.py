"""dag_validate has no SQL: its rows against the parts themselves."""

from pathlib import Path

import pytest

from siltstone import registry

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")
def test_dag_validate_places_every_part(spark):
    keys = {r[0] for r in spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey").collect()}
    nodes = {n for k in keys if k > 0 for n in (k, k // 3)}

    def layer(n):
        return 1 + layer(n // 3) if n > 0 and n in keys else 0

    assert max(keys) >= 1000
    assert {tuple(r) for r in registry.load()["dag_validate"].run(spark, FOLDER).collect()} == {(n, layer(n)) for n in nodes}
