"""What queries leave in the shared folder, by rows of their input."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def stored(spark):
    return sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if p.is_file())


@pytest.mark.parametrize("name,most", [("account_generations", 100), ("reconcile_lifecycle", 400)])
def test_lives_are_written_thin(spark, name, most):
    """Bytes a line item: no checkpoint of the whole, uncompressed rows of every leg."""
    before = stored(spark)
    assert entry.queries()[name](spark, SF).count() > 0
    assert stored(spark) - before < most * spark.read.parquet(f"{SF}/lineitem.parquet").count()


@pytest.mark.parametrize("name,most", [("check_wallet_age", 16), ("linked_exposure", 30)])
def test_holdings_are_written_once_and_thin(spark, name, most):
    """Bytes a line item: the census and the tokens, compressed; 21.5 and 41.9 as checkpoints, 10.9 and 18.9 so."""
    before = stored(spark)
    assert entry.queries()[name](spark, SF).count() > 0
    assert stored(spark) - before < most * spark.read.parquet(f"{SF}/lineitem.parquet").count()
