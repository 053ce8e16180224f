import pytest
from conftest import rows

from tidemark.functions import joins as J


@pytest.fixture(scope="module")
def facts(spark):
    """One key holds nine tenths of the rows, and one tenth of the keys are NULL or unknown."""
    return spark.range(0, 20000, 1, 8).selectExpr(
        "id", "case when id % 10 < 9 then 7 when id % 100 = 9 then null else cast(id as int) end as k"
    )


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.range(10000).selectExpr("cast(id as int) as k", "concat('n', id) as name")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_key_join_equals_plain_join(facts, lookup, how):
    plain = rows(facts.join(lookup, "k", how).select("id", "k", "name"))
    assert rows(J.lookup_join(facts, lookup, ["k"], how, small=False).select("id", "k", "name")) == plain
    assert rows(J.lookup_join(facts, lookup, ["k"], how).select("id", "k", "name")) == plain


def test_hot_hashes_are_found_and_bounded(facts):
    hot = J.hot_hashes(facts, ["k"], share=0.01)
    wanted = facts.where("k = 7").selectExpr("xxhash64(k) as h").first()["h"]
    assert wanted in hot and len(hot) <= 100


def test_hot_key_is_spread(facts, lookup):
    left, _ = J.spread_hot(facts, lookup, ["k"], ["k"])
    assert left.where("k = 7").select("__salt").distinct().count() == 8


def test_size_check(lookup):
    assert J.fits_broadcast(lookup)
    assert not J.fits_broadcast(lookup, max_rows=9999)
    assert not J.fits_broadcast(lookup, max_bytes=1000)
