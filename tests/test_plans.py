"""What Spark plans for the queries that matter most."""

from oracle import FOLDER

from marquee.operators import features as B
from marquee.operators import retrieval as R
from marquee.plans.fixtures import Data


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark):
    text = plan(Data(spark, FOLDER).lineitem.where("l_quantity > 45").select("l_partkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in text
    assert "l_shipdate" not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(R.topk(Data(spark, FOLDER).ranked_a.drop("rank"), 3))


def test_pair_generation_has_no_nested_loop(spark):
    text = plan(B.cowatch_pairs(Data(spark, FOLDER).ratings))
    assert "NestedLoop" not in text and "Cartesian" not in text
