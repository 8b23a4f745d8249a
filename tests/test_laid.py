"""What a score reads many times is written once, by design."""

import __spark_entry__ as entry
from bobbin.operators import stream as S
from bobbin.sources.shared import laid
from bobbin.views import view

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_laid_stitches_are_not_shuffled_by_design(spark):
    st = view(spark, SF, "v_stitches")
    got = laid(st, "design_id")
    lengths = S.segments(got).groupBy("design_id").count()
    assert "Exchange" not in plan(lengths) and got.count() == st.count() and sorted(lengths.collect()) == sorted(S.segments(st).groupBy("design_id").count().collect())


def test_the_score_reads_lineitem_no_more(spark):
    assert "lineitem.parquet" not in plan(entry.queries()["q15_parity_score"](spark, SF))
