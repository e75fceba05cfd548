import pytest

from voxlake.operators import neighbourhood as N


def lines(spark, *starts, n=3):
    return spark.createDataFrame([(z, y, x + k) for z, y, x in starts for k in range(n)], "z long, y long, x long")


@pytest.mark.parametrize("starts", [((0, 1 << 20, 5), (1, 0, 5)), ((0, 5, 1 << 20), (0, 6, 0)), ((0, (1 << 21) + 7, 0), (2, 7, 0))])
def test_components_far_apart_keep_their_own_number(spark, starts):
    df = lines(spark, *starts)
    assert sorted(r["count"] for r in N.label_components(df).groupBy("component").count().collect()) == [3, 3]
    assert N.remove_small(df, 4).count() == 0


def test_nothing_and_boxes_too_large_to_number(spark):
    assert N.label_components(lines(spark)).count() == 0
    with pytest.raises(ValueError):
        N.label_components(lines(spark, (0, 0, 0), (1 << 22, 1 << 22, 1 << 22)))
