"""The unscaled features come from a clustering that is already there."""

from tessellate.plans.similar_orders import META, with_raw_features
from tessellate.plans.tables import ORDER_FEATURES, ORDER_ID


def test_raw_features_of_a_given_clustering(spark):
    row = {ORDER_ID: 7, "cluster": 2, **dict.fromkeys(META, "m"), **dict.fromkeys(ORDER_FEATURES, 0.0),
           **{f"raw_{f}": float(i) for i, f in enumerate(ORDER_FEATURES)}}
    (got,) = with_raw_features(spark.createDataFrame([row])).collect()
    assert got["cluster"] == 2 and [got[f] for f in ORDER_FEATURES] == [0.0, 1.0, 2.0, 3.0, 4.0]
