from tests.conftest import SAMPLE
from usagelens.plans.reports import item_clustering, item_statistics
from usagelens.sources.adapters import order_interactions


def test_item_statistics(spark):
    report = item_statistics(order_interactions(spark, SAMPLE))
    assert report["mean_vs_median"].count() > 0 and report["boxes"].count() == 20
    lorenz = report["lorenz"].groupBy("item").max("hours_share").collect()
    assert len(lorenz) == 5 and all(abs(r[1] - 1) < 1e-9 for r in lorenz)


def test_item_clustering(spark):
    report = item_clustering(order_interactions(spark, SAMPLE), k=3)
    items = report["features"].count()
    assert report["sweep"].count() == 9
    assert report["clusters"].count() == report["projection"].count() == items
    assert report["top_items"].groupBy("cluster").count().where("count > 5").count() == 0
    assert report["components"].count() == 6
    assert "projection" not in item_clustering(order_interactions(spark, SAMPLE), columns=("num_players", "avg_hours"))
