"""Queries that take whole inputs, on hand-made tables."""

from framelark.plans.text_queries import q_vendor


def test_vendor_named_late_in_a_page(spark, tmp_path):
    rows = [(1, "http://a", "x" * 5000 + " GoPro"), (2, "http://b", "y" * 300 + "DJI"), (3, "http://c", "z" * 300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.vendor for r in q_vendor(spark, str(tmp_path)).collect()} == {1: "gopro", 2: "dji", 3: "unknown"}
