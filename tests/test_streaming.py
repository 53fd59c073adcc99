from foliomill.sources.views import Views
from foliomill.streaming import incremental


def test_arriving_files_give_the_batch_result(spark, tmp_path):
    v = Views(spark, "/root/testdata/sf0.001")
    u = v.un.select("page", "text")
    for k in range(2):
        u.where(f"page % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.follow(spark, f"{tmp_path}/in", v.dk, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    from foliomill.plans.catalog import QUERIES

    want = {(r["text"], r["first_page"], r["n"]) for r in QUERIES["pending_keys"](spark, "/root/testdata/sf0.001").collect()}
    assert want and {(r["text"], r["first_page"], r["n"]) for r in incremental.current_keys(spark, f"{tmp_path}/out").collect()} == want
