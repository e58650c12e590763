"""Store commits, exports as documents, repeated stream batches."""

import glob
import json

from pyspark.sql import functions as F

from plotweave.sources import export, store
from plotweave.streaming import jobs

C = F.col


def rows(spark, n=20, plans=4):
    return spark.range(n).select((C("id") % plans).alias("layout_id"), (C("id") % 3 + 1).cast("int").alias("page"), C("id").alias("row_id"), F.lit("signal").alias("cls"), (C("id") / 10).alias("conf"))


def test_rows_without_a_marker_are_not_seen(spark, tmp_path):
    p = str(tmp_path / "s")
    store.upsert_elements(rows(spark), p)
    store._append(rows(spark).withColumn("row_id", C("row_id") + 100), p, "elements")  # a write that failed before its marker
    assert store.read_elements(spark, p).count() == 20
    store.upsert_elements(rows(spark).filter("layout_id = 1").limit(2), p)
    assert store.read_elements(spark, p).groupBy("layout_id").count().filter("layout_id = 1").first()["count"] == 2
    store.delete_layout(spark, p, spark.createDataFrame([(2,)], "layout_id LONG"))
    assert {r.layout_id for r in store.read_elements(spark, p).select("layout_id").distinct().collect()} == {0, 1, 3}
    store.delete_layout(spark, p, None)
    assert store.read_elements(spark, p).count() == 0


def test_page_upsert_keeps_other_pages(spark, tmp_path):
    p = str(tmp_path / "s")
    store.upsert_elements(rows(spark), p)
    store.upsert_elements(rows(spark).filter("layout_id = 0 and page = 1").withColumn("conf", F.lit(9.0)), p, by=["layout_id", "page"])
    got = store.read_elements(spark, p)
    assert got.count() == 20 and got.filter("conf = 9.0").count() == rows(spark).filter("layout_id = 0 and page = 1").count()


def test_a_page_writes_its_own_rows_only(spark, tmp_path):
    p = str(tmp_path / "s")
    page = spark.range(50).select(F.lit(7).cast("long").alias("layout_id"), C("id").alias("row_id"), F.lit("signal").alias("cls"))
    grown = []
    for k in range(8):
        before = set(glob.glob(p + "/elements/**/*.parquet", recursive=True))
        store.upsert_elements(page.withColumn("page", F.lit(k)), p, by=["layout_id", "page"])
        new = set(glob.glob(p + "/elements/**/*.parquet", recursive=True)) - before
        grown.append(spark.read.parquet(*new).count())
    assert grown == [50] * 8
    assert store.read_elements(spark, p).groupBy("page").count().filter("count = 50").count() == 8
    # a page again, a missing page, then the whole plan, a page after it, and deletion
    store.upsert_elements(page.limit(3).withColumn("page", F.lit(2)), p, by=["layout_id", "page"])
    store.upsert_elements(page.limit(2).withColumn("page", F.lit(None).cast("int")), p, by=["layout_id", "page"])
    assert store.read_elements(spark, p).count() == 7 * 50 + 3 + 2
    store._append(page.withColumn("page", F.lit(3)), p, "elements")  # a page that failed before its marker
    assert store.read_elements(spark, p).count() == 7 * 50 + 3 + 2
    store.upsert_elements(page.limit(4).withColumn("page", F.lit(1)), p)
    assert store.read_elements(spark, p).count() == 4
    store.upsert_elements(page.limit(5).withColumn("page", F.lit(9)), p, by=["layout_id", "page"])
    assert {(r.page, r["count"]) for r in store.read_elements(spark, p).groupBy("page").count().collect()} == {(1, 4), (9, 5)}
    store.delete_layout(spark, p, page.select("layout_id").distinct())
    assert store.read_elements(spark, p).count() == 0


def _document(path):
    return json.loads("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(path + "/part-*"))))


def test_json_documents(spark, tmp_path):
    d = rows(spark).repartition(3)
    for orient in ("records", "table", "index"):
        export.write_json(d, str(tmp_path / orient), orient)
    assert len(_document(str(tmp_path / "records"))) == 20
    table = _document(str(tmp_path / "table"))
    assert table["columns"] == d.columns and [r[2] for r in table["data"]] == list(range(20))
    assert _document(str(tmp_path / "index"))["7"]["row_id"] == 7
    export.write_json_grouped(d, "layout_id", str(tmp_path / "grouped"))
    g = _document(str(tmp_path / "grouped"))
    assert sorted(g) == ["0", "1", "2", "3"] and sum(len(v) for v in g.values()) == 20


def test_json_of_plans_that_repeat_row_ids(spark, tmp_path):
    d = rows(spark).withColumn("row_id", F.floor(C("row_id") / 4))
    for orient in ("records", "table", "index"):
        export.write_json(d, str(tmp_path / orient), orient, index=["layout_id", "row_id"])
    assert len(_document(str(tmp_path / "records"))) == 20 and len(_document(str(tmp_path / "table"))["data"]) == 20
    by = _document(str(tmp_path / "index"))
    assert len(by) == 20 and all(k == f"{v['layout_id']}/{v['row_id']}" for k, v in by.items())
    export.write_json_grouped(d, "cls", str(tmp_path / "grouped"))
    assert len(_document(str(tmp_path / "grouped"))["signal"]) == 20
    export.write_json(d.limit(0), str(tmp_path / "none"))
    assert _document(str(tmp_path / "none")) == []


def test_compact_keeps_the_plan_list(spark, tmp_path):
    p, q = str(tmp_path / "s"), str(tmp_path / "t")
    store.upsert_elements(rows(spark), p)
    store.delete_layout(spark, p, spark.createDataFrame([(2,)], "layout_id LONG"))
    store.compact(spark, p, q)
    assert store.read_elements(spark, q).count() == 15
    assert {r.layout_id for r in store.list_workspaces(spark, q).collect()} == {0, 1, 3}
    store.delete_layout(spark, q, spark.createDataFrame([(3,)], "layout_id LONG"))
    assert {r.layout_id for r in store.read_elements(spark, q).select("layout_id").distinct().collect()} == {0, 1}


def test_class_json_puts_coordinates_last(spark, tmp_path):
    d = rows(spark).withColumns({"cls": F.when(C("row_id") % 2 == 0, "coordinate").otherwise("signal"), "anchor_text": F.lit('a"b'), "coord_text": F.lit(None).cast("string"),
                                 "coord_value": F.lit(1.5), "gi_gl": F.lit(None).cast("string"), "notes": F.lit(""), "fahrtrichtung": F.lit("A")})
    export.export_class_json(d, {"signal": 0.5}, str(tmp_path / "c"))
    doc = _document(str(tmp_path / "c"))
    assert list(doc) == ["signal", "coordinate"] and len(doc["coordinate"]) == 10
    assert all(r["Konfidenz"] >= 0.5 and r["Fahrtrichtung"] == "A" for r in doc["signal"])


def test_learned_state_over_several_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(4):
        spark.range(k * 3, k * 3 + 3).select(F.lit("signal").alias("cls"), C("id").cast("int").alias("offset_x"), F.lit(1).alias("offset_y"), F.lit(2).alias("width_delta"), F.lit(-3).alias("height_delta")).coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "out")
    jobs.learn_adjustments(jobs.file_stream(spark, src, files_per_batch=1), out, str(tmp_path / "ck")).awaitTermination()
    r = jobs.read_adjustments(spark, out).first()
    assert (r.n, r.offset_x, r.height_delta, r.usable) == (12, 5, -3, True)
    assert sorted(x.at_count for x in spark.read.parquet(out + "/suggestions").collect()) == [3, 5, 10]


def test_counts_passed_by_a_large_batch(spark):
    both = spark.createDataFrame([("signal", 1, 5_000_002), ("board", 7, 9), ("stop", 4, 15), ("sign", 0, 3), (None, 0, 5)], "cls STRING, was LONG, n LONG")
    got = jobs.passed_counts(both)
    small = [tuple(r) for r in got.filter("cls <> 'signal' OR cls IS NULL").collect()]
    assert len(small) == 6 and set(small) == {("stop", 5), ("stop", 10), ("stop", 15), ("sign", 3), (None, 3), (None, 5)}
    s = got.filter("cls = 'signal'").agg(F.count("*").alias("n"), F.countDistinct("at_count").alias("d"), F.min("at_count").alias("a"), F.max("at_count").alias("b")).first()
    assert tuple(s) == (1_000_001, 1_000_001, 3, 5_000_000)
