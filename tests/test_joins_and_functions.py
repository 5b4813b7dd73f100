"""The grid join of texts on a page, and the table functions, against plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from lectern.operators import lines, qa


def items_of(spark, boxes):
    return spark.createDataFrame([(1, 0, i, "t", b) for i, b in enumerate(boxes)], "doc_id long, page int, ord int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")


def collide(boxes):
    out = []
    for (i, a), (j, b) in itertools.combinations(enumerate(boxes), 2):
        area = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        size = lambda c: max(0.0, c[2] - c[0]) * max(0.0, c[3] - c[1])
        if area > 0.4 and area / min(max(1.0, size(a)), max(1.0, size(b))) > 0.12:
            out.append((i, j, area))
    return sorted(out)


def test_boxes_meet_in_cells_as_all_pairs_do(spark):
    rnd = random.Random(3)
    boxes = [(x, y, x + rnd.choice([0.0, 3.0, 40.0, 700.0]), y + rnd.choice([-5.0, 2.0, 10.0, 300.0])) for x, y in ((rnd.uniform(-300, 900), rnd.uniform(-90, 900)) for _ in range(220))]
    boxes += [(0.0, 0.0, 256.0, 36.0), (256.0, 36.0, 300.0, 50.0), (255.0, 35.0, 257.0, 37.0), (-1e4, -1e4, 1e4, 1e4)]
    for cells in ((256.0, 36.0), (50.0, 50.0), (7.0, 900.0)):
        got = [(r["a"], r["b"], r["area"]) for r in qa.text_collisions(items_of(spark, boxes[:-1]), *cells).collect()]
        assert sorted(got) == collide(boxes[:-1])
    assert sorted((r["a"], r["b"], r["area"]) for r in qa.text_collisions(items_of(spark, boxes[:-1][:60] + boxes[-1:])).collect()) == collide(boxes[:-1][:60] + boxes[-1:])


def test_a_dense_page_is_linear(spark):
    """50,000 lines on one page: cells hold a few lines each, and the pairs that meet are some times as many as the lines."""
    y = F.col("id") * 12.0
    page = spark.range(50_000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.col("id").cast("int").alias("ord"), F.lit("t").alias("text"), F.struct(F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 14).alias("y1")).alias("bbox"))
    dealt = qa.in_cells(page)
    per_cell = dealt.groupBy("doc_id", "page", "cx", "cy").count().agg(F.sum(F.col("count") * F.col("count")).alias("met"), F.max("count").alias("most")).first()
    assert dealt.count() < 3 * 50_000 and per_cell["most"] <= 6 and per_cell["met"] < 15 * 50_000
    assert qa.text_collisions(page).count() == 49_999


def test_table_functions(spark):
    rnd = random.Random(8)
    lines.register(spark)
    pages = {p: [(x, y, x + 30.0, y + rnd.choice([10.0, 12.0])) for x, y in ((rnd.uniform(0, 500), rnd.choice([40.0, 40.6, 58.0, 58.9])) for _ in range(rnd.choice([1, 5, 40])))] for p in range(5)}
    spark.createDataFrame([(1, p, i, *b) for p, at in pages.items() for i, b in enumerate(at)], "doc_id long, page int, ord int, x0 double, y0 double, x1 double, y1 double").repartition(3).createOrReplaceTempView("boxes_here")
    got = spark.sql("SELECT * FROM row_turns(TABLE(boxes_here) PARTITION BY (doc_id, page) ORDER BY ord)").collect()
    assert sorted((r["page"], r["ord"], r["row"], r["turn"]) for r in got) == sorted((p, i, *rt) for p, at in pages.items() for i, rt in enumerate(lines.assign_rows(at)))
    text = "\n".join(f"l{i}" for i in range(51)) + "\n"
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string").createOrReplaceTempView("texts_here")
    rows = [tuple(r) for r in spark.sql("SELECT id, page, ord, line FROM texts_here, LATERAL text_lines(text)").collect()]
    assert sorted(rows) == sorted([(1, i // 50, i % 50, f"l{i}") for i in range(51)] + [(1, 1, 1, ""), (2, 0, 0, "")])


def test_pages_that_go_on_in_the_next_batch(spark):
    rnd = random.Random(4)
    boxes = [(rnd.uniform(0, 500), 18.0 * rnd.randrange(40) + 40) for _ in range(400)]
    rows = [(d, 0, i, "w", (x, y, x + 20, y + 10), []) for d in range(3) for i, (x, y) in enumerate(boxes)]
    df = spark.createDataFrame(rows, "doc_id long, page int, ord int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, spans array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,font:string,size:double,color:int,flags:int>>")
    want = lines.assign_rows([(x, y, x + 20, y + 10) for x, y in boxes])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "150", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r["doc_id"], r["ord"]): (r["row"], r["turn"]) for r in lines.with_rows(df).collect()}
            assert got == {(d, i): w for d in range(3) for i, w in enumerate(want)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
