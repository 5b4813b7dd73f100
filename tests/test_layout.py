"""The layout operators against plain Python and the expected literals."""

import json
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from lectern import cli
from lectern.functions import fonts, geometry
from lectern.functions import text as tx
from lectern.operators import catalog, fit, grids, lines, qa, quality, regions, report, segment, translate
from lectern.plans.documents import Options, inspect, translate_documents
from lectern.schemas import CACHE, LINE
from lectern.sources import pdf, sinks, visuals
from lectern.sources.tables import recognized_lines, synthetic_lines


def line(ord_, x0, y0, x1, text, y1=None, size=10.0, page=0, doc=1):
    box = (float(x0), float(y0), float(x1), float(y1 if y1 is not None else y0 + 10))
    return (doc, page, ord_, text, box, [(text, box, "F", size, 0, 0)])


def test_two_lines_make_a_title_and_one_a_heading(spark):
    t = spark.createDataFrame([line(0, 60, 90, 480, "東京の天気"), line(1, 62, 105, 470, "明日は雨です"), line(2, 70, 240, 190, "予報")], LINE)
    got = [(r["unit_id"], r["text"], tuple(r["bbox"]), r["kind"]) for r in segment.segment(t, "Japanese").orderBy("unit_ord").collect()]
    assert got == [("p1_u001", "東京の天気\n明日は雨です", (60.0, 90.0, 480.0, 115.0), "title"), ("p1_u002", "予報", (70.0, 240.0, 190.0, 250.0), "heading")]


def test_a_region_keeps_its_place_in_the_image(spark):
    r = spark.sql("SELECT named_struct('x0',20D,'y0',30D,'x1',120D,'y1',80D) i, named_struct('x0',40D,'y0',50D,'x1',160D,'y1',100D) p")
    assert tuple(r.select(geometry.page_box(F.col("i"), F.lit(200), F.lit(100), F.col("p")).alias("b")).first()["b"]) == (40.0, 55.0, 100.0, 80.0)


def test_message_content_may_be_parts(spark):
    rows = [('"plain"', "plain"), ('[{"type": "text", "text": "{\\"a\\""}, {"type": "image"}, {"type": "text", "text": ": 1}"}]', '{"a": 1}'), ("null", ""), (None, "")]
    t = spark.createDataFrame(rows, "c string, e string")
    assert all(r["e"] == r["g"] for r in t.select("e", tx.message_text(F.col("c")).alias("g")).collect())


class Forgetful:
    """Answers only the first id of a request, but not the first time."""

    def __init__(self, keep=1):
        self.calls, self.keep = [], keep

    def translate(self, units):
        self.calls.append([u["id"] for u in units])
        return "```json\n" + json.dumps({"translations": [{"id": f"`{u['id']}`", "translation": u["text"].upper()} for u in units[: self.keep]] + [{"id": "other", "translation": "x"}]}) + "\n```"


@pytest.mark.parametrize("n", [1, 3, 4, 9, 16])
def test_left_out_ids_are_asked_again(n):
    backend = Forgetful()
    units = [{"id": f"u{i}", "kind": "label", "text": f"t{i}"} for i in range(n)]
    assert translate.translate_units(backend, units) == {f"u{i}": f"T{i}" for i in range(n)}
    assert len(backend.calls[0]) == n and (n == 1 or len(backend.calls) >= 2)


def test_a_mute_backend_is_an_error_and_waits_grow():
    with pytest.raises(RuntimeError):
        translate.translate_units(Forgetful(0), [{"id": "a", "kind": "label", "text": "t"}])

    class Busy:
        def translate(self, units):
            raise translate.ServiceError(503)

    waits = []
    with pytest.raises(translate.ServiceError):
        translate.call(Busy(), [], sleep=waits.append)
    assert waits == [1, 2, 4, 8, 16]


def counting(folder, bad=""):
    """A backend that echoes, notes how often each text is asked for (in a folder, as workers are other processes), and fails for some."""

    class Counting:
        def translate(self, units):
            for u in units:
                with open(f"{folder}/{u['id']}", "a") as f:
                    f.write(u["text"] + "\n")
                if bad and bad in u["text"]:
                    raise ValueError("cannot be said")
            return json.dumps({"translations": [{"id": u["id"], "translation": "T " + u["text"]} for u in units]})

    return Counting()


PARAGRAPH = "Long enough lines of text stand here to be a paragraph of the page, all of them.\n"


def test_a_run_asks_once_and_keeps_what_it_paid_for(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"A heading {i % 4}\n" + PARAGRAPH * 6) for i in range(8)], "doc_id long, text string").repartition(3)
    (tmp_path / "asked").mkdir()
    run = lambda cache: translate_documents(synthetic_lines(docs), counting(str(tmp_path / "asked")), Options("English", "German"), cache=cache, cache_root=f"{tmp_path}/cache").collect()
    out = run(None)
    assert len(out) == 8 and all(r["validation_pass"] for r in out)
    asked = {f: open(f"{tmp_path}/asked/{f}").read() for f in os.listdir(tmp_path / "asked")}
    texts = {u["source"] for r in out for p in r["pages"] for u in p["units"]}
    assert len(asked) == len(texts)
    cache = sinks.latest_cache(spark, f"{tmp_path}/cache")
    assert cache.count() == len(texts)
    assert sorted(map(str, run(cache))) == sorted(map(str, out))
    assert {f: open(f"{tmp_path}/asked/{f}").read() for f in os.listdir(tmp_path / "asked")} == asked  # nothing was asked again
    assert sinks.latest_cache(spark, f"{tmp_path}/none") is None


def test_a_failing_backend_leaves_error_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A heading\n" + PARAGRAPH * 6), (2, "Another bad heading\n" + PARAGRAPH * 3)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in translate_documents(synthetic_lines(docs), counting(str(tmp_path), "bad"), Options("English", "German")).collect()}
    assert out[1]["validation_pass"] and not out[2]["validation_pass"] and out[2]["warnings"] > 0
    errors = [u["error"] for p in out[2]["pages"] for u in p["units"] if u["translation"] is None]
    assert errors and all("cannot be said" in e for e in errors)
    assert [r["line"] for r in report.summary(spark.createDataFrame([(r["doc_id"], [([(u["id"],) for u in p["units"]],) for p in r["pages"]], r["warnings"], r["validation_pass"]) for r in out.values()], _schema())).collect()][1].endswith("checks failed")
    with pytest.raises(ValueError):
        translate_documents(synthetic_lines(docs.filter("doc_id = 7")), counting(str(tmp_path)), Options("English", "German"))


def _schema():
    return "doc_id long, pages array<struct<units:array<struct<id:string>>>>, warnings long, validation_pass boolean"


REPLIES = [
    '{"translations": [{"id": "c" "translation": "C"} {"id": "d", "translation": "D"}]}',
    '{"translations": [{"id": "a", "translation": "x } { y \\" ] [ z"} {"id": "b" "translation": "1 \\"k\\": 2"}]}',
    '```json\n{"translations": [{"id": "a", "translation": "A"}]}\n```',
    'Here: {"translations": [{"unit_id": " `b` ", "translated_text": " B "}]} Done.',
    '{"n": 1 "translations": [{"id": "e", "translation": "1"}, {"id": "e", "translation": "2"}, {"id": "", "translation": "x"}]}',
    '{"translations": []}', "no reply", "", '{"translations": [{"id": "a" "translation"',
]


def test_one_reader_of_replies(spark):
    t = spark.createDataFrame([(i, 0, r) for i, r in enumerate(REPLIES)], "doc_id int, batch int, reply string")
    got = {}
    for r in translate.parse_translations(t).collect():
        got.setdefault(r["doc_id"], {})[r["unit_id"]] = r["translation"]
    assert got == {i: x for i, r in enumerate(REPLIES) if (x := translate.read_reply(r))}
    assert got[0] == {"c": "C", "d": "D"} and got[1] == {"a": 'x } { y " ] [ z', "b": '1 "k": 2'}
    errors = t.select("doc_id", tx.parse_error(F.col("reply"), "translations array<struct<id:string>>").alias("e")).collect()
    assert {r["doc_id"] for r in errors if r["e"]} == {6, 7, 8} and errors[6]["e"].endswith("no reply")


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text('{}[],: "\\\\ab', max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab}{", max_size=3), x, max_size=3), max_leaves=12))
def test_repair_puts_back_every_comma(value):
    text = json.dumps(value, indent=1)
    assert json.loads(tx.repaired(text)) == value
    without = re.sub(r"(?m),$", "", text)  # commas between values stand at line ends
    assert json.loads(tx.repaired(without)) == value


def merged_by_hand(boxes):
    rows, out = [], {}
    for i in sorted(range(len(boxes)), key=lambda i: (round(boxes[i][1], 1), boxes[i][0])):
        b = boxes[i]
        for k in list(range(len(rows)))[-8:][::-1]:
            r = rows[k]
            if abs((b[1] + b[3]) / 2 - (r[1] + r[3]) / 2) <= 1.2 and abs(b[3] - b[1] - r[3] + r[1]) <= 1.5:
                rows[k] = (min(r[0], b[0]), min(r[1], b[1]), max(r[2], b[2]), max(r[3], b[3]))
                out[i] = k
                break
        else:
            out[i] = len(rows)
            rows.append(b)
    return [out[i] for i in range(len(boxes))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 50), st.floats(0, 40)), max_size=25))
def test_row_merge_is_the_fold(corners):
    boxes = [(x, y, x + 5, y + 10) for x, y in corners]
    assert [r for r, _ in lines.assign_rows(boxes)] == merged_by_hand(boxes)


def test_merged_rows_in_a_table(spark):
    t = spark.createDataFrame([line(0, 100, 10, 150, "world"), line(1, 50, 10.4, 90, "hello"), line(2, 50, 40, 90, "日"), line(3, 100, 40, 140, "本")], LINE)
    got = [(r["ord"], r["text"], len(r["spans"])) for r in lines.merge_rows(t).orderBy("ord").collect()]
    assert got == [(0, "hello world", 2), (1, "日本", 2)]


def clustered(values, tolerance=1.5):
    out = []
    for v in sorted(values):
        if out and abs(v - out[-1]) <= tolerance:
            out[-1] = (out[-1] + v) / 2
        else:
            out.append(v)
    return out


def test_cluster_is_the_fold(spark):
    import random

    rnd = random.Random(0)
    cases = [[100.0, 101.2, 102.4, 110.0, 111.5, 111.6], [], [5.0]] + [[rnd.uniform(0, 30) for _ in range(rnd.randrange(20))] for _ in range(60)]
    t = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v array<double>")
    for r in t.select("i", geometry.cluster(F.col("v")).alias("c")).collect():
        assert r["c"] == clustered(cases[r["i"]])
    assert clustered(cases[0]) == [100.6, 102.4, 111.175]


def test_cells_of_a_table(spark):
    rules = [(1, 0, i, (50.0, y, 450.0, y + 0.5)) for i, y in enumerate((100.0, 130.0, 160.0))] + [(1, 0, 9 + i, (x, 98.0, x + 0.5, 165.0)) for i, x in enumerate((50.0, 200.0, 449.0))]
    r = spark.createDataFrame(rules, "doc_id long, page int, ord int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    g = grids.detect_grids(r)
    assert [(x["top"], x["bottom"], x["xs"]) for x in g.orderBy("grid_ord").collect()] == [(100.0, 130.0, [50.0, 200.0, 449.0]), (130.0, 160.0, [50.0, 200.0, 449.0])]
    box = (60.0, 110.0, 260.0, 120.0)
    crossing = (1, 0, 0, "left part right", box, [("left part right", box, "F", 10.0, 0, 0)])
    t = spark.createDataFrame([crossing, line(1, 210, 140, 300, "alone"), line(2, 60, 300, 300, "below")], LINE)
    units = [(u["unit_id"], u["text"], u["kind"]) for u in segment.segment(t, "English", g).orderBy("unit_ord").collect()]
    assert units == [("p1_t001", "left part", "table_cell"), ("p1_t002", "right", "table_cell"), ("p1_t003", "alone", "table_cell"), ("p1_u004", "below", "title")]
    near = (150.0, 110.0, 249.8, 120.0)  # its middle is within a point of the border: it stands in both columns
    t = spark.createDataFrame([(1, 0, 0, "x", near, [("x", near, "F", 10.0, 0, 0)])], LINE)
    assert segment.segment(t, "English", g).count() == 2
    own = grids.table_borders(r, g)
    assert own.count() == 6


def test_strip_and_scripts(spark):
    blanks = [" a ", "　全　", "\x1cx\x1f", "\t\n", "", "a ", "\x85b"]
    t = spark.createDataFrame([(b,) for b in blanks], "t string")
    assert [r[0] for r in t.select(tx.strip(F.col("t"))).collect()] == [b.strip() for b in blanks]
    samples = {"Japanese": "かな", "Chinese": "漢", "Korean": "한", "Arabic": "ع", "Russian": "д", "Ukrainian": "ї", "Thai": "ก", "Hindi": "ह", "Tamil": "த", "Telugu": "త", "Malayalam": "മ", "Kannada": "ಕ", "Polish": "a"}
    for language, sample in samples.items():
        row = spark.createDataFrame([(sample, "12 .", None)], "a string, b string, c string")
        got = row.select(*[tx.is_source_text(F.col(c), language).alias(c) for c in "abc"]).first()
        assert (got["a"], got["b"], got["c"]) == (True, False, None), language


def test_fit(spark):
    assert fonts.measure("Hi", 10) == pytest.approx(9.44)
    assert fit.wrap("aa bb cc", fonts.measure("aa bb", 10), 10) == ["aa bb", "cc"]
    assert fit.wrap("mmmm", fonts.measure("mm", 10), 10) == ["mm", "mm"]
    size, out, warning = fit.fit_block("one two three four", 40, 14, 1, 10, 0.6)
    assert warning and len(out) == 1 and size == pytest.approx(6.0)
    size, out, warning = fit.fit_block("short", 200, 20, 1, 10, 0.9)
    assert (size, out, warning) == (10, ["short"], None)
    assert fit.fit_cell("a long text for a cell", 30, 12, 10, 0.9)[2]
    w = spark.createDataFrame([("Hi é",)], "t string").select(fonts.text_width(F.col("t"), F.lit(10.0))).first()[0]
    assert w == pytest.approx(fonts.measure("Hi é", 10))


def test_routes(spark):
    p = spark.createDataFrame([(1, 0, 600.0, 800.0, 480_000.0), (1, 1, 600.0, 800.0, 0.0), (1, 2, 600.0, 800.0, 0.0)], "doc_id long, page int, width double, height double, image_area double")
    t = spark.createDataFrame([line(0, 50, 50, 400, "enough text to be read, surely"), line(0, 50, 50, 90, "few", page=2)], LINE)
    q = quality.page_quality(t, p)
    mode = lambda **k: {r["page"]: r["mode"] for r in quality.route(q, **k).collect()}
    assert mode() == {0: "native", 1: "error", 2: "native-fallback"}
    assert mode(ocr=True, can_edit=True) == {0: "full-page", 1: "ocr", 2: "ocr"}
    assert mode(mode="native") == {0: "native", 1: "error", 2: "native"}
    assert {r["page"]: r["duplicate_ratio"] for r in q.collect()}[1] == 1.0


def test_a_whole_run(spark):
    docs = spark.createDataFrame([(1, "A heading\n" + "Long enough lines of text stand here to be a paragraph of the page, all of them.\n" * 12), (2, "")], "doc_id long, text string")
    t = synthetic_lines(docs)
    cache = spark.createDataFrame([], CACHE)
    out = translate_documents(t, translate.EchoBackend("de"), Options("English", "German"), cache=cache).collect()
    assert len(out) == 1 and out[0]["doc_id"] == 1 and all(u["translation"].startswith("[de] ") for p in out[0]["pages"] for u in p["units"])
    seen = inspect(t, Options("English", "German")).collect()
    assert {r["doc_id"] for r in seen} == {1, 2}
    with pytest.raises(ValueError):
        Options("English", "English").check()
    assert not pdf.available() and pytest.raises(RuntimeError, pdf.read_pages, spark, "/tmp")


def test_cache_versions(spark, tmp_path):
    old = spark.createDataFrame([("k", "s", "a", "b", "m", "old"), ("q", "s", "a", "b", "m", "kept")], CACHE)
    new = spark.createDataFrame([("k", "s", "a", "b", "m", "1", 1), ("k", "s", "a", "b", "m", "2", 2)], "cache_key string, source_text string, source_language string, target_language string, model string, translation string, ord int")
    path = sinks.write_cache(spark, sinks.upsert(old, new), str(tmp_path))
    assert sorted((r["cache_key"], r["translation"]) for r in spark.read.parquet(path).collect()) == [("k", "2"), ("q", "kept")]


def test_streams(spark, tmp_path):
    from lectern.streaming import pages

    spark.createDataFrame([(1, "a text of one page", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in")
    pages.route_stream(pages.read_documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_visuals(spark):
    page = {
        "images": [{"xref": 4, "ext": "PNG", "width": 10, "height": 20, "data": "AAEC", "rects": [[0, 0, 10, 10], [50, 50, 60, 70]]}, {"xref": 4, "rects": [[1, 1, 2, 2]]}, {"xref": 5, "rects": []}],
        "drawings": [{"rect": [1, 2, 3, 4]}, {"rect": None}, {"rect": [5, 6, 7, 8]}],
    }
    pages = spark.createDataFrame([(1, 0, 100.0, 100.0, json.dumps(page)), (2, 0, 100.0, 100.0, None), (3, 0, 100.0, 100.0, "{}")], "doc_id long, page int, width double, height double, visuals string")
    at = visuals.placements(pages)
    assert sorted((r["xref"], r["occ"], tuple(r["rect"])) for r in at.collect()) == [(4, 0, (0.0, 0.0, 10.0, 10.0)), (4, 1, (50.0, 50.0, 60.0, 70.0))]
    assert [(r["xref"], bytes(r["bytes"]), r["image_h"]) for r in visuals.images(pages).collect()] == [(4, b"\x00\x01\x02", 20)]
    assert [(r["ord"], tuple(r["bbox"])) for r in visuals.drawings(pages).orderBy("ord").collect()] == [(0, (1.0, 2.0, 3.0, 4.0)), (2, (5.0, 6.0, 7.0, 8.0))]
    assert {r["doc_id"]: r["image_area"] for r in visuals.page_areas(pages).collect()} == {1: 300.0, 2: 0.0, 3: 0.0}
    assert visuals.images(pages).select(visuals.data_url(F.col("bytes"), F.col("ext"))).first()[0] == "data:image/png;base64,AAEC"
    found = spark.createDataFrame([(1, 0, 4, occ, f"r{i}", None, "t") for i, occ in enumerate((1, 1, 2))], "doc_id long, page int, xref int, occ int, region_id string, bbox_px struct<x0:double>, translation string")
    groups = regions.by_placement(found, at).collect()  # the place with number 2 is not there
    assert [(g["occ"], [r["region_id"] for r in g["regions"]]) for g in groups] == [(1, ["r0", "r1"])]


def test_recognition_payloads(spark):
    inner = {"rec_texts": ["a", "b", "c"], "rec_boxes": [[0, 0, 20, 10], [[0, 30], [20, 30], [20, 40], [0, 40]], ["x"]]}
    replies = [json.dumps({"result": {"ocrResults": [{"prunedResult": inner}]}}), json.dumps({"rec_texts": ["p"], "rec_polys": [[[0, 0], [9, 0], [9, 9], [0, 9]]]}), "[]", "broken", None]
    t = spark.createDataFrame(list(enumerate(replies)), "doc_id long, reply string").withColumn("page", F.lit(0))
    got = {r["doc_id"]: (r["texts"], r["boxes"]) for r in visuals.recognition_payloads(t).collect()}
    assert got == {0: (["a", "b"], [[[0.0, 0.0], [20.0, 10.0]], [[0.0, 30.0], [20.0, 30.0], [20.0, 40.0], [0.0, 40.0]]]), 1: (["p"], [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]])}
    lines_ = recognized_lines(visuals.recognition_payloads(t), 2.0)
    assert [(r["doc_id"], r["text"], r["bbox"]["y1"]) for r in lines_.orderBy("doc_id", "ord").collect()] == [(0, "a", 5.0), (0, "b", 20.0), (1, "p", 4.5)]
    assert set(visuals.engines()) == {"paddlex", "tesseract"}


def test_text_in_a_box_of_an_image():
    text = "two words"
    size, out, cut = fit.fit_pixels(text, 180, 60)
    assert not cut and " ".join(out) == text
    for s in range(size + 1, int(56 * 0.78) + 1):  # no larger size would do
        n = len(fit.fill([(w, fonts.advance(w)) for w in text.split()], 176 * 1000 / s))
        line = round((fonts.ASCENDER - fonts.DESCENDER) * s)
        assert n * line + (n - 1) * max(1, int(line * 0.08)) > 56
    assert fit.fit_pixels("mmmm", 10, 10)[2] and "".join(fit.fit_pixels("日本語の文", 300, 30)[1]) == "日本語の文"


def test_cut_text():
    assert grids.cut_text("left part right", 60.0, 260.0, [200.0]) == [("left part", 60.0, 180.0), (" right", 180.0, 260.0)]
    assert grids.cut_text("abcd", 0.0, 4.0, [1.0, 3.0]) == [("a", 0.0, 1.0), ("bc", 1.0, 3.0), ("d", 3.0, 4.0)]
    assert grids.cut_text("x", 0.0, 4.0, [1.0]) == [("x", 0.0, 4.0)]


def test_command_line(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(1, "A heading\n" + PARAGRAPH * 6)], "doc_id long, text string")
    synthetic_lines(docs).write.parquet(f"{tmp_path}/lines")
    cli.main(["inspect", f"{tmp_path}/lines", "--report", f"{tmp_path}/seen", "--source", "English"], spark=spark)
    assert spark.read.json(f"{tmp_path}/seen").first()["doc_id"] == 1
    for _ in range(2):
        cli.main(["translate", f"{tmp_path}/lines", "--report", f"{tmp_path}/out", "--source", "English", "--target", "German", "--model", "m", "--cache", f"{tmp_path}/c"], spark=spark)
    assert "document 1: 1 pages" in capsys.readouterr().out and len(os.listdir(tmp_path / "c")) == 2


def test_catalog_payload(spark):
    data = {"data": [{"id": "m/a", "name": "A", "architecture": {"input_modalities": ["text", "image"], "output_modalities": ["text"]}}, {"id": "m/b"}]}
    found = catalog.chat_models(catalog.read_catalog(spark.createDataFrame([(json.dumps(data),), ("broken",)], "value string")))
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(1, "m/a", True), (2, "m/b", False)]


def test_cache_deltas(spark, tmp_path):
    from lectern.streaming import pages

    for i, text in enumerate(("old", "new")):
        spark.createDataFrame([("k", "s", "a", "b", "m", text)], CACHE).write.mode("append").parquet(f"{tmp_path}/in")
        pages.upsert_stream(spark.readStream.schema(CACHE).parquet(f"{tmp_path}/in"), f"{tmp_path}/cache", f"{tmp_path}/cp").awaitTermination()
    before = spark.createDataFrame([("k", "s", "a", "b", "m", "first"), ("q", "s", "a", "b", "m", "kept")], CACHE)
    assert sorted((r["cache_key"], r["translation"]) for r in pages.compact(spark, f"{tmp_path}/cache", before).collect()) == [("k", "new"), ("q", "kept")]


def test_counts_and_checks(spark):
    t = spark.createDataFrame([line(0, 50, 50, 400, "one"), line(1, 60, 55, 300, "two"), line(2, 50, 200, 90, "three")], LINE)
    items = qa.rendered(t)
    assert [(r["a"], r["b"]) for r in qa.text_collisions(items).collect()] == [(0, 1)]
    v = qa.page_verdicts(items, qa.text_collisions(items), items.limit(0).select("doc_id", "page"), items.limit(0).select("doc_id", "page"))
    assert v.first()["pass"] is False
    assert report.component_counts(t.select("doc_id", "page").distinct(), lines=t).first()["lines"] == 3
    assert qa.uncovered(t, t.limit(0)).count() == 3
    colors = spark.createDataFrame([("r", 1, 2, 3), ("r", 9, 2, 5), ("r", 4, 8, 4), ("r", 5, 1, 9)], "region_id string, r int, g int, b int")
    assert tuple(regions.border_color(colors).first()) == ("r", 5, 2, 5)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 30
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    for name in ("page_quality_score", "paragraph_units", "missing_ids", "uncovered_lines"):
        a, b = found[name](spark, SF).toPandas(), con.sql(sql[name]).df()
        key = sorted(b.columns)
        assert sorted(map(repr, a[key].values.tolist())) == sorted(map(repr, b[key].values.tolist())), name
