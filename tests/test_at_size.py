"""Work that has to follow what there is to do, not the square of it."""

import os

from lectern import queries
from lectern.functions import fonts
from lectern.operators import fit, grids, report, translate
from lectern.plans.documents import Options, translate_documents
from lectern.sources import scratch
from lectern.sources.tables import synthetic_lines


def test_a_cell_with_far_too_much_text_is_measured_once(monkeypatch):
    class Counting(dict):
        asked = 0

        def get(self, *key):
            Counting.asked += 1
            return super().get(*key)

    monkeypatch.setattr(fonts, "_WIDTHS", Counting(fonts._WIDTHS))
    text = " ".join(f"word{i % 97}é" for i in range(5000))
    size, out, warning = fit.fit_cell(text, 100.0, 40.0, 10.0, 0.9)
    assert (out, bool(warning)) == ([text], True) and abs(size - 4.7) < 1e-6
    assert Counting.asked <= 2 * len(text)
    assert fonts.advance(text) == sum(fonts._WIDTHS.get(c, fonts.DEFAULT) for c in text)


def test_the_nearest_blank_is_looked_for_from_the_cut():
    class Text(str):
        seen = 0

        def __getitem__(self, i):
            if isinstance(i, int):
                Text.seen += 1
            return str.__getitem__(self, i)

    text = Text("ab cd " * 5000)
    assert [t for t, _, _ in grids.cut_text(text, 0.0, 300.0, [100.0])] == [str(text)[:10001], str(text)[10001:]]
    assert Text.seen < 50


def test_cells_read_the_lines_for_the_rules_and_for_the_texts(spark, tmp_path, capsys):
    text = "\n".join(f"left part {i} right part of a line that is long enough to reach beyond" for i in range(60))
    spark.createDataFrame([(1, text, "en"), (2, "short\n\nlines", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.cell_fit(spark, str(tmp_path))
    df.explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 2
    assert df.count() > 60


def test_a_run_keeps_only_the_tables_that_its_report_is_read_from(spark, capsys):
    docs = spark.createDataFrame([(i, "A heading\n" + "Long enough lines of text stand here to be a paragraph of the page, all of them.\n" * (20 * i)) for i in range(1, 5)], "doc_id long, text string")
    root = scratch.shared_root(spark).removeprefix("file://")
    there = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()
    before, kept_as = there(), spark.conf.get(scratch.DONE_WITH)
    out = translate_documents(synthetic_lines(docs), translate.EchoBackend("de"), Options("English", "German"))
    assert sorted(x.split("-")[0] for x in there() - before) == ["kept", "placed", "verdicts"]
    assert spark.conf.get(scratch.DONE_WITH) == kept_as
    out.explain()
    assert capsys.readouterr().out.count("Exchange") == 1  # units and lines are dealt out by document, once
    assert [r["validation_pass"] for r in out.orderBy("doc_id").collect()] == [True] * 4


def test_pages_of_a_report(spark):
    unit = "doc_id long, page int, unit_ord int, unit_id string, kind string, text string, translation string, bbox struct<x0:double,y0:double,x1:double,y1:double>, n_lines int, size double, final_size double, warning string, error string"
    units = spark.createDataFrame([(1, 0, 1, "a", "label", "t", "T", (0.0, 0.0, 1.0, 1.0), 1, 10.0, 9.0, None, None), (1, 1, 1, "b", "label", "u", None, (0.0, 0.0, 1.0, 1.0), 1, 10.0, None, None, "lost")], unit)
    verdicts = spark.createDataFrame([(1, 0, 1, 0, 0, 0, True, False)], "doc_id long, page int, text_count long, text_text long, text_drawing long, outside long, pass boolean, skipped boolean")
    kept = spark.createDataFrame([(1, 0, 5, "k", (0.0, 0.0, 1.0, 1.0), 9.5), (1, 7, 5, "on no page", (0.0, 0.0, 1.0, 1.0), 9.5)], "doc_id long, page int, ord int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, final_size double")
    every = spark.createDataFrame([(1, 0), (1, 2), (2, 0)], "doc_id long, page int")
    got = {r["doc_id"]: r for r in report.render_report(units, verdicts, kept, every).collect()}
    assert [(p["page"], p["units"] and len(p["units"]), p["validation"] and p["validation"]["pass"], p["kept_lines"] and len(p["kept_lines"])) for p in got[1]["pages"]] == [(1, 1, True, 1), (2, 1, None, None), (3, None, None, None)]
    assert (got[1]["warnings"], got[1]["validation_pass"], got[2]["warnings"], got[2]["validation_pass"]) == (2, False, 0, True)
    assert [p["page"] for p in report.render_report(units, verdicts).first()["pages"]] == [1, 2]
