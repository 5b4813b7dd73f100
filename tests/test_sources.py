"""Documents as a source, a file for each document as a sink, and the cache's log."""

import base64
import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.schemas import CACHE
from lectern.sources import artefacts, pages, pdf
from lectern.sources.cache_log import CacheLog
from lectern.sources.tables import raw_lines

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def dumped(text, raw=None, **more):
    return {"width": 595, "height": 842, "text": text, "raw": raw or {}, **more}


def block(*texts, y=50):
    boxes = [[50, y + 18 * i, 50 + min(400, 6 * len(t)), y + 18 * i + 10] for i, t in enumerate(texts)]
    lines = [{"bbox": b, "spans": [{"text": t, "bbox": b, "size": 10}]} for t, b in zip(texts, boxes)]
    return {"blocks": [{"type": 0, "lines": lines}]}


def test_a_corrupt_file_is_one_error_row(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for i in range(9):
        (tmp_path / ("in/deep" if i % 2 else "in") / f"d{i}.jsonl").write_bytes(pages.dump([dumped(f"page {k} of {i}") for k in range(i + 1)]))
    (tmp_path / "in/broken.jsonl").write_bytes(b'{"width": 1')
    (tmp_path / "in/notes.txt").write_text("none of the documents")
    got = pages.read_pages(spark, f"{tmp_path}/in").collect()
    wrong = [r for r in got if r["error"]]
    assert len(wrong) == 1 and wrong[0]["file"].endswith("broken.jsonl") and wrong[0]["page"] is None
    assert len({r["file"] for r in got}) == 10 and len(got) == 45 + 1
    by_spark = pdf.read_pages(spark, f"{tmp_path}/in", "*.jsonl").collect()
    strip = lambda rows: sorted((os.path.basename(r["file"]), r["page"] or 0, r["text"] or "", bool(r["error"])) for r in rows)
    assert strip(by_spark) == strip(got)


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    content = pages.dump([dumped(f"page {k} " + "x" * 300) for k in range(50)])
    (tmp_path / "large.jsonl").write_bytes(content)
    read = pages.read_pages(spark, f"{tmp_path}/large.jsonl", split_bytes=len(content) // 7)
    assert read.rdd.getNumPartitions() == 8
    assert sorted(r["page"] for r in read.collect()) == list(range(1, 51))
    shares = pages.shares_of(iter([("a", 5), ("b", 6), ("c", 25), ("d", 1), ("e", 0)]), 10)
    assert [s.shares for s in shares] == [[("a", 0, 1)], [("c", 0, 3)], [("c", 1, 3)], [("c", 2, 3)], [("b", 0, 1), ("d", 0, 1), ("e", 0, 1)]]


def test_a_page_that_cannot_be_read_is_an_error_row(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text(json.dumps(dumped("one")) + "\nno page\n" + json.dumps(dumped("three", raster=base64.b64encode(b"png").decode())) + "\n")
    (tmp_path / "empty.jsonl").write_text("")
    got = {r["page"]: r for r in pages.read_pages(spark, str(tmp_path), dpi=72).collect()}
    assert set(got) == {1, 2, 3} and got[2]["error"] and got[1]["text"] == "one" and bytes(got[3]["raster"]) == b"png"
    with pytest.raises(Exception, match="FileNotFoundError|nothing-here"):
        pages.read_pages(spark, f"{tmp_path}/nothing-here").collect()


def test_command_line_with_pages(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    image = {"xref": 3, "ext": "png", "width": 9, "height": 9, "data": "AAEC", "rects": [[0, 0, 595, 800]]}
    text = "Long enough lines of text stand here to be a paragraph of the page, all of them."
    (tmp_path / "in/a.jsonl").write_bytes(pages.dump([dumped(text, block("A heading", *[text] * 4), width=700), dumped("", images=[image])]))
    (tmp_path / "in/b.jsonl").write_bytes(b"broken")
    cli.main(["inspect", f"{tmp_path}/in", "--report", f"{tmp_path}/seen", "--source", "English"], spark=spark)
    assert "b.jsonl" in capsys.readouterr().out
    seen = spark.read.json(f"{tmp_path}/seen").collect()
    assert len(seen) == 1
    first, second = seen[0]["extraction"]
    assert first["mode"] == "native" and first["units"] == 2 and second["mode"] == "error" and second["image_ratio"] > 0.9
    cli.main(["translate", f"{tmp_path}/in", "--report", f"{tmp_path}/out", "--source", "English", "--target", "German", "--model", "m", "--cache", f"{tmp_path}/c", "--each"], spark=spark)
    out = json.loads((tmp_path / "out/a.jsonl.report.json").read_text())
    assert [p["page"] for p in out["pages"]] == [1, 2] and out["pages"][0]["units"][0]["translation"].startswith("[German]")
    assert os.listdir(tmp_path / "out") == ["a.jsonl.report.json"]
    assert CacheLog(spark, f"{tmp_path}/c").read().count() == 2
    lines = raw_lines(pages.read_pages(spark, f"{tmp_path}/in").filter("error IS NULL").withColumn("doc_id", F.lit(1)))
    assert lines.count() == 5


def test_a_file_for_each_document(spark, tmp_path):
    rows = spark.createDataFrame([(f"d/{i}.txt", f"text {i} é") for i in range(40)], "name string, content string").repartition(6)
    artefacts.write_artefacts(rows, f"{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["d"] and len(os.listdir(tmp_path / "out/d")) == 40
    assert (tmp_path / "out/d/7.txt").read_text() == "text 7 é"
    artefacts.write_artefacts(spark.createDataFrame([("d/7.txt", b"\x00\x01")], "name string, content binary"), f"{tmp_path}/out")
    assert (tmp_path / "out/d/7.txt").read_bytes() == b"\x00\x01" and len(os.listdir(tmp_path / "out/d")) == 40
    for bad in (["a", "a"], ["../x"], ["/x"], [None]):
        with pytest.raises(Exception, match="ValueError"):
            artefacts.write_artefacts(spark.createDataFrame([(b, "x") for b in bad], "name string, content string"), f"{tmp_path}/bad")
    assert not os.path.exists(tmp_path / "bad") or not os.listdir(tmp_path / "bad")  # nothing is left of a failed job


RETRY = """
    import os, sys
    from pyspark.sql import SparkSession
    from pyspark import TaskContext
    from lectern.sources import artefacts
    target, mark = sys.argv[1:]
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

    class Once(artefacts.ArtefactWriter):
        def write(self, iterator):
            done = super().write(iterator)
            if done.count and not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("the task dies after its files are written")
            return done

    class Failing(artefacts.Artefacts):
        def writer(self, schema, overwrite):
            return Once(self.options["path"], 4)

    artefacts.Artefacts = Failing
    rows = spark.createDataFrame([(f"{i}.txt", str(i)) for i in range(30)], "name string, content string")
    artefacts.write_artefacts(rows, target)
"""


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(RETRY))
    env = os.environ | {"PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, str(script), f"{tmp_path}/out", f"{tmp_path}/mark"], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.path.exists(tmp_path / "mark")
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{i}.txt" for i in range(30))
    assert all((tmp_path / f"out/{i}.txt").read_text() == str(i) for i in range(30))


def cached(spark, **texts):
    return spark.createDataFrame([(k, "s", "a", "b", "m", v) for k, v in texts.items()], CACHE)


def held(df):
    return {r["cache_key"]: r["translation"] for r in df.collect()}


def test_generations_add_to_each_other(spark, tmp_path):
    log = CacheLog(spark, f"{tmp_path}/c")
    assert log.read().count() == 0 and log.compact() is None
    log.append(cached(spark, k1="old", k2="kept"))
    log.append(cached(spark, k1="new", k3="more"))
    log.append(cached(spark))
    assert held(log.read()) == {"k1": "new", "k2": "kept", "k3": "more"} and held(log.read(until=1)) == {"k1": "old", "k2": "kept"}
    entry = log.compact()
    assert held(log.read()) == {"k1": "new", "k2": "kept", "k3": "more"} and [e.number for e in log.live()] == [entry.number]
    log.append(cached(spark, k2="later"))
    assert held(log.lookup(spark.createDataFrame([("k2",), ("k9",), ("k2",)], "cache_key string"))) == {"k2": "later"}
    assert held(log.read(until=2)) == {"k1": "new", "k2": "kept", "k3": "more"}
    assert log.vacuum(keep=1) == 3 and held(log.read())["k2"] == "later"


def test_a_compaction_does_not_hide_what_came_meanwhile(spark, tmp_path):
    log, other = CacheLog(spark, f"{tmp_path}/c"), CacheLog(spark, f"{tmp_path}/c")
    log.append(cached(spark, k="1"))
    merged, live = log.read(), log.live()
    other.append(cached(spark, k="2"))  # between the reading and the entry of the compaction
    log.append(merged, base=True, replaces=tuple(e.number for e in live), order=live[-1].order)
    assert held(log.read()) == {"k": "2"}
    again = log.append(merged, base=True, replaces=tuple(e.number for e in live), order=live[-1].order)
    assert again is None and held(log.read()) == {"k": "2"}  # the same generations cannot be replaced twice


def test_what_has_no_entry_does_not_count(spark, tmp_path):
    log = CacheLog(spark, f"{tmp_path}/c")
    log.append(cached(spark, k="1"))
    (tmp_path / "c/log/00000000000000000002.json").write_text('{"number": 2, "na')  # its writer died
    assert held(log.read()) == {"k": "1"}
    assert log.append(cached(spark, k="3")).number == 3 and held(log.read()) == {"k": "3"}
    assert not log._create(3, "{}")


def test_a_correction_outlives_the_next_compaction(spark, tmp_path):
    from lectern.sources import sinks
    from lectern.streaming import pages as stream

    cached(spark, k="stream").write.parquet(f"{tmp_path}/in")
    run = lambda: stream.upsert_stream(spark.readStream.schema(CACHE).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", f"{tmp_path}/cp").awaitTermination()
    run()
    compacted = stream.compact(spark, f"{tmp_path}/c")
    corrected = sinks.upsert(compacted, cached(spark, k="corrected").withColumn("ord", F.lit(1)))
    assert held(stream.compact(spark, f"{tmp_path}/c", corrected)) == {"k": "corrected"}
    assert held(stream.compact(spark, f"{tmp_path}/c")) == {"k": "corrected"}
    run()  # nothing new
    log = CacheLog(spark, f"{tmp_path}/c")
    assert log.append(cached(spark, k="stream"), stream=f"{tmp_path}/cp", epoch=0) is None  # a repeated micro-batch
    assert held(log.read()) == {"k": "corrected"}


def test_runs_keep_each_others_translations(spark, tmp_path):
    from lectern.operators import translate
    from lectern.plans.documents import Options, translate_documents
    from lectern.sources.tables import synthetic_lines

    body = "Long enough lines of text stand here to be a paragraph of the page, all of them.\n" * 4
    run = lambda text, **o: translate_documents(synthetic_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")), translate.EchoBackend("de"), Options("English", "German", **o), cache_root=f"{tmp_path}/c").collect()
    run("First heading\n" + body), run("Second heading\n" + body), run("Third heading\n" + body, use_cache=False)
    log = CacheLog(spark, f"{tmp_path}/c")
    assert sorted(v[:14] for v in held(log.read()).values()) == ["[de] First hea", "[de] Long enou", "[de] Second he"]
    run("First heading\n" + body)
    assert len(log.live()) == 2  # nothing new, no generation


def test_a_lookup_reads_only_files_that_may_hold_its_keys(spark, tmp_path, monkeypatch):
    from lectern.sources import cache_log

    monkeypatch.setattr(cache_log, "FILE_ROWS", 2000)
    log = CacheLog(spark, f"{tmp_path}/c")
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), *[F.lit("x").alias(c) for c in CACHE.names[1:5]], F.col("id").cast("string").alias("translation"))
    log.append(rows)
    log.append(rows.filter("translation = '5'").withColumn("translation", F.lit("changed")))
    keys = spark.createDataFrame([(i,) for i in (5, 6, 30_000)], "id long").select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"))
    files = log.candidate_files(keys)
    whole = sum(len([f for f in names if f.endswith(".parquet")]) for d, _, names in os.walk(tmp_path / "c/data") if "/rows" in d)
    assert whole == 17 and sum(map(len, files.values())) <= 3
    assert sorted(held(log.lookup(keys)).values()) == ["6", "changed"]
    none = spark.range(90_000, 90_200).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"))
    index = spark.read.parquet(f"{log.root}/data/{log.live()[0].name}/index")
    assert index.filter("piece > pieces").count() == 0
    assert sum(map(len, log.candidate_files(none).values())) <= 10  # about one key of fifty passes a filter by chance
