"""Reading images with a vision model, and requests to a chat service: with stubs that count their calls."""

import base64
import json
import os

import pytest

from lectern.operators import requests, translate, vision
from lectern.sources import visuals
from lectern.sources.readings import ReadingLog


def stub(folder):
    """Refuses JSON mode with 400, and fails as it is told by the image's first byte; notes each call in a folder, as workers are other processes."""

    class Stub:
        def read(self, data_url, width, height, mode):
            data = base64.b64decode(data_url.split(",")[1])
            with open(f"{folder}/{data.hex()}", "a") as f:
                f.write(mode + "\n")
            if mode == "json_object":
                raise translate.ServiceError(400)
            if data[0] == 9:
                raise translate.ServiceError(401)
            if data[0] == 8:
                return "no text here"
            return '{"regions": [{"bbox": [1, 1, 9, 9] "source_text": "a", "translation": "A%d"}]}' % data[0]

    return Stub()


def pages_of(spark, images):
    rows = [(d, p, json.dumps({"images": [{"xref": x, "ext": "png", "width": 10, "height": 10, "data": base64.b64encode(bytes([b])).decode(), "rects": [[0, 0, 10, 10]] * n} for x, (b, n) in enumerate(at)]})) for (d, p), at in images.items()]
    return spark.createDataFrame(rows, "doc_id long, page int, visuals string")


def test_images_are_read_once_and_kept(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    pages = pages_of(spark, {(1, 0): [(1, 2), (2, 1)], (1, 1): [(1, 1)], (2, 0): [(9, 1), (8, 1), (1, 1)]}).repartition(3)
    images, places = visuals.images(pages), visuals.placements(pages)
    run = lambda: vision.readings(images, stub(tmp_path / "calls"), f"{tmp_path}/read")
    found = run()
    by = {r["digest"]: r for r in found.collect()}
    assert len(by) == 4 and sorted(r["calls"] for r in by.values()) == [2, 2, 2, 2]
    assert sorted(r["error"] for r in by.values() if r["error"]) == ["no JSON object in the reply", "the service answered 401"]
    regions = sorted((r["doc_id"], r["region_id"], r["translation"]) for r in vision.image_regions(places, images, found).collect())
    assert regions == [(1, "p1_img0_0_r1", "A1"), (1, "p1_img0_1_r1", "A1"), (1, "p1_img1_0_r1", "A2"), (1, "p2_img0_0_r1", "A1"), (2, "p1_img2_0_r1", "A1")]
    calls = lambda: {f: len(open(tmp_path / "calls" / f).readlines()) for f in os.listdir(tmp_path / "calls")}
    assert calls() == {"01": 2, "02": 2, "09": 2, "08": 2}
    run()  # what was read is kept, what failed is asked again
    assert calls() == {"01": 2, "02": 2, "09": 4, "08": 4}
    os.makedirs(tmp_path / "read/r1-cut-off")  # an addition whose writer died does not count
    assert ReadingLog(spark, f"{tmp_path}/read").read().count() == 4


@pytest.mark.parametrize(
    "answers, calls, mode, error, waits",
    [
        (["{}"], 1, "json_object", None, []),
        ([400, "{}"], 2, "text", None, []),
        (["prose", '{"a": 1 "b": 2}'], 2, "text", None, []),
        ([503, 429, "{}"], 3, "json_object", None, [1, 2]),
        ([429] * 5 + ["{}"], 6, "text", None, [1, 2, 4, 8]),
        ([500] * 5, 5, "json_object", "the service answered 500 5 times", [1, 2, 4, 8]),
        ([422, 404], 2, "text", "the service answered 404", []),
        ([401], 1, "json_object", "the service answered 401", []),
        ([400] + [429] * 5, 6, "text", "the service answered 429 5 times", [1, 2, 4, 8]),
    ],
)
def test_conversations(answers, calls, mode, error, waits):
    left, slept = list(answers), []

    class Scripted:
        def read(self, *_):
            x = left.pop(0)
            if isinstance(x, int):
                raise translate.ServiceError(x)
            return x

    reply, m, n, e = vision.converse(Scripted(), "data:", 1, 1, slept.append)
    assert (n, m, e, slept) == (calls, mode, error, waits) and (reply is None) == (error is not None) and not left


def test_scaled_images_are_mapped_back(spark, tmp_path):
    images = spark.createDataFrame([("d", "png", b"\x01", 4800, 2400)], "digest string, ext string, bytes binary, image_w int, image_h int")

    class Seen:
        def read(self, url, width, height, mode):
            return json.dumps({"regions": [{"bbox": [10, 10, width, height], "source_text": f"{base64.b64decode(url.split(',')[1])!r}", "translation": "x"}]})

    found = vision.ask(images, Seen(), resize=lambda data, ext, w, h: data * 2)
    row = found.first()
    assert (row["sent_w"], row["sent_h"], row["scale"]) == (2400, 1200, 0.5)
    from lectern.operators.regions import read_regions

    region = read_regions(found).first()
    assert tuple(region["bbox_px"]) == (20.0, 20.0, 4800.0, 2400.0) and region["source_text"] == repr(b"\x01\x01")


def test_requests():
    bodies = []

    def send(body):
        bodies.append(body)
        return {"choices": [{"message": {"content": [{"type": "text", "text": '{"translations": ['}, {"text": '{"id": "a", "translation": "A"}]}'}]}}]}

    backend = requests.ChatBackend(send, "French", "German", "m")
    assert translate.translate_units(backend, [{"id": "a", "kind": "label", "text": "é {x}"}]) == {"a": "A"}
    asked = bodies[0]["messages"][1]["content"]
    assert bodies[0]["temperature"] == 0 and "French" in asked and "é {x}" in asked and '["a"]' in asked
    seen = requests.region_body("data:x", 3, 4, "French", "German", "m", "json_object")
    assert seen["response_format"] == {"type": "json_object"} and "response_format" not in requests.region_body("data:x", 3, 4, "French", "German", "m", "text")
    with pytest.raises(translate.ServiceError):
        requests.content_of({"choices": []})


def test_a_fault_of_the_program_stops_the_job(spark):
    class Wrong:
        def translate(self, units):
            return units["no such key"]

    units = spark.createDataFrame([("k", 1, 0, 1, "label", "t")], "cache_key string, doc_id long, page int, unit_ord int, kind string, text string")
    with pytest.raises(Exception, match="TypeError"):
        translate.translate_misses(units, Wrong()).collect()


def test_catalogs_are_kept_for_a_while(spark, tmp_path):
    from lectern.operators import catalog
    from lectern.sources.catalogs import catalog_payloads

    asked, clock = [], [1000.0]

    def fetch(service):
        asked.append(service)
        if service == "down":
            raise OSError("no way there")
        return json.dumps({"data": [{"id": f"{service}/{len(asked)}"}]})

    read = lambda: {r["service"]: r["id"] for r in catalog.chat_models(catalog.read_catalog(catalog_payloads(spark, f"{tmp_path}/c", ["a", "b", "down"], fetch, 600, lambda: clock[0]), keep=("service",)), by=("service",)).collect()}
    assert read() == {"a": "a/1", "b": "b/2"}
    clock[0] += 599
    assert read() == {"a": "a/1", "b": "b/2"} and asked == ["a", "b", "down", "down"]
    clock[0] += 2
    assert read() == {"a": "a/5", "b": "b/6"}


def narrow(folder, most):
    """A service that refuses with 429 what goes over ``most`` requests of a round; a file for each request says in which partition it was made."""

    class Narrow:
        def translate(self, units):
            from pyspark import TaskContext

            with open(f"{folder}/round") as f:
                n = f.read()
            made = len([x for x in os.listdir(folder) if x.startswith(f"{n}-")])
            name = f"{folder}/{n}-{TaskContext.get().partitionId()}-{units[0]['id'][:12]}"
            open(name, "w").close()
            if made >= most:
                os.rename(name, name + "-refused")
                raise translate.ServiceError(429)
            return json.dumps({"translations": [{"id": u["id"], "translation": "T " + u["text"]} for u in units if "lost" not in u["text"]]})

    return Narrow()


def test_a_busy_service_slows_all_partitions(spark, tmp_path):
    from lectern.sources.cache_log import CacheLog
    from lectern.streaming.paced import Pace, PacedTranslation

    (tmp_path / "calls").mkdir()
    schema = "doc_id long, page int, unit_ord int, kind string, text string"
    spark.createDataFrame([(d, 0, u, "label", f"text {d} {u % 7}") for d in range(30) for u in range(10)], schema).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(99, 0, 0, "label", "a lost text")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    slept = []
    log = CacheLog(spark, f"{tmp_path}/cache")

    class Counted(PacedTranslation):
        def _ask(self, due):
            with open(f"{tmp_path}/calls/round", "w") as f:
                f.write(str(len(self._rounds("answers"))))
            return super()._ask(due)

    paced = Counted(spark, f"{tmp_path}/paced", narrow(str(tmp_path / "calls"), 5), log, ("French", "German", "m"), start=24, most=64, step=2, lanes=3, attempts=2, sleep=slept.append)
    paced.stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp").awaitTermination()
    rounds = paced.drain(60)
    assert log.read().count() == 30 * 7 and rounds > 5  # each text once, and the lost one given up after its attempts
    by_round = {}
    for name in os.listdir(tmp_path / "calls"):
        if "-" in name:
            n, partition, *_ = name.split("-")
            by_round.setdefault(int(n), []).append((partition, name.endswith("-refused")))
    assert any(r for _, r in by_round[0]) and any(r for _, r in by_round[1])  # 24, then 12 of 5
    assert max(len(v) for n, v in by_round.items() if n > 2) <= 5 + 3  # the lanes together ask for no more than the pace lets them
    assert len({p for p, _ in by_round[0]}) >= 2 and slept[:3] == [0.0, 1.0, 2.0]
    assert Pace(8).after(1, 2, 64) == Pace(4, 1.0, 1) and Pace(4, 1.0, 1).after(2, 2, 64) == Pace(2, 2.0, 2) and Pace(2, 2.0, 2).after(0, 2, 64) == Pace(4)
    made = len(os.listdir(tmp_path / "calls"))
    paced.round(0)  # a repeated round asks nobody
    assert len(os.listdir(tmp_path / "calls")) == made and log.read().count() == 30 * 7
