"""The queries of the layout engine and, where it can be said in SQL, the same in SQL.

All run over whole tables. Tables of this kind have no boxes, so lines come
from ``synthetic_lines``, and what extractors, engines and models would say of
them is made from the lines by rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as geo
from .functions import text as tx
from .operators import catalog, fit, grids, lines, qa, quality, rasters, regions, report, segment, translate
from .plans.documents import Options, inspect, kept_lines, translate_documents
from .sources import sinks, visuals
from .sources.tables import mean_confidence, raw_lines, recognized_lines, recognized_words, synthetic_lines, synthetic_rules, table

LATIN, SOURCE, TARGET, MODEL = "English", "French", "English", "m"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return synthetic_lines(table(spark, d, "documents"))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return synthetic_rules(_lines(spark, d))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment(_lines(spark, d), LATIN)


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """A document as one unit."""
    return table(spark, d, "documents").select("doc_id", F.lit(0).alias("page"), F.lit(1).alias("unit_ord"), F.lit("p1_u001").alias("unit_id"), F.lit("paragraph").alias("kind"), "text")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """A row for each document: of those with an odd id under another text, so that they are misses; every tenth of the others with an empty text."""
    changed = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("?")))
    keyed = translate.with_keys(_whole(spark, d).filter("text IS NOT NULL").withColumn("text", changed), SOURCE, TARGET, MODEL)
    rows = keyed.groupBy("cache_key").agg(F.first("text").alias("source_text"), F.min("doc_id").alias("i"))
    done = F.when(F.col("i") % 20 == 0, "").otherwise(F.concat(F.lit("T: "), "source_text"))
    return rows.select("cache_key", "source_text", F.lit(SOURCE).alias("source_language"), F.lit(TARGET).alias("target_language"), F.lit(MODEL).alias("model"), done.alias("translation"))


def _styled(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two spans each, of several sizes and left edges."""
    ln, b = _lines(spark, d), F.col("bbox")
    x0 = F.when(F.col("ord") % 5 == 0, b["x0"] + 30).otherwise(b["x0"])
    bb = geo.box(x0, b["y0"], b["x1"], b["y1"])
    size = F.when(F.col("ord") % 4 == 3, 12.0).otherwise(10.0)
    span = lambda t, s: F.struct(t.alias("text"), bb.alias("bbox"), F.lit("F").alias("font"), s.alias("size"), F.lit(0).alias("color"), F.lit(0).alias("flags"))
    return ln.select("doc_id", "page", "ord", "text", bb.alias("bbox"), F.array(span(F.substring("text", 1, 3), F.lit(20.0)), span(F.expr("substr(text, 4)"), size)).alias("spans"))


def _pages(spark: SparkSession, d: str, rules: DataFrame | None = None) -> DataFrame:
    """Pages with what an extractor says of their images, and of the drawings in ``rules``: an image over four fifths of a page with three lines or fewer, over half of the others."""
    share = F.when(F.count(F.lit(1)) <= 3, 0.8).otherwise(0.5)
    pages = _lines(spark, d).groupBy("doc_id", "page").agg(share.alias("share"))
    rect = lambda *v: F.array(*[x.cast("double") for x in v])
    image = F.struct(F.lit(7).alias("xref"), F.lit("png").alias("ext"), F.lit(10).alias("width"), F.lit(10).alias("height"), F.lit("AAAA").alias("data"), F.array(rect(F.lit(0), F.lit(0), F.lit(595), 842 * F.col("share"))).alias("rects"))
    pages = pages.select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.array(image).alias("images"))
    if rules is None:
        return pages.withColumn("visuals", F.to_json(F.struct("images")))
    b = F.col("bbox")
    drawn = rules.groupBy("doc_id", "page").agg(F.collect_list(F.struct(rect(b["x0"], b["y0"], b["x1"], b["y1"]).alias("rect"))).alias("drawings"))
    return pages.join(drawn, ["doc_id", "page"], "left").withColumn("visuals", F.to_json(F.struct("images", "drawings")))


def source_lines_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    kept = _lines(spark, d).withColumn("ok", tx.is_source_text(F.col("text"), LATIN)).join(docs, "doc_id")
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("ok").alias("n_source"))


def page_quality_score(spark: SparkSession, d: str) -> DataFrame:
    q = quality.page_quality(_lines(spark, d))
    return q.select("doc_id", "page", "chars", "lines", *[F.round(c, 6).alias(c) for c in ("area_ratio", "duplicate_ratio", "score")])


def extraction_route(spark: SparkSession, d: str) -> DataFrame:
    return quality.route(quality.page_quality(_lines(spark, d))).select("doc_id", "page", "mode", F.round("confidence", 6).alias("confidence"))


def document_profile(spark: SparkSession, d: str) -> DataFrame:
    pages = _lines(spark, d).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
    pages = pages.select(F.col("doc_id").cast("string").alias("file"), "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), "text", F.lit(0).alias("image_count"), F.lit(0).alias("drawing_count"))
    p = quality.document_profile(pages)
    return p.select("file", "page_count", F.aggregate("pages", F.lit(0).cast("long"), lambda a, x: a + x["text_chars"]).alias("text_chars"), "recommended_pipeline")


def paragraph_units(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("doc_id", "unit_id", "n_lines", "bbox.*", F.sha2("text", 256).alias("text_sha"))


def unit_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).groupBy("kind", "n_lines").agg(F.count(F.lit(1)).alias("n"))


def dominant_style(spark: SparkSession, d: str) -> DataFrame:
    """The longest of each page's lines, as if they were spans of one line."""
    spans = _lines(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", F.element_at("spans", 1).alias("s")))).alias("l"))
    s = F.transform("l", lambda x: F.struct(x["s"]["text"].alias("text"), x["s"]["bbox"].alias("bbox"), x["ord"].cast("string").alias("font"), x["s"]["size"].alias("size"), x["s"]["color"].alias("color"), x["s"]["flags"].alias("flags")))
    return spans.select("doc_id", "page", segment.dominant(s)["font"].alias("ord"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return translate.with_keys(_whole(spark, d), SOURCE, TARGET, MODEL).select("doc_id", "cache_key")


def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    found = translate.lookup(translate.with_keys(_whole(spark, d), SOURCE, TARGET, MODEL), _cache(spark, d))
    return found.select("doc_id", F.col("cached").isNotNull().alias("hit"), F.sha2("cached", 256).alias("cached_sha"))


def call_batches(spark: SparkSession, d: str) -> DataFrame:
    return translate.batches(_units(spark, d)).select("doc_id", "unit_id", "batch")


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    keyed = translate.with_keys(_whole(spark, d).filter("text IS NOT NULL"), SOURCE, TARGET, MODEL)
    new = keyed.select("cache_key", F.col("text").alias("source_text"), F.lit(SOURCE).alias("source_language"), F.lit(TARGET).alias("target_language"), F.lit(MODEL).alias("model"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("translation"), F.col("doc_id").alias("ord"))
    return sinks.upsert(_cache(spark, d), new).select("cache_key", F.sha2("translation", 256).alias("translation_sha"))


def dedupe_savings(spark: SparkSession, d: str) -> DataFrame:
    keyed = translate.with_keys(_whole(spark, d), SOURCE, TARGET, MODEL).withColumn("cached", F.lit(None).cast("string"))
    return keyed.agg(F.count(F.lit(1)).alias("units")).join(translate.distinct_misses(keyed).agg(F.count(F.lit(1)).alias("calls")), F.lit(True))


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    """Units that a backend left out which answers nothing that ends in 3."""
    pending = translate.batches(_units(spark, d))
    item = F.to_json(F.struct(F.col("unit_id").alias("id"), F.lit("x").alias("translation")))
    replies = pending.filter("unit_id NOT LIKE '%3'").groupBy("doc_id", "batch").agg(F.concat(F.lit('```json\n{"translations": ['), F.concat_ws(", ", F.collect_list(item)), F.lit("]}\n```")).alias("reply"))
    return translate.missing(pending, translate.parse_translations(replies)).select("doc_id", "unit_id")


def text_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Lines grown by 6 points on all sides run into their neighbours."""
    grown = qa.rendered(_lines(spark, d)).withColumn("bbox", geo.inflate(F.col("bbox"), 6.0, 6.0))
    return qa.text_collisions(grown).select("doc_id", "page", "a", "b", F.round("area", 6).alias("area"))


def rule_crossings(spark: SparkSession, d: str) -> DataFrame:
    return qa.rule_crossings(qa.rendered(_lines(spark, d)), _rules(spark, d))


def outside_safe(spark: SparkSession, d: str) -> DataFrame:
    """Every line expected in its own place, but the even ones 30 points to the left."""
    n = F.when(F.col("ord") % 2 == 0, 30.0).otherwise(0.0)
    b = F.col("bbox")
    safe = geo.box(b["x0"] - 0.5 - n, b["y0"] - 0.5, b["x1"] + 0.5 - n, b["y1"] + 0.5)
    expected = qa.rendered(_lines(spark, d)).select("doc_id", "page", F.col("ord").alias("id"), "text", safe.alias("safe"))
    return qa.outside_safe(qa.rendered(_lines(spark, d)), expected)


def uncovered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines left when every fourth line was translated, in a box 8 points higher at every eighth."""
    moved = F.when(F.col("ord") % 8 == 0, 8.0).otherwise(0.0)
    b = F.col("bbox")
    done = _lines(spark, d).filter("ord % 4 = 0").withColumn("bbox", geo.box(b["x0"], b["y0"] - moved, b["x1"], b["y1"] - moved))
    return qa.uncovered(_lines(spark, d), done).select("doc_id", "page", "ord")


def decoration_rules(spark: SparkSession, d: str) -> DataFrame:
    empty = spark.createDataFrame([], "doc_id long, page int, grid_ord int, top double, bottom double, xs array<double>")
    return grids.decorations(_rules(spark, d), _lines(spark, d), empty).select("doc_id", "page", "ord")


def page_verdict(spark: SparkSession, d: str) -> DataFrame:
    items = qa.rendered(_lines(spark, d))
    v = qa.page_verdicts(items, qa.text_collisions(items), qa.rule_crossings(items, _rules(spark, d)), outside_safe(spark, d))
    return v.select("doc_id", "page", "text_count", "text_text", "text_drawing", "outside", "pass")


def document_verdict(spark: SparkSession, d: str) -> DataFrame:
    return qa.document_verdicts(page_verdict(spark, d))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each page's lines as a table of three columns: rules under every fourth line, uprights at three places."""
    rows = _lines(spark, d).filter(tx.not_blank(F.col("text")))
    pages = rows.groupBy("doc_id", "page").agg(F.max("bbox.y1").alias("y1"), F.collect_list(F.when(F.col("ord") % 4 == 0, F.col("bbox.y0"))).alias("ys"))
    flat = F.transform("ys", lambda y: geo.box(F.lit(50.0), y - 4, F.lit(500.0), y - 3.5))
    up = F.transform(F.array(*[F.lit(x) for x in (50.0, 50.6, 200.0, 500.0)]), lambda x: geo.box(x, F.lit(36.0), x + 0.5, F.col("y1") + 20))
    return rows, pages.select("doc_id", "page", F.explode(F.concat(flat, up)).alias("bbox"))


def table_grids(spark: SparkSession, d: str) -> DataFrame:
    _, rules = _tables(spark, d)
    g = grids.detect_grids(rules)
    return g.select("doc_id", "page", "grid_ord", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"), F.size("xs").alias("n_xs"), F.round(F.get("xs", 0), 6).alias("x_first"))


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    rows, rules = _tables(spark, d)
    units = segment.segment(rows, LATIN, grids.detect_grids(rules))
    return units.select("doc_id", "unit_id", "kind", "n_lines", F.sha2("text", 256).alias("text_sha"), "bbox.*")


def _word_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose fragments are the words of their lines. Lines are dealt out by page; they are cut to words there."""
    there = F.array_sort(F.collect_list(F.struct("ord", "text", "bbox.y0", "bbox.y1")))
    pages = _lines(spark, d).groupBy("doc_id", "page").agg(there.alias("there"))

    def fragment(ln: Column, w: Column, i: Column) -> Column:
        x = 50 + i * 40.0
        b = geo.box(x, ln["y0"] + (i % 2) * 0.5, x + 30, ln["y1"])
        span = F.struct(w.alias("text"), b.alias("bbox"), F.lit("F").alias("font"), F.lit(10.0).alias("size"), F.lit(0).alias("color"), F.lit(0).alias("flags"))
        return F.struct(w.alias("text"), b.alias("bbox"), F.array(span).alias("spans"))

    fragments = F.flatten(F.transform("there", lambda ln: F.transform(tx.words(ln["text"]), lambda w, i: fragment(ln, w, i))))
    return pages.select("doc_id", "page", fragments.alias("fragments"))


def merged_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every line cut in words, put together again."""
    out = lines.merge_pages(_word_pages(spark, d))
    return out.select("doc_id", "page", "ord", F.sha2("text", 256).alias("text_sha"), F.size("spans").alias("n_spans"), "bbox.*")


def merged_rows_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """``merged_rows`` by SQL and table functions: lines from texts, words from lines, the fold over each page's boxes, and rows from their members. Only lines are dealt out."""
    lines.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("merged_documents")
    return spark.sql(
        """
        WITH l AS (SELECT doc_id, page, ord, line FROM merged_documents, LATERAL text_lines(text) WHERE text IS NOT NULL),
        p AS (SELECT doc_id, page, array_sort(collect_list(struct(ord, line))) AS there FROM l GROUP BY doc_id, page),
        b AS (
          SELECT doc_id, page, flatten(transform(there, l -> transform(filter(split(l.line, '(?U)[\\\\s\\\\x1c-\\\\x1f\\\\x85]+'), x -> x != ''), (w, i) ->
            struct(w, 50D + i * 40D AS x0, 40D + 18D * l.ord + (i % 2) * 0.5D AS y0, 80D + i * 40D AS x1, 50D + 18D * l.ord AS y1)))) AS bs FROM p),
        t AS (SELECT doc_id, page, bs, members FROM b, LATERAL row_members(bs.x0, bs.y0, bs.y1)),
        r AS (
          SELECT doc_id, page, posexplode(array_sort(transform(transform(members, m -> transform(m, i -> bs[i])), (g, n) ->
            struct(array_min(g.y0) AS y0, array_min(g.x0) AS x0, n, array_max(g.x1) AS x1, array_max(g.y1) AS y1, size(g) AS n_spans, array_join(transform(array_sort(transform(g, (x, k) -> struct(x.x0, k, x.w))), x -> x.w), ' ') AS text)))) AS (ord, r) FROM t)
        SELECT doc_id, page, ord, sha2(r.text, 256) AS text_sha, r.n_spans, r.x0, r.y0, r.x1, r.y1 FROM r
        """
    )


def region_page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A region in the pixels of an image for every line: some beyond the image, some turned around, too thin or not numbers."""
    n, k = F.length("text"), F.col("ord")
    w, h = 100 + 10 * (n % 40), 80 + 5 * (k % 20)
    corner = F.when(k % 11 == 3, F.lit("x")).otherwise((k - 3).cast("string"))
    px = F.array((n % 90).cast("string"), corner, F.when(k % 5 == 0, n % 90 + 1).otherwise(n % 500).cast("string"), (F.lit(2) * k + 9).cast("string"))
    image = geo.box(F.lit(40.0), F.col("bbox.y0"), F.lit(40.0) + n, F.col("bbox.y0") + 2 * k)
    r = _lines(spark, d).select("doc_id", "page", "ord", geo.valid_box(px, w, h).alias("b"), geo.page_box(image, w, h, geo.valid_box(px, w, h)).alias("p"))
    return r.filter("b IS NOT NULL").select("doc_id", "page", "ord", *[F.round(F.col("p")[c], 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _replies(units: DataFrame) -> DataFrame:
    """doc_id, batch, reply: what a model might answer to batches of units. By batch and unit: commas left out, a fence or prose around, other names of fields,
    ids in backticks, a first answer that a later one corrects, and a reply that is none."""
    key = F.element_at(F.array(*map(F.lit, ("id", "unit_id", "segment_id"))), F.col("unit_ord") % 3 + 1)
    name = F.when(F.col("unit_ord") % 2 == 0, "translation").otherwise("translated_text")
    ticked = F.when(F.col("unit_ord") % 4 == 1, F.concat(F.lit(" `"), "unit_id", F.lit("` "))).otherwise(F.col("unit_id"))
    item = lambda text: F.to_json(F.map_from_arrays(F.array(key, name), F.array(ticked, text)))
    rows = translate.batches(units).select("doc_id", "batch", F.struct("page", "unit_ord", F.lit(1).alias("turn"), item(F.col("text")).alias("item")).alias("i"), F.struct("page", "unit_ord", F.lit(0).alias("turn"), item(F.lit("not yet")).alias("item")).alias("first"))
    rows = rows.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list("i")).alias("items"), F.array_sort(F.collect_list("first")).alias("firsts"))
    items = F.transform(F.concat(F.slice("firsts", 1, 1), F.col("items")), lambda x: x["item"])
    body = F.concat(F.lit('{"translations": ['), F.array_join(items, " ") , F.lit("]}"))
    whole = F.concat(F.lit('{"translations": ['), F.array_join(items, ", "), F.lit("]}"))
    reply = (
        F.when(F.col("batch") % 5 == 4, F.lit("I cannot help with that."))
        .when(F.col("batch") % 5 == 0, body)
        .when(F.col("batch") % 5 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(F.col("batch") % 5 == 2, F.concat(F.lit("Here you are: "), whole, F.lit(" Done.")))
        .otherwise(whole)
    )
    return rows.select("doc_id", "batch", reply.alias("reply"))


def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """What is read from broken replies to the units of all documents."""
    found = translate.parse_translations(_replies(_units(spark, d)))
    return found.select("doc_id", "batch", "unit_id", F.sha2("translation", 256).alias("translation_sha"))


def image_regions(spark: SparkSession, d: str) -> DataFrame:
    """An image on every page, twice on every third one; the reply has a region for each of the page's lines, some of which cannot be placed."""
    k, text = F.col("ord"), F.col("text")
    box_px = F.array(F.lit(10) + k, F.lit(2) * k, F.lit(60) + k, F.when(k % 6 == 5, F.lit(2) * k + 1).otherwise(F.lit(2) * k + 8))
    said = F.struct(box_px.cast("array<string>").alias("bbox"), text.alias("source_text"), F.when(k % 4 == 3, "").otherwise(F.concat(F.lit("T "), k.cast("string"))).alias("translation"), F.when(k % 5 == 0, "high").otherwise((k / 10).cast("string")).alias("confidence"))
    pages = _lines(spark, d).groupBy("doc_id", "page").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ord", said.alias("r")))), lambda x: x["r"]).alias("regions"))).alias("reply"))
    pages = pages.withColumn("digest", F.sha2(F.concat_ws("/", "doc_id", "page", "reply"), 256))
    replies = pages.select("digest", "reply", F.lit(100).alias("sent_w"), F.lit(90).alias("sent_h"), F.lit(0.5).alias("scale"), F.lit(200).alias("image_w"), F.lit(180).alias("image_h")).dropDuplicates(["digest"])
    at = F.when((F.col("doc_id") + F.col("page")) % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    places = pages.select("doc_id", "page", F.lit(7).alias("xref"), F.explode(at).alias("occ"))
    places = places.withColumn("rect", geo.box(F.lit(100.0) * F.col("occ"), F.lit(10.0), F.lit(100.0) * F.col("occ") + 100, F.lit(100.0) + 90 * F.col("occ")))
    images = pages.select("doc_id", "page", F.lit(7).alias("xref"), "digest", F.lit(200).alias("image_w"), F.lit(180).alias("image_h"))
    out = regions.place_regions(places, images, regions.read_regions(replies))
    return out.select("doc_id", "region_id", *[F.round(F.col("bbox")[c], 6).alias(c) for c in ("x0", "y0", "x1", "y1")], F.sha2("source_text", 256).alias("source_sha"), "translation", F.round("confidence", 6).alias("confidence"))


def fit_plan(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d).withColumn("translation", F.concat(F.col("text"), F.lit(" "), F.col("text")))
    return fit.plan_fit(units).select("doc_id", "unit_id", F.round("final_size", 4).alias("final_size"), F.size("fitted").alias("n_fitted"), F.col("warning").isNotNull().alias("warned"))


def _catalogs(spark: SparkSession, d: str) -> DataFrame:
    """service, value: a catalog of each brand as JSON, a model for each of its parts. Types name what a model takes and gives; some say nothing of it."""
    k, size = F.col("p_partkey"), F.col("p_size")
    some = lambda *x: F.array(*map(F.lit, x))
    ins = F.when(size % 5 == 0, some("text", "image")).when(size % 5 == 1, some("image")).when(size % 5 == 2, some("text"))
    outs = F.when(size % 3 == 0, some("text")).when(size % 3 == 1, some("image", "text")).when(size % 7 == 0, some("embedding"))
    id_ = F.when(k % 50 == 7, "").otherwise(F.concat_ws("/", F.when(k % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")), F.when(k % 9 == 0, F.concat(F.lit("embedding-"), k.cast("string"))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), k.cast("string")))))
    model = F.struct(id_.alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("name"), F.struct(ins.alias("input_modalities"), outs.alias("output_modalities")).alias("architecture"))
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("service")).agg(F.to_json(F.struct(F.collect_list(model).alias("data"))).alias("value"))


def model_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.chat_models(catalog.read_catalog(_catalogs(spark, d), keep=("service",)), by=("service",))


def image_model_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.image_models(catalog.read_catalog(_catalogs(spark, d), keep=("service",)), "SMALL/small-bolt1", by=("service",))


#: Names of the languages of the documents' codes.
NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}


def target_languages(spark: SparkSession, d: str) -> DataFrame:
    """For how many documents each language can be chosen as a target."""
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    docs = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    offered = docs.select("lang", "docs", F.explode(F.array(*map(F.lit, catalog.LANGUAGES))).alias("language"))
    return catalog.targets(offered, F.try_element_at(names, F.col("lang"))).select("lang", "language", "docs")


def aspect_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Pixel sizes taken from the parts table."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 40).alias("w"), F.lit(1000).alias("h"))
    s = geo.sent_size(F.col("w"), F.col("h"), 900)
    return p.select("id", geo.aspect(F.col("w"), F.col("h")).alias("aspect"), s["w"].alias("sent_w"), s["h"].alias("sent_h"))


def ocr_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes, packs and modes of a language and a mode that each document names by its number."""
    names = F.array(*map(F.lit, [*catalog.LANGUAGES, "Simplified Chinese", " traditional chinese ", ""]))
    modes = F.array(*map(F.lit, [*tx.MODES, "other"]))
    t = table(spark, d, "documents").select(F.get(names, (F.col("doc_id") % 25).cast("int")).alias("language"), F.get(modes, (F.col("doc_id") % 5).cast("int")).alias("label"))
    t = t.select(F.coalesce("language", F.lit("-")).alias("language"), tx.ocr_code(F.col("language")).alias("code"), tx.ocr_pack(tx.ocr_code(F.col("language"))).alias("pack"), tx.mode(F.col("label")).alias("mode"))
    return t.groupBy("language", "code", "pack", "mode").agg(F.count(F.lit(1)).alias("docs"))


def recognized_text(spark: SparkSession, d: str) -> DataFrame:
    """Both shapes of recognition results, made from the lines: boxes with points somewhere in a payload, and words with confidences."""
    ln, b, k = _lines(spark, d), F.col("bbox"), F.col("ord")
    point = lambda x, y: F.array((2 * x).cast("double"), (2 * y).cast("double"))
    turned = F.array(point(b["x1"], b["y1"]), point(b["x0"], b["y1"]), point(b["x0"], b["y0"]), point(b["x1"], b["y0"]))
    of_page = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-k).alias("k"), c.alias("v")))), lambda x: x["v"])  # noqa: E731  from below upwards
    held = F.to_json(F.struct(F.array(F.lit("page"), F.lit("1")).alias("meta"), F.array(F.struct(F.struct(of_page(F.concat(F.lit(" "), "text")).alias("rec_texts"), of_page(turned).alias("rec_polys")).alias("res"))).alias("out")))
    boxes = recognized_lines(visuals.recognition_payloads(ln.groupBy("doc_id", "page").agg(held.alias("reply"))), 2.0)
    conf = F.when(k % 11 == 0, "-1").when(k % 13 == 0, "").otherwise((k * 7 % 100).cast("string"))
    words = ln.select("doc_id", "page", k.alias("i"), "text", conf.alias("conf"), (b["x0"] * 2).cast("int").alias("left"), (b["y0"] * 2).cast("int").alias("top"), ((b["x1"] - b["x0"]) * 2).cast("int").alias("width"), F.lit(20).alias("height"))
    found = boxes.withColumn("kind", F.lit("boxes")).unionByName(recognized_words(words, 2.0).withColumn("kind", F.lit("words"))).join(mean_confidence(words), ["doc_id", "page"], "left")
    return found.select("doc_id", "page", "kind", "ord", F.sha2("text", 256).alias("text_sha"), "bbox.*", F.round("confidence", 6).alias("confidence"))


def extractor_payload(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as an extractor gives them, made from the lines: a block a line, of another type at every seventh; two spans or three with fields left out; vowels of
    every fifth line written in another script."""
    k, b = F.col("ord"), F.col("bbox")
    text = F.when(k % 5 == 2, F.translate("text", "aeo", "日ア本")).otherwise(F.col("text"))
    corners = F.array(b["x0"], b["y0"], b["x1"], b["y1"])
    span = lambda t, size: F.struct(t.alias("text"), F.when(k % 2 == 0, corners).alias("bbox"), size.alias("size"))
    spans = F.array(span(F.substring(text, 1, 3), F.when(k % 3 == 0, 12.5)), span(F.lit("  "), F.lit(None).cast("double")), span(F.expr("substr(t, 4)"), F.lit(None).cast("double")))
    line = F.struct(corners.alias("bbox"), F.when(k % 9 == 8, F.slice(spans, 1, 0)).otherwise(spans).alias("spans"))
    block = F.struct(F.when(k % 7 == 6, 1).otherwise(0).alias("type"), F.array(line).alias("lines"))
    blocks = _lines(spark, d).withColumn("t", text).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    found = raw_lines(blocks.select("doc_id", "page", F.to_json(F.struct("blocks")).alias("raw")))
    return found.select("doc_id", "page", "ord", F.sha2("text", 256).alias("text_sha"), "bbox.*", F.size("spans").alias("n_spans"), F.get("spans", 0)["size"].alias("first_size"), F.get("spans", 0)["bbox"]["x1"].alias("first_x1"))


#: A letter of each script that a source language is told by.
LETTERS = {"Japanese": "ア", "Chinese": "本", "Korean": "가", "Arabic": "ا", "Russian": "д", "Ukrainian": "ї", "Thai": "ก", "Hindi": "अ", "Tamil": "அ", "Telugu": "అ", "Malayalam": "അ", "Kannada": "ಅ"}


def source_scripts(spark: SparkSession, d: str) -> DataFrame:
    """How many lines each source language would take, where the lines write their e in one of twelve scripts by turns, or have no letter but that one."""
    k = F.col("ord") % 13
    letter = F.get(F.array(*map(F.lit, LETTERS.values())), k)
    text = F.when(letter.isNull(), F.col("text")).when(F.col("page") % 2 == 0, F.replace("text", F.lit("e"), letter)).otherwise(F.concat(letter, F.regexp_replace("text", "[A-Za-zÀ-ÿ]", "")))
    t = _lines(spark, d).select(text.alias("t"))
    counts = [F.count_if(tx.is_source_text(F.col("t"), name)).alias(name) for name in (*LETTERS, LATIN)]
    one = t.agg(*counts, F.count_if(tx.has_cjk(F.col("t"))).alias("any_cjk"))
    return one.unpivot([], [*LETTERS, LATIN, "any_cjk"], "language", "lines")


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of erased and safe areas, baselines and aligned starts of every line."""
    ln = _lines(spark, d)
    b, w = F.col("bbox"), F.length("text") * 5.0
    r, s = geo.redaction_box(b), geo.safe_box(b)
    return ln.select("doc_id", "page", "ord", F.round(r["x0"], 6).alias("redact_x0"), F.round(r["y1"], 6).alias("redact_y1"), s["x1"].alias("safe_x1"), F.round(geo.baseline(b, F.lit(10.0)), 6).alias("baseline"), geo.aligned_x(b, w, F.lit(1)).alias("x_mid"), geo.aligned_x(b, w, F.lit(2)).alias("x_right"))


def page_components(spark: SparkSession, d: str) -> DataFrame:
    ln = _lines(spark, d)
    return report.component_counts(ln.select("doc_id", "page").distinct(), lines=ln, units=_units(spark, d), rules=_rules(spark, d))


def inspection_report(spark: SparkSession, d: str) -> DataFrame:
    r = inspect(_lines(spark, d), Options(source_language=LATIN, target_language="German"))
    return r.select("doc_id", F.size("extraction").cast("long").alias("pages"), F.coalesce(F.size("units"), F.lit(0)).cast("long").alias("n_units"))


def styled_units(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment(_styled(spark, d), LATIN).select("doc_id", "unit_id", "n_lines", "bbox.*", "size", F.sha2("text", 256).alias("text_sha"))


def page_images(spark: SparkSession, d: str) -> DataFrame:
    """Routes of pages with images, where there is a recognition engine and an image editor."""
    q = quality.page_quality(_lines(spark, d), visuals.page_areas(_pages(spark, d)))
    return quality.route(q, ocr=True, can_edit=True).select("doc_id", "page", F.round("image_ratio", 6).alias("image_ratio"), "mode")


def drawn_grids(spark: SparkSession, d: str) -> DataFrame:
    """``table_grids`` from the drawings that an extractor gives."""
    g = grids.detect_grids(visuals.drawings(_pages(spark, d, _tables(spark, d)[1])))
    return g.select("doc_id", "page", "grid_ord", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"), F.size("xs").alias("n_xs"), F.round(F.get("xs", 0), 6).alias("x_first"))


def run_report(spark: SparkSession, d: str) -> DataFrame:
    """A whole run over all documents, with a backend that echoes."""
    out = translate_documents(_lines(spark, d), translate.EchoBackend("de"), Options(LATIN, "German"))
    each = F.flatten(F.transform("pages", lambda p: p["units"]))
    chars = F.aggregate(each, F.lit(0).cast("long"), lambda n, u: n + F.length(u["translation"]))
    return out.select("doc_id", F.size("pages").cast("long").alias("pages"), F.size(each).cast("long").alias("units"), chars.alias("chars"), F.size(F.filter(each, lambda u: u["error"].isNotNull())).cast("long").alias("lost"))


def cell_fit(spark: SparkSession, d: str) -> DataFrame:
    """The sizes at which table cells take twice their text."""
    rows, rules = _tables(spark, d)
    cells = segment.segment(rows, LATIN, grids.detect_grids(rules)).filter("kind = 'table_cell'").withColumn("translation", F.concat(F.col("text"), F.lit(" "), F.col("text")))
    return fit.plan_fit(cells).select("doc_id", "unit_id", F.round("final_size", 4).alias("final_size"), F.size("fitted").alias("n_fitted"), F.col("warning").isNotNull().alias("warned"))


def lines_put_back(spark: SparkSession, d: str) -> DataFrame:
    """The lines that a run leaves as they are, with their size, where the vowels of every third line are Japanese, the source language."""
    ln = _lines(spark, d).withColumn("text", F.when(F.col("ord") % 3 == 0, F.translate("text", "aeo", "日ア本")).otherwise(F.col("text")))
    placed = segment.segment(ln, "Japanese").withColumn("translation", F.col("text"))
    return kept_lines(ln, placed).select("doc_id", "page", "ord", F.sha2("text", 256).alias("text_sha"), "bbox.*", "final_size")


def _rasters(spark: SparkSession, d: str) -> DataFrame:
    """A picture of every document: its bytes as colours, 16 pixels to a row."""
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "utf-8").alias("raw"))
    t = t.withColumn("height", F.expr("CAST(greatest(1, ceil(octet_length(raw) / 48)) AS INT)"))
    return t.select(F.col("doc_id").cast("string").alias("id"), F.lit(16).alias("width"), "height", F.expr("rpad(raw, height * 48, X'00')").alias("pixels"))


def _holes(spark: SparkSession, d: str) -> DataFrame:
    """Two regions of each picture, some of which reach its edges or overlap."""
    k, h = F.col("id").cast("long"), F.col("height")
    at = lambda n, x0, y0, x1, y1: F.struct(F.lit(n).alias("region_id"), *[v.cast("int").alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))])
    both = F.array(at("a", k % 5, k % 4, 16 - k % 3, h - k % 2), at("b", F.lit(3), h - 2 - k % 7, F.lit(9), h - 1))
    r = _rasters(spark, d).select("id", F.inline(both))
    return r.withColumn("y0", F.greatest(F.lit(0), "y0")).withColumn("y1", F.greatest(F.lit(0), "y1"))


def border_colors(spark: SparkSession, d: str) -> DataFrame:
    """The colour beside each region of each picture."""
    return rasters.border_colors(_rasters(spark, d), _holes(spark, d), 64).select("id", "region_id", "r", "g", "b", "samples")


def scaled_rasters(spark: SparkSession, d: str) -> DataFrame:
    """Every picture with no side over 24 pixels."""
    return rasters.scaled(_rasters(spark, d), 24, 64).select("id", "width", "height", F.sha2("pixels", 256).alias("pixels_sha"))


def erased_rasters(spark: SparkSession, d: str) -> DataFrame:
    """Every picture with its regions filled by the colour beside them."""
    pictures, holes = _rasters(spark, d), _holes(spark, d)
    out = rasters.erased(pictures, holes, rasters.border_colors(pictures, holes, 64))
    return out.select("id", "width", "height", F.sha2("pixels", 256).alias("pixels_sha"))


FUNCTIONS = [
    source_lines_by_lang, page_quality_score, extraction_route, document_profile, paragraph_units, unit_kinds, dominant_style, cache_keys, cache_hit_miss, call_batches, cache_upsert,
    dedupe_savings, missing_ids, text_collisions, rule_crossings, outside_safe, uncovered_lines, decoration_rules, page_verdict, document_verdict, table_grids, grid_cells, merged_rows,
    region_page_boxes, json_repair, image_regions, fit_plan, model_catalog, image_model_catalog, target_languages, aspect_ratios, ocr_codes, recognized_text, extractor_payload, page_boxes,
    page_components, inspection_report, styled_units, page_images, drawn_grids, run_report, source_scripts, merged_rows_in_sql, border_colors, scaled_rasters, erased_rasters, cell_fit, lines_put_back,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in FUNCTIONS}
