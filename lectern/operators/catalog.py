"""Model catalogs: which models can serve, in the order in which they are offered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages that can be chosen.
LANGUAGES = (
    "Japanese", "English", "Chinese", "Korean", "French", "German", "Spanish", "Italian", "Portuguese", "Russian", "Arabic",
    "Hindi", "Tamil", "Telugu", "Malayalam", "Kannada", "Thai", "Vietnamese", "Dutch", "Polish", "Ukrainian",
)
ENTRY = "data array<struct<id:string,name:string,architecture:struct<input_modalities:array<string>,output_modalities:array<string>>>>"


def read_catalog(payloads: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON payloads of a model service (one a row) -> id, name, inputs, outputs; unreadable ones give no rows. ``keep``: columns that stay, such as the service."""
    m = payloads.select(*keep, F.explode(F.from_json(column, ENTRY)["data"]).alias("m"))
    return m.select(*keep, "m.id", "m.name", F.col("m.architecture.input_modalities").alias("inputs"), F.col("m.architecture.output_modalities").alias("outputs"))


def _placed(rows: DataFrame, by: tuple[str, ...], *order: Column) -> DataFrame:
    """Numbers the rows of each catalog. One catalog has hundreds of rows; with ``by`` there may be any number of catalogs."""
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return rows.withColumn("place", F.row_number().over(window))


def chat_models(catalog: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """id, inputs, outputs (arrays) -> place, id, vision: text in and text out; missing lists allow all. Vision models first. ``by``: columns that name a catalog."""
    ins, outs = F.coalesce("inputs", F.array().cast("array<string>")), F.coalesce("outputs", F.array().cast("array<string>"))
    open_or = lambda a, x: (F.size(a) == 0) | F.array_contains(a, x)
    embedding = F.lower("id").contains("embedding") & ~F.array_contains(outs, "text")
    rows = catalog.filter((F.coalesce("id", F.lit("")) != "") & ~embedding & open_or(ins, "text") & open_or(outs, "text"))
    rows = rows.select(*by, "id", F.array_contains(ins, "image").alias("vision"))
    return _placed(rows, by, ~F.col("vision"), F.lower("id"), F.col("id")).select(*by, "place", "id", "vision")


def image_models(catalog: DataFrame, default: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """id, name, inputs, outputs -> place, id, name: image in and image out; the default first. ``by``: columns that name a catalog."""
    rows = catalog.filter((F.coalesce("id", F.lit("")) != "") & F.array_contains("inputs", "image") & F.array_contains("outputs", "image"))
    rows = rows.select(*by, "id", F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"))
    return _placed(rows, by, F.col("id") != default, F.lower("id"), F.col("id")).select(*by, "place", "id", "name")


def targets(languages: DataFrame, source: str | Column | None) -> DataFrame:
    """The languages that are left as targets; a source that is not known leaves all."""
    if source is None:
        return languages
    source = F.lit(source) if isinstance(source, str) else source
    return languages.filter(source.isNull() | (F.col("language") != source))
