"""Schemas of positioned text. Every page-level table is keyed by (doc_id, page)."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])

SPAN = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("bbox", BOX),
        T.StructField("font", T.StringType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("color", T.IntegerType()),
        T.StructField("flags", T.IntegerType()),
    ]
)

LINE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", BOX),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)

#: Blocks of a page as a text extractor gives them, before any cleaning.
RAW_PAGE = T.StructType(
    [
        T.StructField(
            "blocks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.IntegerType()),
                        T.StructField(
                            "lines",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("bbox", T.ArrayType(T.DoubleType())),
                                        T.StructField(
                                            "spans",
                                            T.ArrayType(
                                                T.StructType(
                                                    [
                                                        T.StructField("text", T.StringType()),
                                                        T.StructField("bbox", T.ArrayType(T.DoubleType())),
                                                        T.StructField("font", T.StringType()),
                                                        T.StructField("size", T.DoubleType()),
                                                        T.StructField("color", T.IntegerType()),
                                                        T.StructField("flags", T.IntegerType()),
                                                    ]
                                                )
                                            ),
                                        ),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)

CACHE = T.StructType([T.StructField(c, T.StringType(), False) for c in ("cache_key", "source_text", "source_language", "target_language", "model", "translation")])

#: One page of a document with what an extractor knows of it.
PAGE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("image_count", T.IntegerType()),
        T.StructField("drawing_count", T.IntegerType()),
    ]
)
