"""Text as columns: stripping, scripts, fragments, keys, and the cleaning of model replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character ranges by the word that names a language, tested in this order; then Latin.
SCRIPTS = (
    (("japanese",), "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff]"),
    (("chinese",), "[\\u3400-\\u9fff]"),
    (("korean",), "[\\uac00-\\ud7af]"),
    (("arabic",), "[\\u0600-\\u06ff]"),
    (("russian", "ukrainian"), "[\\u0400-\\u04ff]"),
    (("thai",), "[\\u0e00-\\u0e7f]"),
    (("hindi", "devanagari"), "[\\u0900-\\u097f]"),
    (("tamil",), "[\\u0b80-\\u0bff]"),
    (("telugu",), "[\\u0c00-\\u0c7f]"),
    (("malayalam",), "[\\u0d00-\\u0d7f]"),
    (("kannada",), "[\\u0c80-\\u0cff]"),
)
CJK = SCRIPTS[0][1]
LATIN = "[A-Za-z\\u00c0-\\u00ff]"
#: Codes of the recognition engines by a part of the language's name, tested in this order.
OCR_CODES = (
    ("simplified chinese", "ch"), ("traditional chinese", "chinese"), ("chinese", "chinese"), ("japanese", "japan"), ("korean", "korean"), ("arabic", "arabic"),
    ("hindi", "hindi"), ("tamil", "tamil"), ("telugu", "telugu"), ("malayalam", "malayalam"), ("kannada", "kannada"), ("thai", "thai"),
)
#: Language packs by code.
OCR_PACKS = {
    "japan": "jpn+eng", "ch": "chi_sim+eng", "chinese": "chi_tra+eng", "korean": "kor+eng", "arabic": "ara+eng", "hindi": "hin+eng",
    "tamil": "tam+eng", "telugu": "tel+eng", "malayalam": "mal+eng", "kannada": "kan+eng", "thai": "tha+eng", "latin": "eng",
}
#: Labels of the extraction modes, and the version that stands in every cache key.
MODES = {"Auto (MuPDF → OCR when needed)": "auto", "Native MuPDF only": "native", "OCR": "ocr"}
KEY_VERSION = "v9-tablecells"

WHITE = "[\\s\\x1c-\\x1f\\x85]"
NOT_WHITE = "[^\\s\\x1c-\\x1f\\x85]"
#: The characters of ``WHITE`` one by one.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Both ends without Unicode white space (U+001C to U+001F included)."""
    return F.trim(c, F.lit(BLANKS))


def not_blank(c: Column) -> Column:
    """Whether something is left of a text when it is stripped; looks no further than to the first such character."""
    return c.rlike(f"(?U){NOT_WHITE}")


def words(c: Column) -> Column:
    """Parts between white space, none of them empty."""
    return F.filter(F.split(c, f"(?U){WHITE}+"), lambda w: w != "")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def is_source_text(text: Column, language: str | None) -> Column:
    """Whether a text has a character of the language's script; blank: false."""
    name = (language or "").lower()
    pattern = next((p for keys, p in SCRIPTS if any(k in name for k in keys)), LATIN)
    return text.rlike(pattern)  # no range holds white space


def join_fragments(parts: Column) -> Column:
    """Stripped parts from left to right: one blank between, none from the first on that has CJK characters, nor before it."""
    bound = lambda c, f: F.get(F.transform(F.array(c), f), 0)  # noqa: E731  computed once

    def glued(kept: Column, joined: Column) -> Column:
        first = F.greatest(F.array_position(F.transform(kept, has_cjk), True).cast("int"), F.lit(1))
        return F.when(~has_cjk(joined), joined).otherwise(F.concat(F.array_join(F.slice(kept, 1, first - 1), " "), F.array_join(F.slice(kept, first, F.size(kept)), "")))

    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    return bound(kept, lambda k: bound(F.array_join(k, " "), lambda j: glued(k, j)))


def joined(parts: list[str | None]) -> str:
    """``join_fragments`` for parts at hand."""
    kept = [s for p in parts if p and (s := p.strip())]
    text = " ".join(kept)
    if not re.search(CJK, text):
        return text
    first = next(i for i, p in enumerate(kept) if re.search(CJK, p))
    return " ".join(kept[:first]) + "".join(kept[first:])


def ocr_code(language: Column) -> Column:
    s = F.lower(strip(F.coalesce(language, F.lit(""))))
    out = F.when(F.lit(False), F.lit(""))
    for part, code in OCR_CODES:
        out = out.when(s.contains(part), code)
    return out.otherwise("latin")


def ocr_pack(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in OCR_PACKS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit("eng"))


def mode(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), F.lit("auto"))


def cache_key(text: Column, source: Column, target: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(KEY_VERSION), source, target, model, text), 256)


def normalize_id(c: Column) -> Column:
    """Stripped, then without backticks around, then stripped."""
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "^`+|`+$", ""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


#: The parts of a JSON text: strings, brackets and marks, words and numbers, white space; any other character stands alone.
#: Strings are taken without a way back, which keeps the stack flat however long they are.
JSON_PART = r'"(?:[^"\\]|\\.)*+"|[{}\[\],:]|[^\s"{}\[\],:]+|\s+|.'


def strip_fences(c: Column) -> Column:
    """The part from the first { to the last }, without a Markdown fence or prose around; other text as it is."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)^[^{]*(\{.*\})[^}]*$", "$1"))


def repair(c: Column) -> Column:
    """Puts a comma wherever a value ends and the next thing begins another one. Strings are taken whole, so what stands in them stays."""
    parts = F.filter(F.regexp_extract_all(strip_fences(c), F.lit(f"(?s){JSON_PART}"), F.lit(0)), lambda p: F.trim(p, F.lit(" \t\r\n")) != "")

    def joined(p: Column) -> Column:
        ends = lambda x: ~x.isin("{", "[", ",", ":")
        begins = lambda x: ~x.isin("}", "]", ",", ":")
        glued = F.transform(p, lambda x, i: F.when((i > 0) & ends(F.get(p, i - 1)) & begins(x), F.concat(F.lit(","), x)).otherwise(x))
        return F.array_join(glued, "")

    return F.array_join(F.transform(F.array(parts), joined), "")  # a transform of one element binds it


def repaired(text: str) -> str:
    """``repair`` for one text at hand."""
    out: list[str] = []
    for part in re.findall(JSON_PART, text, re.S):
        if part.strip(" \t\r\n"):
            if out and out[-1] not in ("{", "[", ",", ":") and part not in ("}", "]", ",", ":"):
                out.append(",")
            out.append(part)
    return "".join(out)


def parse_reply(c: Column, schema: str) -> Column:
    """from_json of the reply as it is, else repaired; null if neither is an object. What follows a complete object does no harm."""
    raw = strip_fences(c)
    good = lambda t: F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), F.from_json(t, schema))
    return F.coalesce(good(raw), good(repair(raw)), F.when(raw.startswith("{"), F.from_json(F.regexp_extract(raw, r"(?s)^(\{.*?\})\s*(?:[^\s,\]\}].*)?$", 1), schema)))


def parse_error(c: Column, schema: str, preview: int = 200) -> Column:
    """Why a reply has no object, with the beginning of it; null if it has one."""
    blank = strip(F.coalesce(c, F.lit(""))) == ""
    bad = F.concat(F.lit("no JSON object in the reply: "), F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), 1, preview))
    return F.when(parse_reply(c, schema).isNull(), F.when(blank, F.lit("the reply is empty")).otherwise(bad))


def message_text(content: Column) -> Column:
    """JSON of a message's content: a string as it is, a list of parts by their texts, anything else as text."""
    v = F.try_parse_json(content)
    kind = F.schema_of_variant(v)
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "")
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY"), joined).when(content.isNull() | (kind == "VOID"), F.lit("")).otherwise(content)
