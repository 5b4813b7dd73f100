"""The layout queries in SQL, written from what they mean and not from how they are computed."""

from __future__ import annotations

#: White space at both ends, as the engine strips it.
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{0b}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


LINES = """
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, CAST(n // 50 AS INT) AS page, CAST(n % 50 AS INT) AS ord, text, 50.0::DOUBLE AS x0, 40.0::DOUBLE + 18.0::DOUBLE * (n % 50) AS y0,
    50.0::DOUBLE + least(450.0::DOUBLE, length(text) * 6.0::DOUBLE) AS x1, 40.0::DOUBLE + 18.0::DOUBLE * (n % 50) + 10 AS y1
  FROM raw)"""
RULES = """
rules AS (
  SELECT * FROM (
    SELECT doc_id, page, ord,
      CASE WHEN ord % 3 = 0 THEN x0 WHEN ord % 5 = 0 THEN x0 WHEN ord % 7 = 0 THEN (x0 + x1) / 2 END AS x0,
      CASE WHEN ord % 3 = 0 THEN y0 + 5 WHEN ord % 5 = 0 THEN y1 + 1 WHEN ord % 7 = 0 THEN y0 - 5 END AS y0,
      CASE WHEN ord % 3 = 0 THEN x1 WHEN ord % 5 = 0 THEN x1 WHEN ord % 7 = 0 THEN (x0 + x1) / 2 + 1 END AS x1,
      CASE WHEN ord % 3 = 0 THEN y0 + 6 WHEN ord % 5 = 0 THEN y1 + 1.5 WHEN ord % 7 = 0 THEN y1 + 5 END AS y1
    FROM lines) WHERE x0 IS NOT NULL)"""
SOURCE = f"source AS (SELECT * FROM lines WHERE {strip('text')} <> '' AND regexp_matches(text, '[A-Za-z\\x{{c0}}-\\x{{ff}}]'))"
ITEMS = f"items AS (SELECT doc_id, page, ord, {strip('text')} AS text, x0, y0, x1, y1 FROM lines WHERE {strip('text')} <> '')"
#: Two spans a line: three letters at 20 points, the rest at 10 or 12. The longer one is the line's size, the first of equals.
STYLED = """
styled AS (SELECT s.* REPLACE (CASE WHEN ord % 5 = 0 THEN x0 + 30 ELSE x0 END AS x0), CASE WHEN ord % 4 = 3 THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END AS rest FROM source s),
sized AS (SELECT *, CASE WHEN least(3, length(text)) >= length(text) - 3 THEN 20.0::DOUBLE ELSE rest END AS size FROM styled),
seq AS (SELECT *, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(size) OVER w AS psize, row_number() OVER w - 1 AS k FROM sized WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, ord)),
starts AS (
  SELECT *, CASE WHEN px0 IS NOT NULL AND abs(psize - size) <= 0.8 AND (
      (py0 < 285 AND y0 < 285 AND px1 - px0 > 150 AND (px0 + px1) / 2 > 160 AND (px0 + px1) / 2 < 435 AND x1 - x0 > 150 AND (x0 + x1) / 2 > 160 AND (x0 + x1) / 2 < 435 AND y0 - py1 <= 30)
      OR (y0 - py1 BETWEEN 3 AND 12 AND NOT (py0 < 215 AND y0 < 215) AND px1 - px0 >= 300 AND x1 - x0 >= 300 AND abs(px0 - x0) <= 25)) THEN 0 ELSE 1 END AS s
  FROM seq),
blocks AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS block FROM starts),
spans AS (SELECT doc_id, page, block, k, 1 AS i, least(3, length(text)) AS n, 20.0::DOUBLE AS size FROM blocks UNION ALL SELECT doc_id, page, block, k, 2, greatest(0, length(text) - 3), rest FROM blocks),
style AS (SELECT doc_id, page, block, arg_min(size, (-n, k, i)) AS size FROM spans GROUP BY doc_id, page, block)"""
UNITS = f"""
seq AS (SELECT *, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, row_number() OVER w - 1 AS k FROM source WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, ord)),
starts AS (
  SELECT *, CASE WHEN px0 IS NOT NULL AND (
      (py0 < 285 AND y0 < 285 AND px1 - px0 > 150 AND (px0 + px1) / 2 > 160 AND (px0 + px1) / 2 < 435 AND x1 - x0 > 150 AND (x0 + x1) / 2 > 160 AND (x0 + x1) / 2 < 435 AND y0 - py1 <= 30)
      OR (y0 - py1 BETWEEN 3 AND 12 AND NOT (py0 < 215 AND y0 < 215) AND px1 - px0 >= 300 AND x1 - x0 >= 300 AND abs(px0 - x0) <= 25)) THEN 0 ELSE 1 END AS s
  FROM seq),
blocks AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS block FROM starts),
agg AS (
  SELECT doc_id, page, block, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, chr(10) ORDER BY k) AS t,
    max(x1 - x0) AS widest, avg((x0 + x1) / 2) AS mid, min_by(x0, k) AS first_x0
  FROM blocks GROUP BY doc_id, page, block),
units AS (
  SELECT doc_id, page, CAST(block + 1 AS INT) AS unit_ord, printf('p%d_u%03d', page + 1, CAST(block + 1 AS INT)) AS unit_id, CAST(n_lines AS INT) AS n_lines, x0, y0, x1, y1, {strip("t")} AS text,
    CASE WHEN n_lines <= 2 AND widest > 148.75 AND abs(mid - 297.5) < 130.9 THEN 'title' WHEN n_lines = 1 AND widest < 267.75 AND first_x0 < 148.75 THEN 'heading'
      WHEN n_lines >= 3 AND widest >= 267.75 THEN 'paragraph' WHEN length(t) < 90 THEN 'label' ELSE 'paragraph' END AS kind
  FROM agg)"""
KEYS = "keyed AS (SELECT doc_id, text, sha256('v9-tablecells|French|English|m|' || text) AS cache_key FROM documents WHERE text IS NOT NULL)"
CACHE = """
old AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '?' END AS text FROM documents WHERE text IS NOT NULL),
cache AS (SELECT sha256('v9-tablecells|French|English|m|' || text) AS cache_key, CASE WHEN min(doc_id) % 20 = 0 THEN '' ELSE 'T: ' || text END AS translation FROM old GROUP BY text)"""
QUALITY = f"""
q AS (
  SELECT doc_id, page, CAST(sum(length(t)) AS BIGINT) AS chars, count(*) FILTER (t <> '') AS lines, least(1.0, sum(a) / (595.0::DOUBLE * 842.0::DOUBLE)) AS area_ratio,
    1.0::DOUBLE - count(DISTINCT t) FILTER (t <> '') / greatest(1, count(*) FILTER (t <> '')) AS duplicate_ratio
  FROM (SELECT doc_id, page, {strip("text")} AS t, (x1 - x0) * (y1 - y0) AS a FROM lines) GROUP BY doc_id, page),
scored AS (
  SELECT *, (CASE WHEN chars >= 30 THEN 0.55::DOUBLE ELSE 0 END) + (CASE WHEN lines >= 3 THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN area_ratio >= 0.0003 THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN duplicate_ratio < 0.25 THEN 0.1::DOUBLE ELSE 0 END) AS score FROM q)"""
CROSSINGS = """
crossings AS (
  SELECT doc_id, page, ord, rule, type FROM (
    SELECT b.doc_id, b.page, b.ord, r.ord AS rule,
      CASE WHEN r.y1 - r.y0 <= 2 AND r.x1 - r.x0 >= 20 THEN
          CASE WHEN (r.y0 + r.y1) / 2 > b.y0 + 0.18 * (b.y1 - b.y0) AND (r.y0 + r.y1) / 2 < b.y1 - 0.18 * (b.y1 - b.y0)
            AND greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) > 0.35 * least(r.x1 - r.x0, b.x1 - b.x0) THEN 'horizontal-line-crossing-text' END
        WHEN r.x1 - r.x0 <= 2 AND r.y1 - r.y0 >= 10 THEN
          CASE WHEN (r.x0 + r.x1) / 2 > b.x0 + 0.12 * (b.x1 - b.x0) AND (r.x0 + r.x1) / 2 < b.x1 - 0.12 * (b.x1 - b.x0)
            AND greatest(0, least(r.y1, b.y1) - greatest(r.y0, b.y0)) > 0.35 * least(r.y1 - r.y0, b.y1 - b.y0) THEN 'vertical-line-crossing-text' END END AS type
    FROM items b JOIN rules r USING (doc_id, page) WHERE r.x1 - r.x0 >= 20 OR r.y1 - r.y0 >= 20) WHERE type IS NOT NULL)"""
OUTSIDE = """
outside AS (
  SELECT i.doc_id, i.page, e.ord AS id, i.ord FROM items i JOIN (
    SELECT doc_id, page, ord, text, x0 - 0.5 - n AS x0, y0 - 0.5 AS y0, x1 + 0.5 - n AS x1, y1 + 0.5 AS y1 FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN 30 ELSE 0 END AS n FROM items)) e USING (doc_id, page)
  WHERE (contains(i.text, substr(e.text, 1, 20)) OR contains(e.text, i.text)) AND NOT (e.x0 <= i.x0 AND e.y0 <= i.y0 AND i.x1 <= e.x1 AND i.y1 <= e.y1))"""
VERDICT = """
marks AS (
  SELECT doc_id, page, 'i' AS k FROM items
  UNION ALL SELECT a.doc_id, a.page, 't' FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord < b.ord WHERE least(a.y1, b.y1) > greatest(a.y0, b.y0)
  UNION ALL SELECT doc_id, page, 'd' FROM crossings UNION ALL SELECT doc_id, page, 'o' FROM outside),
verdicts AS (
  SELECT doc_id, page, count(*) FILTER (k = 'i') AS text_count, count(*) FILTER (k = 't') AS text_text, count(*) FILTER (k = 'd') AS text_drawing, count(*) FILTER (k = 'o') AS outside,
    count(*) FILTER (k <> 'i') = 0 AS pass FROM marks GROUP BY doc_id, page)"""
#: Bands of the table fixture: rules 4 points over every fourth line that is not blank; lines are at least 72 points apart, so no two rules cluster.
GRIDS = f"""
full_lines AS (SELECT * FROM lines WHERE {strip("text")} <> ''),
ys AS (SELECT DISTINCT doc_id, page, y0 - 4 AS y FROM full_lines WHERE ord % 4 = 0),
bands AS (SELECT doc_id, page, y AS top, lead(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS bottom FROM ys),
reach AS (SELECT doc_id, page, max(y1) + 20 AS y1 FROM full_lines GROUP BY doc_id, page)"""


LANGUAGES = "['Japanese','English','Chinese','Korean','French','German','Spanish','Italian','Portuguese','Russian','Arabic','Hindi','Tamil','Telugu','Malayalam','Kannada','Thai','Vietnamese','Dutch','Polish','Ukrainian']"
#: Parts of each brand as models, by the rules of the fixture.
MODELS = """
models AS (
  SELECT p_brand AS service, p_name, p_partkey % 3 = 0 AS unnamed, p_size % 5 AS i, p_size % 3 AS o, p_size % 3 = 2 AND p_size % 7 = 0 AS vectors,
    CASE WHEN p_partkey % 50 = 7 THEN '' ELSE (CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END) || '/' || (CASE WHEN p_partkey % 9 = 0 THEN 'embedding-' ELSE replace(p_name, ' ', '-') END) || p_partkey END AS id
  FROM part)"""
#: The letters of the fixture and the characters of each language's script.
SCRIPTS = [
    ("Japanese", "ア", r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"), ("Chinese", "本", r"\x{3400}-\x{9fff}"), ("Korean", "가", r"\x{ac00}-\x{d7af}"), ("Arabic", "ا", r"\x{600}-\x{6ff}"),
    ("Russian", "д", r"\x{400}-\x{4ff}"), ("Ukrainian", "ї", r"\x{400}-\x{4ff}"), ("Thai", "ก", r"\x{e00}-\x{e7f}"), ("Hindi", "अ", r"\x{900}-\x{97f}"), ("Tamil", "அ", r"\x{b80}-\x{bff}"),
    ("Telugu", "అ", r"\x{c00}-\x{c7f}"), ("Malayalam", "അ", r"\x{d00}-\x{d7f}"), ("Kannada", "ಅ", r"\x{c80}-\x{cff}"),
]
CJK = f"[{SCRIPTS[0][2]}]"


#: Cells of the table fixture: the one inner border cuts a line's span at the blank nearest to its share of the characters.
CELLS = f"""
grids AS (SELECT doc_id, page, top, bottom FROM bands JOIN reach USING (doc_id, page) WHERE bottom - top >= 12 AND 36 <= top + 2 AND y1 >= bottom - 2),
kept AS (SELECT * FROM full_lines WHERE regexp_matches(text, '[A-Za-z\\x{{c0}}-\\x{{ff}}]')),
placed AS (
  SELECT l.*, g.top, g.bottom FROM kept l LEFT JOIN (
    SELECT l.doc_id, l.page, l.ord, min(top) AS top, min_by(bottom, top) AS bottom FROM kept l JOIN grids g ON l.doc_id = g.doc_id AND l.page = g.page AND (l.y0 + l.y1) / 2 BETWEEN top - 2 AND bottom + 2 GROUP BY ALL) g USING (doc_id, page, ord)),
share AS (SELECT *, length(text) AS n, CAST(greatest(1, least(length(text) - 1, round_even(length(text) * (150.0::DOUBLE / greatest(0.001, x1 - 50)), 0))) AS INT) AS guess FROM placed WHERE top IS NOT NULL),
snapped AS (
  SELECT *, coalesce(list_sort(list_transform(list_filter(range(1, n - 1), lambda i: regexp_matches(text[i + 1:i + 1], '{WS}')), lambda i: {{'d': abs(i - guess), 'i': i}}))[1]['i'], guess) AS cut FROM share),
pieces AS (
  SELECT doc_id, page, ord, y0, top, bottom, text AS t, x0, x1 FROM snapped WHERE n < 2 OR x1 <= 200
  UNION ALL SELECT doc_id, page, ord, y0, top, bottom, text[:cut], x0, x0 + (x1 - x0) * (cut / n) FROM snapped WHERE n >= 2 AND x1 > 200
  UNION ALL SELECT doc_id, page, ord, y0, top, bottom, text[cut + 1:], x0 + (x1 - x0) * (cut / n), x1 FROM snapped WHERE n >= 2 AND x1 > 200),
cells AS (
  SELECT doc_id, page, ord, y0, top, bottom, c0, c1, string_agg(t, '' ORDER BY x0) AS t FROM pieces, (VALUES (50.3::DOUBLE, 200.0::DOUBLE), (200.0, 500.0)) c(c0, c1)
  WHERE (x0 + x1) / 2 >= c0 - 1 AND (x0 + x1) / 2 <= c1 + 1 GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0 / 2, 0) * 2, c0, top) AS k FROM cells),
held AS (SELECT doc_id, page, count(*) AS cells FROM cells GROUP BY ALL),
source AS (SELECT doc_id, page, ord, text, x0, y0, x1, y1 FROM placed WHERE top IS NULL)"""
#: Lines that a text takes at each size that is tried, word by word; a word wider than the place goes on character by character.
#: A token joins a line after a blank (0), opens one (1), or follows without a blank (2).
SIZES = [10.0]
while SIZES[-1] - 0.15 >= 9.0 - 1e-6:
    SIZES.append(SIZES[-1] - 0.15)
FITS = f"""
adv AS (SELECT unnest({{advances}}) AS w, unnest(range(32, 127)) AS code),
doubled AS (SELECT doc_id, unit_id, n_lines, greatest(8, x1 - x0) AS width, y1 - y0 AS height, {strip("text || ' ' || text")} AS t FROM units),
word AS (SELECT doc_id, unit_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT *, list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> '') AS w FROM doubled)),
letters AS (SELECT doc_id, unit_id, i, unnest(string_split(word, '')) AS c, unnest(range(length(word))) AS j FROM word),
wide AS (SELECT l.doc_id, l.unit_id, l.i, l.j, coalesce(adv.w, 556) AS w FROM letters l LEFT JOIN adv ON adv.code = unicode(l.c)),
whole AS (SELECT doc_id, unit_id, i, sum(w) AS w FROM wide GROUP BY ALL),
tried AS (SELECT d.*, size, (1000 * width) / size AS room FROM doubled d, (SELECT unnest({SIZES}) AS size)),
tokens AS (
  SELECT doc_id, unit_id, size, i, 0 AS j, w, 0 AS kind FROM tried JOIN whole USING (doc_id, unit_id) WHERE w <= room
  UNION ALL SELECT t.doc_id, t.unit_id, size, x.i, x.j, x.w, CASE WHEN x.j = 0 THEN 1 ELSE 2 END FROM tried t JOIN whole a USING (doc_id, unit_id) JOIN wide x USING (doc_id, unit_id) WHERE a.i = x.i AND a.w > room),
queue AS MATERIALIZED (SELECT doc_id, unit_id, size, w, kind, row_number() OVER (PARTITION BY doc_id, unit_id, size ORDER BY i, j) AS k FROM tokens),
steps AS (
  SELECT doc_id, unit_id, size, room, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS lines, CAST(0 AS HUGEINT) AS used FROM tried
  UNION ALL
  SELECT s.doc_id, s.unit_id, s.size, s.room, q.k, CASE WHEN joins THEN s.lines ELSE s.lines + 1 END, CASE WHEN joins THEN s.used + q.w + CASE WHEN q.kind = 0 THEN 278 ELSE 0 END ELSE q.w END
  FROM steps s JOIN queue q ON q.doc_id = s.doc_id AND q.unit_id = s.unit_id AND q.size = s.size AND q.k = s.k + 1,
    LATERAL (SELECT s.lines > 0 AND q.kind <> 1 AND s.used + q.w + CASE WHEN q.kind = 0 THEN 278 ELSE 0 END <= s.room AS joins)),
taken AS (SELECT doc_id, unit_id, size, arg_max(lines, k) AS lines FROM steps GROUP BY ALL),
good AS (
  SELECT doc_id, unit_id, max(size) AS size FROM taken JOIN doubled USING (doc_id, unit_id)
  WHERE lines > 0 AND lines <= n_lines AND lines * greatest(1, (1.075::DOUBLE - -0.299::DOUBLE) * size) * 1.02::DOUBLE <= height + 0.5 GROUP BY ALL)"""


PIXELS = """
d AS (SELECT doc_id, hex(encode(text)) AS hx, CAST(greatest(1, ceil(strlen(text) / 48)) AS INT) AS h FROM documents WHERE text IS NOT NULL),
px AS MATERIALIZED (
  SELECT doc_id, h, i // 48 AS y, (i % 48) // 3 AS x, i % 3 AS c, CASE WHEN 2 * i < length(hx) THEN CAST('0x' || substr(hx, CAST(2 * i + 1 AS BIGINT), 2) AS INT) ELSE 0 END AS v FROM (SELECT *, unnest(range(h * 48)) AS i FROM d)),
holes AS (
  SELECT doc_id, h, 'a' AS region_id, doc_id % 5 AS x0, doc_id % 4 AS y0, 16 - doc_id % 3 AS x1, greatest(0, h - doc_id % 2) AS y1 FROM d
  UNION ALL SELECT doc_id, h, 'b', 3, greatest(0, h - 2 - doc_id % 7), 9, greatest(0, h - 1) FROM d),
open AS (SELECT *, least(x1, x0 + greatest(1, (x1 - x0) // 8)) AS xr, least(y1, y0 + greatest(1, (y1 - y0) // 8)) AS yl FROM holes WHERE x1 > x0 AND y1 > y0),
beside AS (
  SELECT o.doc_id, region_id, c, v FROM px JOIN open o USING (doc_id)
  WHERE (y IN (y0 - 1, y1) AND x >= x0 AND x < xr) OR (x IN (x0 - 1, x1) AND y >= y0 AND y < yl)),
colors AS (SELECT doc_id, region_id, c, list_sort(list(v))[count(*) // 2 + 1] AS v, count(*) AS samples FROM beside GROUP BY ALL)"""


def _fits() -> str:
    from .functions.fonts import ADVANCES  # fixed values of a font

    return "WITH RECURSIVE " + ",\n".join([LINES, SOURCE, UNITS, FITS.replace("{advances}", str(ADVANCES))]) + f"""
SELECT doc_id, unit_id, round(coalesce(g.size, 9.0), 4) AS final_size, CAST(least(n_lines, t.lines) AS INT) AS n_fitted, g.size IS NULL AS warned
FROM doubled d LEFT JOIN good g USING (doc_id, unit_id) JOIN taken t ON t.doc_id = d.doc_id AND t.unit_id = d.unit_id AND t.size = coalesce(g.size, {SIZES[-1]})"""


#: Sizes of a cell that takes no size of the search: one line, ever smaller.
SHRUNK = [9.0]
while SHRUNK[-1] > 4.8:
    SHRUNK.append(SHRUNK[-1] - 0.1)


def _cell_fits() -> str:
    from .functions.fonts import ADVANCES  # fixed values of a font

    cells = f"units AS (SELECT doc_id, printf('p%d_t%03d', page + 1, k) AS unit_id, 1 AS n_lines, {strip('t')} AS text, c0 + 12 AS x0, c1 AS x1, top + 5 AS y0, bottom AS y1 FROM numbered)"
    tried = FITS.replace("{advances}", str(ADVANCES)).replace("greatest(8, x1 - x0) AS width", "x1 - x0 AS width")
    start = tried.index("good AS (")
    good = "good AS (SELECT doc_id, unit_id, max(size) AS size FROM taken JOIN doubled USING (doc_id, unit_id) WHERE lines > 0 AND lines * (1.075::DOUBLE - -0.299::DOUBLE) * size * 1.05::DOUBLE <= height GROUP BY ALL)"
    length = "length AS (SELECT doc_id, unit_id, sum(coalesce(w, 556)) AS w FROM (SELECT doc_id, unit_id, unnest(string_split(t, '')) AS c FROM doubled WHERE t <> '') l LEFT JOIN adv ON adv.code = unicode(l.c) GROUP BY ALL)"
    return "WITH RECURSIVE " + ",\n".join([LINES, GRIDS, CELLS, cells, tried[:start] + good, length]) + f"""
SELECT doc_id, unit_id, round(coalesce(g.size, list_filter({SHRUNK}, lambda s: s <= 4.8 OR s * coalesce(n.w, 0) / 1000 <= width)[1]), 4) AS final_size,
  CAST(CASE WHEN g.size IS NULL THEN 1 ELSE t.lines END AS INT) AS n_fitted, g.size IS NULL AS warned
FROM doubled d LEFT JOIN good g USING (doc_id, unit_id) LEFT JOIN length n USING (doc_id, unit_id) LEFT JOIN taken t ON t.doc_id = d.doc_id AND t.unit_id = d.unit_id AND t.size = g.size"""


def _scripts() -> str:
    letter = "CASE ord % 13 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c, _) in enumerate(SCRIPTS)) + " END"
    kinds = [(n, f"{strip('t')} <> '' AND regexp_matches(t, '[{p}]')") for n, _, p in SCRIPTS] + [("English", f"{strip('t')} <> '' AND regexp_matches(t, '[A-Za-z\\x{{c0}}-\\x{{ff}}]')"), ("any_cjk", f"regexp_matches(t, '{CJK}')")]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS language, count(*) FILTER ({test}) AS lines FROM t" for n, test in kinds)
    text = "CASE WHEN c IS NULL THEN text WHEN page % 2 = 0 THEN replace(text, 'e', c) ELSE c || regexp_replace(text, '[A-Za-z\\x{c0}-\\x{ff}]', '', 'g') END"
    return _with(LINES, f"l AS (SELECT *, {letter} AS c FROM lines)", f"t AS MATERIALIZED (SELECT {text} AS t FROM l)") + rows


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def oracle_sql() -> dict[str, str]:
    return {
        "source_lines_by_lang": _with(LINES, SOURCE)
        + "SELECT lang, count(*) AS n_lines, count(s.doc_id) AS n_source FROM lines l LEFT JOIN source s USING (doc_id, page, ord) JOIN documents d ON d.doc_id = l.doc_id GROUP BY lang",
        "page_quality_score": _with(LINES, QUALITY) + "SELECT doc_id, page, chars, lines, round(area_ratio, 6) AS area_ratio, round(duplicate_ratio, 6) AS duplicate_ratio, round(score, 6) AS score FROM scored",
        "extraction_route": _with(LINES, QUALITY)
        + "SELECT doc_id, page, CASE WHEN chars >= 20 THEN 'native' WHEN lines > 0 THEN 'native-fallback' ELSE 'error' END AS mode, CASE WHEN chars >= 20 OR lines > 0 THEN round(score, 6) END AS confidence FROM scored",
        "document_profile": _with(LINES, f"pg AS (SELECT doc_id, page, {strip('string_agg(text, chr(10) ORDER BY ord)')} AS t FROM lines GROUP BY doc_id, page)")
        + "SELECT CAST(doc_id AS VARCHAR) AS file, count(*) AS page_count, CAST(sum(length(t)) AS BIGINT) AS text_chars, CASE WHEN bool_or(t <> '') THEN 'native-text' ELSE 'ocr-required' END AS recommended_pipeline FROM pg GROUP BY doc_id",
        "paragraph_units": _with(LINES, SOURCE, UNITS) + "SELECT doc_id, unit_id, n_lines, x0, y0, x1, y1, sha256(text) AS text_sha FROM units",
        "unit_kinds": _with(LINES, SOURCE, UNITS) + "SELECT kind, n_lines, count(*) AS n FROM units GROUP BY kind, n_lines",
        "dominant_style": _with(LINES) + "SELECT doc_id, page, CAST(arg_min(ord, (-length(text), ord)) AS VARCHAR) AS ord FROM lines GROUP BY doc_id, page",
        "cache_keys": _with(KEYS) + "SELECT doc_id, cache_key FROM keyed",
        "cache_hit_miss": _with(KEYS, CACHE) + "SELECT doc_id, coalesce(translation, '') <> '' AS hit, sha256(nullif(translation, '')) AS cached_sha FROM keyed LEFT JOIN cache USING (cache_key)",
        "call_batches": _with(LINES, SOURCE, UNITS) + "SELECT doc_id, unit_id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY page, unit_ord) - 1) // 4 AS INT) AS batch FROM units",
        "cache_upsert": _with(KEYS, CACHE, "new AS (SELECT cache_key, 'new ' || max(doc_id) AS translation FROM keyed GROUP BY cache_key)")
        + "SELECT cache_key, sha256(coalesce(new.translation, cache.translation)) AS translation_sha FROM cache FULL JOIN new USING (cache_key)",
        "dedupe_savings": "SELECT count(*) AS units, count(DISTINCT text) AS calls FROM documents",
        "missing_ids": _with(LINES, SOURCE, UNITS) + "SELECT doc_id, unit_id FROM units WHERE unit_id LIKE '%3'",
        "text_collisions": _with(LINES, ITEMS, "grown AS (SELECT doc_id, page, ord, x0 - 6 AS x0, y0 - 6 AS y0, x1 + 6 AS x1, y1 + 6 AS y1 FROM items)")
        + """, p AS (SELECT a.doc_id, a.page, a.ord AS a, b.ord AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area,
  least(greatest(1, (a.x1 - a.x0) * (a.y1 - a.y0)), greatest(1, (b.x1 - b.x0) * (b.y1 - b.y0))) AS least_area
FROM grown a JOIN grown b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord < b.ord)
SELECT doc_id, page, a, b, round(area, 6) AS area FROM p WHERE area > 0.4 AND area / least_area > 0.12""".replace(", p AS", "SELECT * FROM (WITH p AS", 1)
        + ")",
        "rule_crossings": _with(LINES, RULES, ITEMS, CROSSINGS) + "SELECT * FROM crossings",
        "outside_safe": _with(LINES, ITEMS, OUTSIDE) + "SELECT * FROM outside",
        "uncovered_lines": _with(LINES, "done AS (SELECT doc_id, page, x0, x1, y0 - n AS y0, y1 - n AS y1 FROM (SELECT *, CASE WHEN ord % 8 = 0 THEN 8 ELSE 0 END AS n FROM lines WHERE ord % 4 = 0))")
        + """SELECT doc_id, page, ord FROM lines l WHERE NOT EXISTS (SELECT 1 FROM done t WHERE t.doc_id = l.doc_id AND t.page = l.page
  AND greatest(0, least(l.x1, t.x1) - greatest(l.x0, t.x0)) * greatest(0, least(l.y1, t.y1) - greatest(l.y0, t.y0)) / greatest(1, (l.x1 - l.x0) * (l.y1 - l.y0)) > 0.55)""",
        "decoration_rules": _with(LINES, RULES)
        + """SELECT doc_id, page, ord FROM rules r WHERE y1 - y0 <= 1.5 AND x1 - x0 >= 25 AND EXISTS (SELECT 1 FROM lines t WHERE t.doc_id = r.doc_id AND t.page = r.page
  AND greatest(0, least(r.x1, t.x1) - greatest(r.x0, t.x0)) >= 0.55 * least(r.x1 - r.x0, t.x1 - t.x0) AND r.y0 >= t.y0 - 1.5 AND r.y0 <= t.y1 + 1.5)""",
        "page_verdict": _with(LINES, RULES, ITEMS, CROSSINGS, OUTSIDE, VERDICT) + "SELECT * FROM verdicts",
        "document_verdict": _with(LINES, RULES, ITEMS, CROSSINGS, OUTSIDE, VERDICT) + "SELECT doc_id, count(*) AS pages, bool_and(pass) AS validation_pass, count(*) FILTER (NOT pass) AS warnings FROM verdicts GROUP BY doc_id",
        "table_grids": _with(LINES, GRIDS)
        + "SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY top) - 1 AS INT) AS grid_ord, round(top, 6) AS top, round(bottom, 6) AS bottom, CAST(3 AS INT) AS n_xs, 50.3::DOUBLE AS x_first FROM bands JOIN reach USING (doc_id, page) WHERE bottom - top >= 12 AND 36 <= top + 2 AND y1 >= bottom - 2",
        "aspect_ratios": """WITH c AS (SELECT * FROM (VALUES (0, '1:1', 1, 1), (1, '4:5', 4, 5), (2, '3:4', 3, 4), (3, '2:3', 2, 3), (4, '9:16', 9, 16), (5, '16:9', 16, 9), (6, '3:2', 3, 2), (7, '5:4', 5, 4)) t(i, name, a, b)),
p AS (SELECT p_partkey AS id, p_size * 40 AS w, 1000 AS h FROM part)
SELECT id, arg_min(name, (abs(a / b - w / h), i)) AS aspect, CAST(any_value(greatest(1, trunc(w * (900.0::DOUBLE / greatest(w, h))))) AS INT) AS sent_w, CAST(any_value(greatest(1, trunc(h * (900.0::DOUBLE / greatest(w, h))))) AS INT) AS sent_h
FROM p, c GROUP BY id""",
        "page_boxes": _with(LINES)
        + """SELECT doc_id, page, ord, round(x0 - 0.3, 6) AS redact_x0, round(y1 + 0.4, 6) AS redact_y1, x1 + 0.5 AS safe_x1, round(y0 + 8.2, 6) AS baseline,
  greatest(x0, least((x0 + x1 - length(text) * 5.0) / 2, x1 - length(text) * 5.0)) AS x_mid, greatest(x0, x1 - length(text) * 5.0) AS x_right FROM lines""",
        "page_components": _with(LINES, RULES, SOURCE, UNITS)
        + """, u AS (SELECT doc_id, page, count(*) AS n FROM units GROUP BY doc_id, page), r AS (SELECT doc_id, page, count(*) AS n FROM rules GROUP BY doc_id, page)
SELECT l.doc_id, l.page, l.n AS lines, coalesce(u.n, 0) AS units, coalesce(r.n, 0) AS rules FROM (SELECT doc_id, page, count(*) AS n FROM lines GROUP BY doc_id, page) l LEFT JOIN u USING (doc_id, page) LEFT JOIN r USING (doc_id, page)""",
        "styled_units": _with(LINES, SOURCE, STYLED)
        + f"""SELECT doc_id, printf('p%d_u%03d', page + 1, CAST(block + 1 AS INT)) AS unit_id, CAST(count(*) AS INT) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, any_value(st.size) AS size,
  sha256({strip("string_agg(text, chr(10) ORDER BY k)")}) AS text_sha FROM blocks JOIN style st USING (doc_id, page, block) GROUP BY doc_id, page, block""",
        "page_images": _with(LINES, QUALITY, "n AS (SELECT doc_id, page, CASE WHEN count(*) <= 3 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS image_ratio FROM lines GROUP BY doc_id, page)")
        + """SELECT doc_id, page, round(image_ratio, 6) AS image_ratio, CASE WHEN image_ratio >= 0.72 AND chars < 80 THEN 'full-page'
  WHEN chars < 20 OR (chars < 80 AND image_ratio > 0.45 AND score < 0.75) THEN 'ocr' ELSE 'native' END AS mode FROM scored JOIN n USING (doc_id, page)""",
        "drawn_grids": _with(LINES, GRIDS)
        + "SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY top) - 1 AS INT) AS grid_ord, round(top, 6) AS top, round(bottom, 6) AS bottom, CAST(3 AS INT) AS n_xs, 50.3::DOUBLE AS x_first FROM bands JOIN reach USING (doc_id, page) WHERE bottom - top >= 12 AND 36 <= top + 2 AND y1 >= bottom - 2",
        "run_report": _with(LINES, SOURCE, UNITS)
        + "SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS units, CAST(sum(length(text) + 5) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS lost FROM units GROUP BY doc_id",
        "merged_rows": _with(LINES, f"w AS (SELECT doc_id, page, ord, y0, y1, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM lines)")
        + """SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0) - 1 AS INT) AS ord, sha256(array_to_string(w, ' ')) AS text_sha, CAST(len(w) AS INT) AS n_spans,
  50.0::DOUBLE AS x0, y0, 50.0::DOUBLE + (len(w) - 1) * 40 + 30 AS x1, y1 FROM w WHERE len(w) > 0""",
        "merged_rows_in_sql": _with(LINES, f"w AS (SELECT doc_id, page, ord, y0, y1, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM lines)")
        + """SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0) - 1 AS INT) AS ord, sha256(array_to_string(w, ' ')) AS text_sha, CAST(len(w) AS INT) AS n_spans,
  50.0::DOUBLE AS x0, y0, 50.0::DOUBLE + (len(w) - 1) * 40 + 30 AS x1, y1 FROM w WHERE len(w) > 0""",
        "region_page_boxes": _with(LINES)
        + """, v AS (
  SELECT doc_id, page, ord, length(text) AS n, y0, 100 + 10 * (length(text) % 40) AS w, 80 + 5 * (ord % 20) AS h, length(text) % 90 AS a, ord - 3 AS b,
    CASE WHEN ord % 5 = 0 THEN length(text) % 90 + 1 ELSE length(text) % 500 END AS c, 2 * ord + 9 AS d FROM lines WHERE ord % 11 <> 3),
k AS (SELECT *, least(least(w, c), greatest(0, a)) AS px0, least(least(h, d), greatest(0, b)) AS py0, greatest(least(w, c), greatest(0, a)) AS px1, greatest(least(h, d), greatest(0, b)) AS py1 FROM v)
SELECT doc_id, page, ord, round(40.0::DOUBLE + px0 * (n::DOUBLE / w), 6) AS x0, round(y0 + py0 * ((2.0::DOUBLE * ord) / h), 6) AS y0, round(40.0::DOUBLE + px1 * (n::DOUBLE / w), 6) AS x1, round(y0 + py1 * ((2.0::DOUBLE * ord) / h), 6) AS y1
FROM k WHERE px1 - px0 >= 2 AND py1 - py0 >= 2""",
        "json_repair": _with(LINES, SOURCE, UNITS, "b AS (SELECT *, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY page, unit_ord) - 1) // 4 AS INT) AS batch FROM units)")
        + "SELECT doc_id, batch, unit_id, sha256(text) AS translation_sha FROM b WHERE batch % 5 <> 4",
        "image_regions": _with(LINES)
        + f""", r AS (
  SELECT doc_id, page, ord, {strip("text")} AS t, 10 + ord AS a, least(100, 60 + ord) AS c, least(2 * ord, least(90, 2 * ord + CASE WHEN ord % 6 = 5 THEN 1 ELSE 8 END)) AS b,
    greatest(2 * ord, least(90, 2 * ord + CASE WHEN ord % 6 = 5 THEN 1 ELSE 8 END)) AS d FROM lines WHERE ord % 4 <> 3),
f AS (SELECT *, 2 * a AS fx0, least(200, 2 * c) AS fx1, least(2 * b, least(180, 2 * d)) AS fy0, greatest(2 * b, least(180, 2 * d)) AS fy1 FROM r WHERE t <> '' AND c - a >= 2 AND d - b >= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS n FROM f WHERE fy1 - fy0 >= 2 AND fx1 - fx0 >= 2),
p AS (SELECT n.*, occ FROM n, (VALUES (0), (1)) o(occ) WHERE occ = 0 OR (doc_id + page) % 3 = 0)
SELECT doc_id, printf('p%d_img7_%d_r%d', page + 1, occ, n) AS region_id, round(100.0::DOUBLE * occ + fx0 * 0.5::DOUBLE, 6) AS x0, round(10.0::DOUBLE + fy0 * ((90.0::DOUBLE + 90 * occ) / 180), 6) AS y0,
  round(100.0::DOUBLE * occ + fx1 * 0.5::DOUBLE, 6) AS x1, round(10.0::DOUBLE + fy1 * ((90.0::DOUBLE + 90 * occ) / 180), 6) AS y1, sha256(t) AS source_sha, 'T ' || ord AS translation,
  CASE WHEN ord % 5 = 0 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, ord / 10.0::DOUBLE), 6) END AS confidence FROM p""",
        "model_catalog": _with(MODELS)
        + """SELECT service, CAST(row_number() OVER (PARTITION BY service ORDER BY i <> 0, lower(id), id) AS INT) AS place, id, i = 0 AS vision FROM models
WHERE id <> '' AND NOT (contains(lower(id), 'embedding') AND o = 2) AND i <> 1 AND NOT vectors""",
        "image_model_catalog": _with(MODELS)
        + """SELECT service, CAST(row_number() OVER (PARTITION BY service ORDER BY id <> 'SMALL/small-bolt1', lower(id), id) AS INT) AS place, id, CASE WHEN unnamed THEN id ELSE p_name END AS name FROM models
WHERE id <> '' AND i IN (0, 1) AND o = 1""",
        "target_languages": f"""SELECT lang, language, count(*) AS docs FROM documents, (SELECT unnest({LANGUAGES}) AS language)
WHERE language <> coalesce(CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' END, '') GROUP BY lang, language""",
        "ocr_codes": f"""WITH n AS (SELECT unnest({LANGUAGES[:-1]}, 'Simplified Chinese', ' traditional chinese ', '', '-']) AS language, unnest(range(25)) AS i),
c AS (SELECT *, CASE i WHEN 0 THEN 'japan' WHEN 2 THEN 'chinese' WHEN 3 THEN 'korean' WHEN 10 THEN 'arabic' WHEN 11 THEN 'hindi' WHEN 12 THEN 'tamil' WHEN 13 THEN 'telugu' WHEN 14 THEN 'malayalam' WHEN 15 THEN 'kannada'
  WHEN 16 THEN 'thai' WHEN 21 THEN 'ch' WHEN 22 THEN 'chinese' ELSE 'latin' END AS code FROM n)
SELECT language, code, CASE code WHEN 'japan' THEN 'jpn+eng' WHEN 'chinese' THEN 'chi_tra+eng' WHEN 'korean' THEN 'kor+eng' WHEN 'arabic' THEN 'ara+eng' WHEN 'hindi' THEN 'hin+eng' WHEN 'tamil' THEN 'tam+eng' WHEN 'telugu' THEN 'tel+eng'
  WHEN 'malayalam' THEN 'mal+eng' WHEN 'kannada' THEN 'kan+eng' WHEN 'thai' THEN 'tha+eng' WHEN 'ch' THEN 'chi_sim+eng' ELSE 'eng' END AS pack, CASE doc_id % 5 WHEN 1 THEN 'native' WHEN 2 THEN 'ocr' ELSE 'auto' END AS mode, count(*) AS docs
FROM documents JOIN c ON doc_id % 25 = i GROUP BY ALL""",
        "recognized_text": _with(
            LINES,
            f"t AS (SELECT *, {strip('text')} AS t, CASE WHEN ord % 11 = 0 OR ord % 13 = 0 THEN NULL ELSE ord * 7 % 100 END AS conf FROM lines)",
            "m AS (SELECT doc_id, page, round(coalesce(avg(conf) / 100, 0), 6) AS confidence FROM t GROUP BY ALL)",
            "k AS (SELECT *, 'boxes' AS kind FROM t WHERE t <> '' UNION ALL SELECT *, 'words' FROM t WHERE t <> '' AND conf >= 20)",
        )
        + "SELECT doc_id, page, kind, CAST(row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY ord) - 1 AS INT) AS ord, sha256(t) AS text_sha, x0, y0, x1, y1, confidence FROM k JOIN m USING (doc_id, page)",
        "extractor_payload": _with(
            LINES,
            "t AS (SELECT *, CASE WHEN ord % 5 = 2 THEN translate(text, 'aeo', '日ア本') ELSE text END AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1 AS k FROM lines WHERE ord % 7 <> 6)",
            f"p AS (SELECT *, {strip('substr(t, 1, 3)')} AS a, {strip('substr(t, 4)')} AS b FROM t WHERE ord % 9 <> 8)",
            f"j AS (SELECT *, CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN regexp_matches(a || b, '{CJK}') THEN a || b ELSE a || ' ' || b END AS j FROM p)",
        )
        + "SELECT doc_id, page, CAST(k AS INT) AS ord, sha256(j) AS text_sha, x0, y0, x1, y1, 3 AS n_spans, CASE WHEN ord % 3 = 0 THEN 12.5::DOUBLE ELSE 10.0::DOUBLE END AS first_size, CASE WHEN ord % 2 = 0 THEN x1 ELSE 0.0::DOUBLE END AS first_x1 FROM j WHERE j <> ''",
        "source_scripts": _scripts(),
        "grid_cells": _with(LINES, GRIDS, CELLS, UNITS)
        + f"""SELECT doc_id, printf('p%d_t%03d', page + 1, k) AS unit_id, 'table_cell' AS kind, CAST(1 AS INT) AS n_lines, sha256({strip("t")}) AS text_sha, c0 AS x0, top AS y0, c1 AS x1, bottom AS y1 FROM numbered
UNION ALL SELECT doc_id, printf('p%d_u%03d', page + 1, unit_ord + coalesce(cells, 0)), kind, n_lines, sha256(text), x0, y0, x1, y1 FROM units LEFT JOIN held USING (doc_id, page)""",
        "fit_plan": _fits(),
        "border_colors": _with(PIXELS)
        + "SELECT CAST(doc_id AS VARCHAR) AS id, region_id, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b, max(samples) AS samples FROM colors GROUP BY doc_id, region_id",
        "scaled_rasters": _with(
            PIXELS,
            "s AS (SELECT doc_id, h, CASE WHEN h > 24 THEN CAST(greatest(1, trunc(16 * (24.0::DOUBLE / h))) AS INT) ELSE 16 END AS sw, CASE WHEN h > 24 THEN CAST(greatest(1, trunc(h * (24.0::DOUBLE / h))) AS INT) ELSE h END AS sh FROM d)",
            "t AS (SELECT *, unnest(range(y * sh // h, ((y + 1) * sh - 1) // h + 1)) AS ty FROM px JOIN s USING (doc_id, h))",
            "u AS (SELECT *, unnest(range(x * sw // 16, ((x + 1) * sw - 1) // 16 + 1)) AS tx FROM t)",
            "m AS (SELECT doc_id, h, sw, sh, ty, tx, c, sum(v * (least((ty + 1) * h, (y + 1) * sh) - greatest(ty * h, y * sh)) * (least((tx + 1) * 16, (x + 1) * sw) - greatest(tx * 16, x * sw))) AS v FROM u GROUP BY ALL)",
        )
        + """SELECT CAST(doc_id AS VARCHAR) AS id, sw AS width, sh AS height, sha256(unhex(string_agg(printf('%02X', CAST((2 * v + 16 * h) // (32 * h) AS INT)), '' ORDER BY ty, tx, c))) AS pixels_sha FROM m GROUP BY doc_id, sw, sh""",
        "erased_rasters": _with(PIXELS, "f AS (SELECT px.*, k.v AS fill, region_id FROM px JOIN open o USING (doc_id) JOIN colors k USING (doc_id, region_id, c) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1)", "l AS (SELECT doc_id, y, x, c, arg_max(fill, region_id) AS fill FROM f GROUP BY ALL)")
        + """SELECT CAST(doc_id AS VARCHAR) AS id, CAST(16 AS INT) AS width, h AS height, sha256(unhex(string_agg(printf('%02X', CAST(coalesce(fill, v) AS INT)), '' ORDER BY y, x, c))) AS pixels_sha FROM px LEFT JOIN l USING (doc_id, y, x, c) GROUP BY doc_id, h""",
        "cell_fit": _cell_fits(),
        "lines_put_back": _with(
            LINES,
            "t AS (SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN translate(text, 'aeo', '日ア本') ELSE text END AS text) FROM lines)",
            f"p AS (SELECT DISTINCT doc_id, page FROM t WHERE regexp_matches(text, '{CJK}'))",
        )
        + f"SELECT doc_id, page, ord, sha256(text) AS text_sha, x0, y0, x1, y1, 10.0::DOUBLE AS final_size FROM t JOIN p USING (doc_id, page) WHERE {strip('text')} <> '' AND NOT regexp_matches(text, '{CJK}')",
        "inspection_report": _with(LINES, SOURCE, UNITS)
        + "SELECT l.doc_id, l.n AS pages, coalesce(u.n, 0) AS n_units FROM (SELECT doc_id, count(DISTINCT page) AS n FROM lines GROUP BY doc_id) l LEFT JOIN (SELECT doc_id, count(*) AS n FROM units GROUP BY doc_id) u USING (doc_id)",
    }
