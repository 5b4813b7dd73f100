"""Row merge by pages, against plain Python and against the same in SQL."""

import random

from pyspark.sql import functions as F

from lectern import queries
from lectern.functions import text as tx
from lectern.operators import lines
from lectern.schemas import LINE


def glued(parts):
    out = ""
    for p in (p.strip() for p in parts if p is not None):
        if p:
            out += p if not out or any("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in out + p) else " " + p
    return out


def test_fragments_are_joined_as_one_by_one(spark):
    rnd = random.Random(2)
    cases = [[rnd.choice(["a", " b ", "日", "ア c", "", " ", None, "d　", "e f"]) for _ in range(rnd.randrange(7))] for _ in range(300)] + [[]]
    t = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p array<string>")
    got = {r["i"]: r["t"] for r in t.select("i", tx.join_fragments(F.col("p")).alias("t")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == tx.joined(c) == glued(c), c


def by_hand(page):
    """Rows of a page of lines: text, box and the texts of their spans, by top and left."""
    found = lines.assign_rows([tuple(x[4]) for x in page])
    out = []
    for k in range(max((r for r, _ in found), default=-1) + 1):
        held = [page[i] for i in sorted((i for i, (r, _) in enumerate(found) if r == k), key=lambda i: found[i][1])]
        spans = [s for x in held for s in x[5]]
        if len(held) > 1:
            spans = sorted(spans, key=lambda s: s[1][0])
        box = tuple(f(x[4][j] for x in held) for j, f in enumerate((min, min, max, max)))
        out.append(((box[1], box[0], k), held[0][3] if len(held) == 1 else glued([s[0] for s in spans]), box, [s[0] for s in spans]))
    return [x[1:] for x in sorted(out)]


def test_pages_are_merged_as_by_hand(spark):
    rnd = random.Random(9)
    pages, rows = {}, []
    for k in range(40):
        page = []
        for i in range(rnd.choice([1, 2, 30])):
            x, y = rnd.choice([5.0, 50.0, rnd.uniform(0, 300)]), rnd.choice([40.0, 40.5, 41.3, 58.0, rnd.uniform(30, 70)])
            box = (x, y, x + 30, y + rnd.choice([10.0, 11.0, 12.5]))
            spans = [(rnd.choice(["w", " v ", "日", "", "u　"]), (x + rnd.choice([0.0, 9.0, -3.0]), *box[1:]), "F", 10.0, 0, 0) for _ in range(rnd.choice([0, 1, 1, 1, 3]))]
            page.append((k // 3, k % 3, i, f"line {i}", box, spans))
        pages[k // 3, k % 3] = by_hand(page)
        rows += page
    got = {}
    for r in lines.merge_rows(spark.createDataFrame(rows, LINE).repartition(5)).orderBy("doc_id", "page", "ord").collect():
        at = got.setdefault((r["doc_id"], r["page"]), [])
        assert r["ord"] == len(at)
        at.append((r["text"], tuple(r["bbox"]), [s["text"] for s in r["spans"]]))
    assert got == pages


def test_words_are_not_dealt_out(spark, tmp_path, capsys):
    """Only lines are: a row for each word, with its boxes and spans, took many times the input of disk."""
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(i % 40)) for i in range(130)) + "\n 日 本 x\n"
    spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "a  b　c\n\n d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for f in (queries.merged_rows, queries.merged_rows_in_sql):
        df = f(spark, str(tmp_path))
        df.explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange") == 1 and "Join" not in plan
        got.append({r["doc_id"] * 1000 + r["page"] * 100 + r["ord"]: tuple(r)[4:] for r in df.collect()})
    assert got[0].keys() == got[1].keys() and len(got[0]) == 130 - 4 + 1 + 2
    assert got[0] == got[1]
