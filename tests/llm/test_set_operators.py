"""Near duplicates, mixing, decontamination, neighbours, chats and the pipeline: against brute force on small tables."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lectern.llm import _components, ann_forest, chat_format, decontamination, mixing, ngram_join
from lectern.llm import queries as llm_queries
from lectern.llm._components import components
from lectern.llm._store import Scratch


def similar(docs, n=5):
    """doc_id, set size, smallest reachable doc_id, links: by comparing all sets."""
    sets = []
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    link = collections.defaultdict(set)
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                link[i].add(j), link[j].add(i)
    out = []
    for i, (d, s) in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((d, len(s), min(sets[k][0] for k in seen), len(link[i])))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"long_list": 3, "block_shingles": 500, "pack_bytes": 4000}, {"pack_bytes": 4000, "fan_bits": 2}])
def test_ngram_join_is_exact(spark, options):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([2, 6, 25, 60, 150]))] for _ in range(12)]
    docs = []
    for i in range(400):
        b = list(rnd.choice(base[:3] if i % 3 else base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        docs.append((i, " ".join(b)))
    docs += [(900, ""), (901, None), (902, " \n\t"), (903, "One"), (904, "oNE"), (905, "lang " * 30_000)]
    df = spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id long, text string, cls int, n int").repartition(5)
    got = ngram_join.join(df, **options).select("doc_id", "n_shingles", "component_id", "n_links")
    assert sorted(map(tuple, got.collect())) == similar(docs)


def test_ngram_join_edges(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, "q")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["n_links"]) for r in got) == [("4", "4", 2), ("4", "4", 2), ("None", "4", 2), ("None", "None", 0)]
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_share_enough_tokens():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 120)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 40, 5).astype(np.uint64)]))
        met = len(np.intersect1d(a, b))
        level = lambda s, c: np.where(np.isin(s, c), 8, 20 * (s % np.uint64(7) == 0)).astype(np.uint8) + (s % np.uint64(5) == 0).astype(np.uint8)
        if 100 * met >= 80 * (len(a) + len(b) - met):
            (pa, la, ea), (pb, lb, eb) = (ngram_join.adaptive_prefix(s, level(s, np.intersect1d(a, b)), 80, 100) for s in (a, b))
            both = {t for t, x in zip(pa.tolist(), la) if x <= min(ea, eb)} & {t for t, x in zip(pb.tolist(), lb) if x <= min(ea, eb)}
            assert len(both) >= min(ea, eb)


def test_a_passage_in_many_documents_costs_no_pairs(spark):
    """A passage that 500 documents share is in no prefix but of those that hold little else."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    passage = [word() for _ in range(60)]
    docs = [(i, " ".join([word() for _ in range(100)] + passage + [word() for _ in range(rnd.randrange(60))])) for i in range(500)]
    docs += [(600 + i, " ".join([word() for _ in range(rnd.choice([1, 4, 9]))] + passage)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    packed = ngram_join._packed(df, 5, 3)
    table = ngram_join._prefixes(packed, ngram_join._levels(packed, 2), 80, 100).filter("NOT doc")
    assert table.count() == 40
    got = ngram_join.join(df).select("doc_id", "n_shingles", "component_id", "n_links")
    assert sorted(map(tuple, got.collect())) == similar(docs)


def test_frequencies_are_exact(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choices("abcd", k=rnd.randrange(40)))) for i in range(200)] * 2
    packed = ngram_join._packed(spark.createDataFrame(docs, "doc_id long, text string"), 5, 5)
    sets = {r["cls"]: np.frombuffer(r["tokens"], np.uint64) for r in packed.filter("NOT doc").collect()}
    df = collections.Counter(t for s in sets.values() for t in s.tolist())
    for bits, fan_bits in ((2, 8), (0, 8), (3, 1), (5, 2)):
        levels = ngram_join._levels(packed, bits, fan_bits, Scratch(spark, "test"))
        told = {(r["node"], r["bucket"]): np.frombuffer(zstandard.decompress(r["levels"], 1 << 20), np.uint8) for r in levels.collect()}
        for pack in range(5):
            mine = np.unique(np.concatenate([s for c, s in sets.items() if c % 5 == pack]))
            level = np.concatenate([told[pack, b] for b in range(1 << bits) if (pack, b) in told])
            assert level.tolist() == ngram_join.levels_of(np.array([df[t] for t in mine.tolist()])).tolist()


@pytest.mark.parametrize("fan_bits", [8, 1])
def test_shingles_that_share_what_is_sent_of_them(spark, fan_bits):
    """Each has its own place in the answer; their frequencies add up."""
    base = 77 << 40
    sets = {0: [base, base + 1, 5], 2: [base + 1, base + 2], 1: [base + 2, 9 << 50]}
    rows = [(c % 4, False, None, len(t), c, None, np.array(sorted(t), np.uint64).tobytes()) for c, t in sets.items()]
    packed = spark.createDataFrame(rows, "pack int, doc boolean, doc_id long, n long, cls long, m long, tokens binary")
    told = {(r["node"], r["bucket"]): list(zstandard.decompress(r["levels"], 1 << 20)) for r in ngram_join._levels(packed, 2, fan_bits, Scratch(spark, "test")).collect()}
    five = ngram_join.levels_of(np.array([5]))[0]
    assert {k: v for k, v in told.items()} == {(0, 0): [0, five, five], (2, 0): [five, five], (1, 0): [five, 0]}


def test_the_exchange_of_frequencies_is_linear(spark):
    """Rows for each pack stay under the fan-out at each hop, however many packs there are."""
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices([f"w{k}" for k in range(900)], k=60))) for i in range(1500)], "doc_id long, text string")
    for packs in (8, 64, 256):
        asked = ngram_join._asked(ngram_join._packed(docs, 5, packs), (packs - 1).bit_length(), 3)
        assert len(asked) == -(-(packs - 1).bit_length() // 3)
        assert all(df.count() <= 8 * packs for df in asked)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 3), (3, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges, Scratch(spark, "test"), "path").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3}


@pytest.mark.parametrize("few", [1 << 18, 40])
def test_few_edges_are_joined_in_one_pass(spark, monkeypatch, few):
    """Rounds of shuffles are for edges of several tasks; both ways give the components of a search."""
    rnd = random.Random(few)
    pairs = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(120)]
    beside = collections.defaultdict(set)
    for u, v in pairs:
        if u != v:
            beside[u].add(v), beside[v].add(u)
    want = {}
    for node in sorted(beside):
        todo = [] if node in want else [node]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo += beside[x]
    monkeypatch.setattr(_components, "FEW", few)
    store, written = Scratch(spark, "test"), []
    write = store.write
    store.write = lambda df, table: written.append(table) or write(df, table)
    edges = write(spark.createDataFrame(pairs, "u long, v long").repartition(5), "edges")
    got = components(edges, store, "few").collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted(want.items())
    assert (written == ["few-0"]) == (few > len(pairs))


def filled(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, cap = dict(zip(names, itertools.cycle(weights))), {s: most * sizes[s] for s in names}
    out, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("slots", [64, 1 << 16])
def test_mixing(spark, slots):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["b", "a", "a", "a", "c", None, "tiny"] if i else ["tiny"]), " x\t" * rnd.choice([0, 1, 7, 300])) for i in range(200)]
    rows += [(7, "a", "x y"), (7, "a", "x y"), (None, None, None), (8, "empty", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix(df, slots=slots)["documents"].collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert len(got) == len(rows) and sum(size.values()) == sum(len((t or "").split()) for _, _, t in rows)
    for s, t in filled(size).items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 1
    again = mixing.mix(df, slots=slots)
    assert sorted(map(str, got)) == sorted(map(str, again["documents"].collect()))
    # the schedule by hand: golden-ratio points through the cumulative targets, missing slots at the end
    names = sorted(size, key=lambda s: (s is None, s or ""))
    total = sum(size.values()) * 1.5
    block = max(1, -(-int(total) // slots))
    points, want = -(-int(total) // block), {s: int(target[s] + 1e-6) for s in names}
    uppers = list(itertools.accumulate(target[s] / sum(target.values()) for s in names))
    given = collections.defaultdict(list)
    for i in range(points):
        u = i * mixing.GOLDEN - math.floor(i * mixing.GOLDEN)
        owner = next((s for s, hi in zip(names, uppers) if hi > u), names[-1])
        given[owner].append(i)
    slot, by_hand = points, []
    for s in names:
        done = 0
        for rank in itertools.count():
            if done >= want[s]:
                break
            per = -(-size[s] // block)
            n = min(block, size[s] - rank % per * block, want[s] - done)
            if rank < len(given[s]):
                at = given[s][rank]
            else:
                at, slot = slot, slot + 1
            by_hand.append((at, s, rank % per, rank // per, n))
            done += n
    plan = [tuple(r) for r in again["schedule"].select("slot", "source", "block", "epoch", "tokens").collect()]
    assert sorted(plan, key=lambda r: r[0]) == sorted(by_hand, key=lambda r: r[0]) and len({r[0] for r in plan}) == len(plan)
    # each document's share of the blocks taken, along its source's shuffled line
    lines = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n")).withColumn("h", mixing.shuffled(F.col("doc_id"), F.col("n"))).collect()
    expected, buckets = [], len(rows) // 4096 + 1
    for s in names:
        start = 0
        for r in sorted((r for r in lines if r["source"] == s), key=lambda r: (r["h"] % buckets, r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["n"])):
            part = sum(max(0, min(start + r["n"], b * block + n) - max(start, b * block)) for _, o, b, _, n in by_hand if o == s)
            expected.append((str(r["doc_id"]), str(s), r["n"], part))
            start += r["n"]
    assert sorted(expected) == sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in got)
    assert mixing.mix(df.limit(0))["documents"].count() == 0


def test_schedule_is_spread_out(spark):
    """In any run of slots, each source has nearly its share."""
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * 100) for i in range(200)], "doc_id long, source string, text string")
    rows = sorted(mixing.mix(df, weights=(3, 1), budget=1.0, slots=1000)["schedule"].collect(), key=lambda r: r["slot"])
    share = [sum(r["source"] == "a" for r in rows[i : i + 60]) / 60 for i in range(0, 900, 60)]
    assert max(share) - min(share) < 0.1


def hits(docs, items, n=13):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            x = words(x)
            k = min(n, len(x))
            for a, b in itertools.product(range(len(x) - k + 1 if x else 0), range(len(w) - k + 1)):
                if w[b : b + k] == x[a : a + k]:
                    hit |= set(range(b, b + k))
                    found.add(str(i))
        out.append((str(d), len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination_is_exact(spark):
    rnd = random.Random(2)
    words = ["Ähre", "é", "the", "OF", "x9", "und", "zz"] + [f"r{i}" for i in range(40)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    items = [(i, text(rnd.choice([1, 3, 13, 20, 30]))) for i in range(10, 18)] + [(2, None), (3, "..."), (4, "the the the the")]
    docs = []
    for i in range(60):
        it = rnd.choice(items)[1] or ""
        cut = it.split()[rnd.choice([0, 0, 1]) :]
        docs.append((i, f"{text(rnd.choice([0, 5, 50]))}. {'; '.join(cut)} {text(rnd.choice([0, 5, 400]))}"))
    docs += [(100, None), (101, ""), (102, "--"), (5, "again " + items[3][1]), (None, items[4][1]), (103, "the " * 5000)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, pos int, found int")
    ben = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contamination(df, ben).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["item_ids"]), r["contaminated"]) for r in out)
    expected = hits(docs, items)
    assert got == expected
    beyond = decontamination.contamination(df, ben, broadcast_bytes=0).collect()  # nothing is broadcast, words pass the sieve
    assert sorted(map(str, beyond)) == sorted(map(str, out))
    kept = decontamination.drop_contaminated(df, ben)
    assert kept.columns == df.columns and kept.count() == sum(not x[-1] for x in expected)
    assert {r["found"] for r in kept.collect()} == {2}
    assert decontamination.contamination(df.limit(0), ben).count() == 0
    assert decontamination.contamination(df, ben.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red big green fox"), (2, "red one two green"), (3, "green red"), (4, None)], "doc_id long, text string")
    got = decontamination.proximity(docs, spark.createDataFrame([(9, "Red green")], "item_id long, text string"), 1).collect()
    assert [tuple(r) for r in got] == [(9, 1, 0, 2)]


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[1000:1400] = x[0] + rng.standard_normal((400, 16)) * 0.05  # a hot group
    x[1400:1420] = x[0]  # and equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50_000, None), (50_050, [0.0] * 16), (50_100, [float("nan")] * 16), (50_150, [1.0, None] * 8), (50_200, [1.0]), (None, [1.0] * 16), (0, x[0].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in ann_forest.nearest(df, F.col("vec_id") % 50 == 0, block_rows=100, block_queries=20, sample=500, leaf_rows=64).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 50))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    met = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        assert [r for r, *_ in sorted(found)] == [1, 2, 3, 4, 5]
        met += len({v for _, v, _ in found} & set(best.tolist()))
        assert all(abs(score - s[v]) < 1e-12 for _, v, score in found)
    assert met / (5 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[0])] == [1400, 1401, 1402, 1403, 1404]
    assert ann_forest.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann_forest.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 1).count() == 2


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_deep_trees_keep_their_recall(spark, kind):
    """Most levels are cut on the executors here: the sample has 200 of 12,000 rows."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12_000, 24))
    if kind == "clustered":
        x = np.repeat(rng.standard_normal((600, 24)), 20, 0) + x * 0.15
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = collections.defaultdict(dict)
    for r in ann_forest.nearest(df, F.col("vec_id") % 150 == 0, sample=200, leaf_rows=50).collect():
        found[r["query_id"]][r["rank"]] = r["vec_id"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    met = [len(set(f.values()) & set(np.argsort(-(u @ u[q]))[1:6].tolist())) for q, f in found.items()]
    assert len(found) == 80 and sum(met) / 400 >= 0.95


def test_a_repeated_id_does_not_crowd_out_the_rest(spark):
    """Every leaf taken holds one id alone; the others are found all the same."""
    rows = [(1, [1.0, 0.001 * i]) for i in range(2000)] + [(0, [1.0, 0.0])] + [(i, [-1.0, 0.1 * i]) for i in range(2, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann_forest.nearest(df, F.col("vec_id") == 0, leaf_rows=20, sample=8).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 8, 7, 6, 5]


def places(words, terms, slop):
    """Brute force: all pairs of first and last word."""
    out = set()
    for first, w in enumerate(words):
        ends = {first} if w == terms[0] else set()
        for t in terms[1:]:
            ends = {q for e in ends for q in range(e + 1, min(e + 2 + slop, len(words))) if words[q] == t}
        out |= {(first, e) for e in ends}
    return out


def test_proximity_with_repeated_terms(spark):
    """A later occurrence of a term can be the only one from which the next is in reach."""
    rnd = random.Random(9)
    docs = [(0, "a b x b x x c"), *[(i, " ".join(rnd.choice("abcx") for _ in range(rnd.choice([5, 40])))) for i in range(1, 25)]]
    phrases = [(1, "a b c"), (2, "a b a"), (3, "b b"), (4, "c"), (5, "a b c a")]
    df, ph = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(phrases, "item_id long, text string")
    got = sorted(map(tuple, decontamination.proximity(df, ph, 2).collect()))
    assert (1, 0, 0, 6) in got
    assert got == sorted((i, d, *p) for i, t in phrases for d, text in docs for p in places(text.split(), t.split(), 2))


def nearest_ids(x, ids, query, k=5):
    """Brute force: (id, score) of the k best other ids of a query's vector."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = {}
    for i, s in zip(ids, unit @ (query / np.linalg.norm(query))):
        score[i] = max(s, score.get(i, -2))
    return sorted(score.items(), key=lambda p: (-round(p[1], 12), p[0]))[:k]


def test_neighbours_of_repeated_ids(spark):
    """Rows that repeat an id near a query, equal or not, take one place."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 8))
    x[0] = x[100] + 0.001  # the query
    equal, varied = np.repeat(x[100:101], 40, 0), x[100] + rng.standard_normal((150, 8)) * 0.01
    x, ids = np.concatenate([x, equal, varied]), [*range(300), *[100] * 40, *[101] * 150]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    others = [j for j, i in enumerate(ids) if i]
    expected = nearest_ids(x[others], [ids[j] for j in others], x[0])
    for block_rows in (4096, 64):
        found = ann_forest.nearest(df, F.col("vec_id") == 0, leaf_rows=600, block_rows=block_rows).orderBy("rank").collect()
        assert [(r["rank"], r["vec_id"]) for r in found] == [(n + 1, i) for n, (i, _) in enumerate(expected)]
        assert [r["score"] for r in found] == pytest.approx([s for _, s in expected], abs=1e-12)


def test_neighbours_of_few_ids(spark):
    rows = [(i % 3, [1.0, float(i % 3)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sample in (1, 2, 8):
        found = ann_forest.nearest(df.dropDuplicates(["vec_id"]).unionByName(df.filter("vec_id > 0")), F.col("vec_id") == 0, sample=sample).orderBy("rank").collect()
        assert [(r["rank"], r["vec_id"]) for r in found] == [(1, 1), (2, 2)]


def test_chats(spark):
    said = ["", "</s>[INST] ok", "<|end|>\\l\\b|>", "a\nb", "\\", "<|user|>x<|end|>", "é中🙂"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(said)]
    rows += [(2, 0, "tool<|", "x"), (2, None, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (None, 0, "user", "u" * 100_000), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat_format.format_conversations(df).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3]) for r in rows[:7]]
    assert got[1]["loss"] == said[1] + said[3] + said[5] and not got[1]["valid"]  # ends with the user
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", ""), ("tool<|", "x")] and got[2]["bad_turn"] == 0
    assert got[3]["loss"] == "bb" and not got[3]["valid"]
    assert got[4]["valid"] and got[4]["bad_turn"] is None
    assert got[None]["turns"][0]["text"] == "u" * 100_000
    assert chat_format.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("strings", [("<|", "|>", "<|end|>"), ("[", "]", "[/INST]"), ("<s>", "</s>", "</s></t>"), ("#", ">", "##"), ("((", "))", "|)")])
def test_chats_read_back_under_any_template(spark, strings):
    t = chat_format.Template(*strings)
    parts = ["", "end", "/INST", "e", "x", ">", "/t>", "\\z", "\\", *strings, *[c for s in strings for c in s], strings[0] + "user" + strings[1]]
    turns = [(i, j, role, text) for i, (role, text) in enumerate(itertools.product(parts, parts)) for j in range(2)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(2)
    out = chat_format.format_conversations(df, t)
    for r in out.select("conv_id", chat_format.read_turns(F.col("formatted"), t).alias("turns")).collect():
        role, text = turns[2 * r["conv_id"]][2:]
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(role, text)] * 2, (role, text)


def test_templates_that_cannot_be_read_back_are_refused():
    for strings in [("<", ">", "<>"), ("a<", ">", "|"), ("", ">", "|"), ("<", "\\>", "|"), ("[", "]", "]"), ("#", ">", "#>#")]:
        with pytest.raises(ValueError):
            chat_format.Template(*strings)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(3)
    vocab = {"en": "the and of that with from have this".split(), "de": "der und die das nicht eine über für".split()}
    text = lambda lang, k: " ".join(rnd.choice(vocab[lang]) + rnd.choice(["", "s", "en"]) + str(rnd.randrange(30)) for _ in range(k))
    rows = [(i, text(lang, 40), lang, f"src{i % 3}", 1) for i, lang in enumerate(["en", "de"] * 60)]
    bench = text("en", 20)
    rows += [(500, rows[0][1], "en", "src0", 1), (501, rows[1][1] + " x", None, "src1", 1), (502, bench, "en", "src0", 1), (503, "12 34", "en", "src0", 1), (504, None, "en", None, 1), (505, "", None, None, 1)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    store, left = Scratch(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = store.write(stage(spark, docs, sf), name)
        left[name] = docs.select("doc_id").collect()
        assert name == "token_shards" or docs.columns == columns
    ids = lambda name: [r["doc_id"] for r in left[name]]
    assert sorted(ids("language_id")) == sorted(r[0] for r in rows if r[0] < 503)
    assert sorted(ids("ngram_join")) == sorted([*range(120), 502])
    assert sorted(ids("decontamination")) == list(range(120))
    assert set(ids("mixing")) <= set(range(120)) and max(collections.Counter(ids("mixing")).values()) <= 2
    assert sorted(ids("token_shards")) == sorted(ids("mixing"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/e/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{sf}/e").count() == 0


def test_pipeline_with_repeated_and_missing_ids(spark, tmp_path):
    """Rows decide, not ids: a unique text stays though its doc_id stands on a copy too."""
    import corpus_pipeline

    rnd = random.Random(6)
    text = lambda: " ".join(rnd.choice("the and of that with from have this".split()) + str(rnd.randrange(30)) for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c + " x"), (None, a), (None, d), (None, d), (None, e), (9, e), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    kept = sorted((str(r["doc_id"]), (r["text"] or "").removesuffix(" x")) for r in got.collect())
    assert kept == sorted([("1", a), ("2", b), ("3", c), ("None", d), ("9", e), ("7", ""), ("7", "")])
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(map(tuple, docs.collect()))
    assert max(collections.Counter(map(tuple, mixed.collect())).values()) <= 4  # two rows are equal


def test_every_operator_has_a_query():
    names = {q.split("_")[0] for q in llm_queries.queries()}
    assert names == {f"op{n}" for n in range(1, 11)}
    assert set(llm_queries.oracle_sql()) <= set(llm_queries.queries())
