"""Vector codes, the source audit and signature joins: against brute force on small tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import minhash, source_audit, vector_codes
from lectern.llm._store import Scratch


def coded(rows, parts, entries, rounds):
    """vec_id, code, error, label_error, digest by all distances, for whole vectors in the order of ids."""
    rows = sorted((r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: r[0])
    x = [[[math.floor(256 * v) for v in r[2][p * len(r[2]) // parts : (p + 1) * len(r[2]) // parts]] for p in range(parts)] for r in rows]
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    for k in range(rounds + 1):
        near = [[min((apart(v[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in x]
        for p, i in itertools.product(range(parts), range(len(x[:entries]))) if k < rounds else ():
            mine = [v[p] for v, n in zip(x, near) if n[p][1] == i]
            if mine:
                books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    error = [sum(d for d, _ in n) for n in near]
    by_label = collections.Counter()
    for r, e in zip(rows, error):
        by_label[r[1]] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in n), e, by_label[r[1]], digest) for r, n, e in zip(rows, near, error)]


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "large"])
def test_vector_codes_are_those_of_all_distances(spark, kind):
    rnd = random.Random(kind)
    draw = {"spread": lambda: rnd.gauss(0, 1), "ties": lambda: rnd.choice([0.0, 0.25, 0.5]), "few": lambda: rnd.gauss(0, 1), "large": lambda: rnd.gauss(0, 2.0**17)}[kind]
    rows = [(i * 7 % 401, rnd.choice([None, 1, 2]), [draw() for _ in range(8)]) for i in range(3 if kind == "few" else 400)]
    odd = [(500, 1, None), (501, 1, [1.0, None] * 4), (502, 1, [math.nan] * 8), (503, 1, [math.inf] * 8)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, label int, vector array<double>, code int, x int").repartition(3)
    got = vector_codes.encode(df, parts=4, entries=16, rounds=3).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect())) == coded(rows, 4, 16, 3)


def test_vector_codes_edges(spark):
    schema = "vec_id long, label string, vector array<float>"
    assert vector_codes.encode(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a", [1.0, 2.0, 3.0]), (1, "a", [1.0, 2.0, 3.0]), (None, None, [1.0]), (2, "a", [])]
    got = vector_codes.encode(spark.createDataFrame(rows, schema), parts=2, entries=2).collect()
    assert len(got) == 4 and all(len(r["code"]) == 4 for r in got)
    assert len({r["code"] for r in got if r["vec_id"] == 1}) == 1
    only = vector_codes.encode(spark.createDataFrame([(1, "a", [])], schema), parts=2).collect()
    assert [(r["code"], r["error"]) for r in only] == [("0000", 0)]
    with pytest.raises(ArithmeticError):
        vector_codes.encode(spark.createDataFrame([(1, "a", [1e30])], schema))


def test_bounds_never_pass_over_a_nearer_entry():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-90, 90, (500, 3)), rng.integers(-90, 90, (20, 3))
    code, upper, lower = np.zeros(500, np.uint8), np.full(500, np.inf, np.float32), np.zeros((500, 20), np.float32)
    vector_codes.reassign(x, book, code, upper, lower, vector_codes.halves(book))
    for step in (1, 5, 0):
        new = book + rng.integers(-step, step + 1, book.shape)
        shift, book = vector_codes.moved_by(book, new), new
        q, unit = vector_codes.packed(lower[:, None, :])
        assert (q[:, 0] * unit[:, :1].astype(float) <= lower).all()
        upper = vector_codes._up(upper.astype(float) + shift[code])
        lower = vector_codes._down(q[:, 0] * unit[:, :1].astype(float) - shift)
        d = ((x[:, None, :] - book) ** 2).sum(2)
        assert (lower.astype(float) ** 2 <= d * (1 + 1e-12)).all() and (upper.astype(float) ** 2 * (1 + 1e-12) >= d[np.arange(500), code]).all()
        best, computed = vector_codes.reassign(x, book, code, upper, lower, vector_codes.halves(book))
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all() and computed < 500 * 12


def audited(docs, least):
    words = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in docs]
    out = []
    for lang in {w[0] for w in words}:
        df, by = collections.Counter(), collections.defaultdict(collections.Counter)
        for g, s, w in words:
            if g == lang:
                df.update(set(w))
                by[s].update(w)
        kept = [t for t in df if df[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole, of = share(sum(by.values(), collections.Counter())), {s: share(c) for s, c in by.items()}
        for s in by:
            pairs = [(-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in by if o != s]
            terms = [(-f(of[s][t], whole[t]), t.encode()) for t in kept if by[s][t] and of[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, o.decode(), -v, i + 1) for i, (v, o) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3, 10_000])
def test_audit_is_exact(spark, least):
    rnd = random.Random(least)
    words = ["Ab", "aB", "é", "x", "q1r", "_z", "É", "long" * 30, *[f"w{chr(97 + i)}" for i in range(20)]]
    docs = [(" ".join(rnd.choice(words[: rnd.choice([3, 9, 28])]) for _ in range(rnd.choice([0, 1, 9, 60]))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "é", None, "s" * 90])) for _ in range(150)]
    docs += [(None, "en", "only"), ("", "fr", "s1"), ("12 !", "fr", None), ("solo", "it", "s1")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "text string, lang string, source string, n int, term int").repartition(4)
    assert sorted(map(tuple, source_audit.audit(df, least).select("lang", "source", "part", "item", "value", "rank").collect())) == audited(docs, least)


def test_audit_of_an_empty_table(spark):
    assert source_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_sketch_never_underestimates(spark):
    docs = [(f"common w{'abc'[i % 3]} " + "".join(chr(97 + int(c)) for c in str(i)), "en" if i % 2 else "de", "s") for i in range(900)]
    df = source_audit._prepared(spark.createDataFrame(docs, "text string, lang string, source string").repartition(5))
    true = collections.Counter((lang, t) for text, lang, _ in docs for t in set(re.findall("[a-z]+", text)))
    rough = source_audit._counted(df, source_audit.sketch(df, 16), 3).groupBy("lang", "term").agg(F.sum("docs").alias("d")).collect()
    assert {k: v for k, v in true.items() if v >= 3}.items() <= {(r["lang"], r["term"]): r["d"] for r in rough}.items()
    assert len(rough) < len(true) / 2  # the rest was dropped before it was shuffled


def near(docs, least):
    sets = []
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    at = list(range(len(sets)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= least * len(a | b):
            at[root(i)] = root(j)
    name = {}
    for i, (d, _) in enumerate(sets):
        name[root(i)] = min(name.get(root(i), d), d)
    return sorted((d, len(s), name[root(i)], d == name[root(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("options", [{}, {"long_list": 2, "block_shingles": 400}, {"long_list": 2, "block_shingles": 60}])
def test_minhash_finds_the_links_of_brute_force(spark, options):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([2, 6, 25, 90, 200]))] for _ in range(14)]
    docs = []
    for i in range(360):
        b = list(rnd.choice(base[:4] if i % 3 else base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        docs.append((i, " ".join(b)))
    docs += [(900, ""), (901, None), (902, " \n\t"), (903, "One"), (904, "oNE"), (905, "lang " * 30_000)]
    df = spark.createDataFrame([(*d, 7, 8, 9) for d in docs], "doc_id long, text string, cls int, n int, sig int").repartition(5)
    got = minhash.near_duplicates(df, **options).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == near(docs, 85)


def test_minhash_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (None, None), (7, None)]
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == {(4, 4, True): 2, (None, 4, False): 1, (None, None, True): 2, (7, 7, True): 1}


def test_the_match_threshold_loses_less_than_said():
    for k, num in ((64, 85), (128, 80), (16, 85)):
        need = minhash.needed(k, num, 100)
        below = lambda c: sum(math.comb(k, i) * (num / 100) ** i * (1 - num / 100) ** (k - i) for i in range(c))  # noqa: B023, E731
        assert below(need) <= 1e-9 or need == 1
        assert below(need + 1) > 1e-9


def test_coordinates_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 2**64, 200, np.uint64)) for _ in range(60)]
    b = [np.unique(np.concatenate([s[:150], rng.integers(0, 2**64, 50, np.uint64)])) for s in a]
    same = (minhash.signatures(a, 64) == minhash.signatures(b, 64)).mean()
    assert abs(same - 150 / 250) < 0.03


def test_a_long_list_gives_rows_in_proportion(spark):
    """A passage that all share, and nothing else: no pair of it is made."""
    rows = [(t, 5000, c, 100 + c) for t in range(3) for c in range(5000)]
    prefixes = spark.createDataFrame(rows, "token long, df long, cls long, n long")
    assert minhash._short_pairs(prefixes, 16, 85, 100).count() == 0
    assert minhash._long_links(prefixes, 16, 85, 100, Scratch(spark, "test")).count() < 2 * 5000


def test_near_copies_join_through_stars():
    """In a group of near copies, members that are joined are not compared again."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**64, 300, np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, i % 300), rng.integers(0, 2**64, 1, np.uint64)])) for i in range(400)]
    sig = minhash.signatures(sets, 64)
    group = [minhash.Member(i, 0, i, s, t) for i, (s, t) in enumerate(zip(sig, sets))]
    assert len(list(minhash.joining_links(group, False, 34, 85, 100))) == 399
