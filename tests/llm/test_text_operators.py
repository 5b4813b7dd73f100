"""Token counts, token files, language, toxicity and html: against the library, brute force, or held-out rows."""

import itertools
import zlib
from urllib.parse import unquote

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from lectern.llm import _store, html_extract, language_id, token_lengths, token_shards, toxicity
from lectern.llm._bpe import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)  # with the file's own settings
TRICKY = ["", None, " ", "it's we'll 's 'sx ''s", "a  b\n\n c \t", "x" * 70_000, "é×÷ß ½ ²", "中文 text 🙂", "<|endoftext|> a", "don't’s", "9 99a9 _-_", " x\u0085y"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH, bits=10, most_ids=2000)  # small, so that slots are taken over and the store is cleared


SIGNS = [chr(c) for c in (*range(0xA0, 0xC0), *range(0x2010, 0x202A), 0x20AC, 0x20BF, 0x2122, 0xD7, 0xF7, 0xE9)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=[*" \n'sdtlab9.,", *SIGNS], max_size=20), min_size=1, max_size=8))
def test_signs_beyond_ascii_are_cut_as_the_library_does(encoder, texts):
    flat, counts = encoder.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_quotes_and_dashes_do_not_send_a_text_to_the_library():
    from lectern.llm._bpe import cut, utf8

    texts = pa.array(["“It’s” — 5 € · ½ ×2…", "中", "a\u2028b"])
    assert cut(*utf8(texts))[1].tolist() == [False, True, True]


def test_new_pieces_go_straight_to_the_model():
    """The library does not cut them again, which took more than half of the time of an encoding."""
    mine = Encoder(PATH, bits=10)
    mine.tokenizer = None
    texts = ["It's “new” –  pieces\n\n of größe 12€", "", None, "".join(map(chr, [*range(127), *range(0xA1, 0x250)])), "x" * 5000 + " y"]
    flat, counts = mine.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bytes_are_spelled_as_the_library_does():
    from lectern.llm._bpe import spelled, utf8

    words = [chr(c) for c in (*range(0x800), *range(0x800, 0xD800, 61), *range(0xE000, 0x110000, 997))] + ["a b", "中 é\n🙂"]
    data, offsets = utf8(pa.array(words))
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    assert spelled(data, offsets[:-1], np.diff(offsets)) == [byte_level.pre_tokenize_str(w)[0][0] for w in words]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=" \n\t'sdtmlrveab9.,!éß×中’ ", max_size=25), st.text(max_size=12)), min_size=1, max_size=8))
def test_memo_encodes_as_the_library(encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    flat, counts = encoder.encode(pa.array(texts, pa.string()))
    expected = [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == expected


def test_another_way_of_cutting_goes_to_the_library(tmp_path):
    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    other.save(str(tmp_path / "digits.json"))
    mine = Encoder(str(tmp_path / "digits.json"))
    assert not mine.known and Encoder(PATH).known
    texts = ["12345 it's 99", "", None, "plain words"]
    flat, counts = mine.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_length_histogram_and_sums(spark, encoder):
    texts = TRICKY * 2
    lengths = np.array([len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts])
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, length int")
    sums = token_lengths.suffix_sums(token_lengths.length_histogram(docs, PATH))
    for r in sums.collect():
        n = r["length"]
        assert (r["n_docs"], r["docs_ge"], r["tokens_ge"], r["truncated_tokens"]) == ((lengths == n).sum(), (lengths >= n).sum(), lengths[lengths >= n].sum(), np.minimum(lengths, n).sum())
    for r in token_lengths.at_limits(sums, [0, 3, 10**6]).collect():
        assert r["truncated_tokens"] == np.minimum(lengths, r["limit"]).sum()
        assert r["docs_over"] == (lengths > r["limit"]).sum()
    assert token_lengths.quantile(sums, 0.5) == sorted(lengths)[len(lengths) // 2 - 1]
    empty = token_lengths.suffix_sums(token_lengths.length_histogram(docs.limit(0), PATH))
    assert empty.count() == 0 and token_lengths.quantile(empty, 0.5) is None


def test_shards_need_no_codec(spark):
    """Frames are compressed already; a codec would hold a page of shards beside the heap when they are written and when they are read."""
    files = token_shards.write_tokens(spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string"), PATH, partitions=2)
    columns = [pq.read_metadata(f.removeprefix("file:")).row_group(0).to_dict()["columns"] for f in map(unquote, files.shards.inputFiles())]
    assert columns and {c["compression"] for cs in columns for c in cs} == {"UNCOMPRESSED"}


def test_token_files_round_trip(spark, encoder):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(3, "again"), (None, "no id"), (10**12, "far"), (-5, "low")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    files = token_shards.write_tokens(docs, PATH, partitions=3, shard_ids=50)
    got = sorted(map(tuple, token_shards.read_tokens(files).collect()), key=lambda r: r[1])
    start, expected = 0, []
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    for i, t in [(r["doc_id"], r["text"]) for r in sorted(order, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))]:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    hot = spark.createDataFrame([(1, f"t{i % 7}" if i % 3 else "same") for i in range(900)], "doc_id long, text string").repartition(6)
    files_of = token_shards.write_tokens(hot, PATH, partitions=6, shard_ids=50)
    sizes = [r["n"] for r in files_of.shards.groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(sizes) == 900 and max(sizes) < 400
    starts = sorted((r["start"], r["n_tokens"]) for r in token_shards.read_tokens(files_of).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    few = token_shards.read_documents(files, [10**12, -5]).collect()
    assert {r["doc_id"]: r["ids"] for r in few}[-5] == [*LIBRARY.encode("low", add_special_tokens=False).ids, 0]
    assert token_shards.read_tokens(token_shards.write_tokens(docs.limit(0), PATH)).count() == 0


def test_added_tokens_are_the_librarys(spark, encoder):
    """Against a fresh tokenizer with the file's own settings."""
    fresh = Tokenizer.from_file(PATH)
    texts = ["x <|endoftext|> a", "<|endoftext|>", "<|endoftext|><|endoftext|> \n", "<|endoftext| >", None, "é<|endoftext|>é 中", "it's<|endoftext|>'s", " x <|endoftext|>" * 500, *TRICKY]
    expected = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert expected[0] == [87, 220, 50256, 257]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    flat, counts = encoder.encode(column)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == expected
    assert encoder.encode(column, count_only=True)[1].tolist() == list(map(len, expected))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, token_shards.read_tokens(token_shards.write_tokens(docs, PATH, partitions=2)).collect()))
    starts = np.cumsum([0] + [len(x) + 1 for x in expected])
    assert got == [(i, starts[i], len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(expected)]
    lengths = sorted(r["length"] for r in token_lengths.length_histogram(docs, PATH).collect() for _ in range(r["n_docs"]))
    assert lengths == sorted(map(len, expected))


def test_shard_refuses_another_dictionary():
    with pytest.raises(ValueError):
        token_shards.Shard(token_shards.pack([1], [1], [b""], 2, b"12345678"), b"other")


WORDS = {"en": "the and of that with from have this which there", "de": "der und die das nicht eine werden schon über für", "fr": "le la les des une être avec pour dans où"}


def _texts(rng, lang, n):
    words = WORDS[lang].split()
    return [" ".join(rng.choice(words, rng.integers(5, 40))) for _ in range(n)]


def test_language_id_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 3 + k, t, lang) for k, lang in enumerate(WORDS) for i, t in enumerate(_texts(rng, lang, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.filter("doc_id % 4 != 0"), per_lang=100, per_class=10)
    odd = spark.createDataFrame([(9000, None, "en", 1.0), (9001, "", None, 1.0), (9002, "12 -- !?", "de", 1.0), (9003, rows[0][1] * 3000, None, 1.0)], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in language_id.predict(docs.filter("doc_id % 4 = 0"), model).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows if i % 4 == 0]
    assert np.mean(right) >= 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    edge = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, model).collect()}
    assert edge == {9000: "und", 9001: "und", 9002: "und", 9003: "en"}
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.train(docs.limit(0)) is None and language_id.predict(docs.limit(0), model).count() == 0


def test_language_of_long_texts_with_growing_vocabulary():
    """Neither the language nor the score is lost with length: megabytes of ever new words."""
    rng = np.random.default_rng(8)
    ends = {"aa": "tion ness ing ed ly".split(), "bb": "ung keit lich en er".split(), "cc": "eux ment age oir ais".split()}

    def text(lang, n):
        letters = rng.integers(97, 123, (n, 5), np.uint8)
        return " ".join(bytes(w).decode() + ends[lang][k] for w, k in zip(letters, rng.integers(0, 5, n)))

    model = language_id.fit([text(lang, 60) for lang in ends for _ in range(40)], [lang for lang in ends for _ in range(40)], per_class=16)
    for lang in ends:
        long = text(lang, 400_000)
        assert len(long) > 3_000_000
        f = model.margins(pa.array([long[:20_000], long, None, ""], pa.string()))
        assert [model.langs[k] for k in f[:2].argmax(1)] == [lang, lang]
        short, whole = language_id.certainty(f[:2])
        assert short > 0.9 and abs(short - whole) < 0.02


def test_language_pieces_hold_every_ngram_once():
    texts = ["xyz" * 2000 + "Ä", "", None, "12 " * 700, "ab"]
    column, dims = pa.array(texts, pa.string()), 1 << 13
    owner, rows = zip(*language_id.pieces(column, dims, block=2))
    owner, rows = np.concatenate(owner), np.concatenate(rows)
    assert np.bincount(owner).tolist() == [6, 0, 0, 3, 1]
    whole = language_id.presence(column, dims)
    assert all(((rows[owner == i] > 0).any(0) == (whole[i] > 0)).all() for i in (0, 3, 4))
    share = np.sqrt((rows**2).sum(1))
    assert np.bincount(owner, share) == pytest.approx([1, 0, 0, 1, 1], abs=1e-5)


def test_language_score_does_not_depend_on_the_number_of_languages():
    margins = lambda n, best: np.array([[best] + [(2 - n - best) / (n - 1)] * (n - 1)])
    for n in (3, 10, 100):
        assert language_id.certainty(margins(n, (2 - n) / n))[0] == pytest.approx(0.25)
        assert language_id.certainty(margins(n, 1.0))[0] == pytest.approx(1 / (1 + 3 * np.exp(-8)))


def test_presence_kernel_by_hand():
    x = language_id.presence(pa.array(["Ab", "", None, "ab"]), 1 << 13)
    assert x.sum(1).tolist() == [3, 0, 0, 3] and (x[0] == x[3]).all()  # a, b, ab


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    clean = "river stone walk green house light water bread window garden".split()
    bad = "idiot scum worthless zorgling zorglers zorglish".split()  # one family that no list holds
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = list(rng.choice(clean, 20)) + (list(rng.choice(bad, 3)) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, None), (0, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab.filter("doc_id % 3 != 1"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if i % 3 == 1]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) >= 0.97
    edge = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "river " * 50_000, 3), (4, "idiot scum", 3)], "doc_id long, text string, predicted int")
    found = [r["predicted"] for r in toxicity.score(edge, model).orderBy("doc_id").collect()]
    assert found == [0, 0, 0, 1]
    assert toxicity.score(docs.limit(0), model).count() == 0
    untaught = toxicity.train(docs, lab.limit(0))
    assert toxicity.score(edge, untaught).filter("doc_id = 4").first()["predicted"] == 1


def simulated(n, seed=0):
    """Six voters for toxic: three good ones, a word with its stem (one vote said twice), and one that guesses."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    cast = lambda toxic, clean: rng.random(n) < np.where(y, toxic, clean)
    word = cast(0.4, 0.05)
    stem = word | cast(0.02, 0.02)
    return y, np.stack([cast(0.6, 0.02), cast(0.5, 0.02), cast(0.5, 0.03), word, stem, cast(0.15, 0.15)], 1)


def test_label_model_against_a_posterior_by_hand():
    y, v = simulated(20_000)
    model = toxicity.fit_label_model(v, 0.3)
    prior = 1 / (1 + np.exp(-model.bias))
    for votes in itertools.product((0, 1), repeat=6):
        by_class = []
        for c in (0, 1):
            p = (prior if c else 1 - prior) * np.exp(model.heard[c, int(any(votes))])
            for j, x in enumerate(votes):
                if x:
                    p *= np.exp(model.logs[j, c, votes[model.parent[j]], 1])
            by_class.append(p)
        assert model.posterior(np.array([votes]))[0] == pytest.approx(by_class[1] / sum(by_class))
    assert model.posterior(v).mean() == pytest.approx(0.3, abs=1e-3)
    assert np.mean((model.posterior(v) > 0.5) == y) > 0.9


def test_label_model_finds_who_says_the_same():
    y, v = simulated(20_000, 1)
    model = toxicity.fit_label_model(v, 0.3)
    assert model.parent[3] == 4 or model.parent[4] == 3  # word and stem are paired
    gain = lambda *j: model.evidence(np.isin(np.arange(6), j)[None])[0] - model.evidence(np.isin(np.arange(6), [5])[None])[0]
    assert gain(3, 4) < gain(3) + 0.5 * gain(4) and gain(0) > gain(5) + 1  # counted about once; a guess weighs less
    truth = [np.log(v[y, j].mean() / v[~y, j].mean()) for j in (0, 1, 2)]
    mine = [model.logs[j, 1, model.parent[j] == j and 1 or 0, 1] - model.logs[j, 0, model.parent[j] == j and 1 or 0, 1] for j in (0, 1, 2)]
    assert np.allclose(truth, mine, atol=1.0)


def test_toxicity_replaces_columns_of_its_names(spark):
    model = toxicity.train(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(spark.createDataFrame([(1, "you idiot", "x", "y")], "doc_id long, text string, score string, kept string"), model)
    assert got.columns == ["doc_id", "text", "kept", "score", "predicted"] and got.first()["predicted"] == 1 and got.first()["kept"] == "y"


PAGES = {
    "<html><head><title>T</title><script>x</script></head><body><nav><a href=1>Menu, one</a></nav><article><h1>Head</h1><p>One, two&amp; three<br>four</p><ul><li>a<li>b</ul></article><footer>f, f, f</footer></body></html>": "Head One, two& three four a b",
    "<div class='post'><p>Long <b>bo</b>ld text, with commas, and more.</div><div class='sidebar'><p>no, no, no</div><div id=comments><p>me, too</div>": "Long bold text, with commas, and more.",
    "<div class='site-header'><h2>Site, name</h2></div><div class='wrapper has-sidebar'><div class='cookie-notice'><p>We use cookies, ok</p></div><main><h1>T</h1><p>Body, of, it.</p>"
    "<section class='post-comments'><p>First, comment</p></section><div class='ad-slot'>Buy</div></main><div class='sidebar-content'><p>x, y</p></div></div>": "T Body, of, it.",
    "plain\n  text": "plain text",
    "<p>a<p>b": "a b",
    "<div>" * 3000 + "deep": "deep",
    "<table><tr><td>x<td>y<tr><td>z</table>": "x y z",
    "a < b &lt; c &am &eacute;": "a < b < c &am é",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_html_by_hand(page):
    assert html_extract.main_text(page) == PAGES[page]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/pdivarticle \"'=&;!-\nx", max_size=120))
def test_html_survives_any_markup(page):
    assert isinstance(html_extract.main_text(page), str)


def test_html_over_tables(spark):
    t = spark.createDataFrame([(1, "<p>a</p>", "x"), (2, None, "y"), (2, None, "y")], "page_id long, html string, main_text string")
    assert sorted(map(tuple, html_extract.extract(t).collect())) == [(1, "a"), (2, ""), (2, "")]
    assert html_extract.extract(t.limit(0)).count() == 0


LONG = "Long prose, with words. " * 30


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><form id=all><div><p>{LONG}</p></div></form></body>", LONG.strip()),
        ("<body><form class=entry><p>Sign in</p><input></form><p>Body text here.</p></body>", "Body text here."),
        ("<p data='x>Hello world it is</p><p>More here, it's fine</p>", "Hello world it is More here, it's fine"),
        ('<div title="a > b" class=\'c\'><a href="x"title="<b>y</b>">t</a> z</div>', "t z"),
        ("<p>one</p><!-- open <b>x</b>> <p>two, three</p>", "one x> two, three"),
        ("<!-->x<!-- a --> y<!-- b > c --> z", "x y z"),
        (f"<body><h1>T</h1><div class=content>{LONG}</div><ul><li>a</li></ul><p>Short end.</p></body>", f"T {LONG}a Short end."),
        (f"<body><div class=content>{LONG}</div><ul><li><a href=x>link</a></li></ul><p>after</p></body>", f"{LONG}after"),
        (f"<div class='content-with-sidebar'><p>{LONG}</p></div>", LONG.strip()),
        (f"<div class='post comment-closed'><p>{LONG}</p></div><div class='comment-content'><p>{LONG}{LONG}</p></div>", LONG.strip()),
    ],
)
def test_html_by_hand(page, text):
    assert html_extract.main_text(page) == text


def test_html_in_time_that_grows_with_its_length():
    import time

    began = time.process_time()
    for page in ("<div class='menu x'>" * 20_000 + "<p>text, here</p>", "<p data='x>" * 20_000, "<!-- x " * 50_000, "<p>" + "word, " * 400_000):
        html_extract.main_text(page)
    assert time.process_time() - began < 10


def test_html_replaces_a_column_of_its_name(spark):
    got = html_extract.extract(spark.createDataFrame([(1, "<p>a</p>", "old"), (2, None, None)], "page_id long, html string, main_text string"))
    assert got.columns == ["page_id", "main_text"] and sorted(map(tuple, got.collect())) == [(1, "a"), (2, "")]


def test_language_features_are_those_of_the_kernel():
    """Landmarks, K^(-1/2) and ridge by hand, from n-gram sets: the model's margins are the same."""
    rnd = np.random.default_rng(3)
    vocabulary = {"a": "sol mar luz tierra cielo".split(), "b": "haus baum licht wasser stein".split(), "c": "wind rock tree lake moon".split()}
    texts, langs = zip(*[(" ".join(rnd.choice(vocabulary[k], 12)), k) for k in "abc" * 8])
    model = language_id.fit(list(texts), list(langs), per_class=3, ridge=1e-2, dims=1 << 18)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}
    sets = [grams(t.encode()) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [i for k in "abc" for i in [j for j, lang in enumerate(langs) if lang == k][:3]]
    values, vectors = np.linalg.eigh(np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks]))
    half = vectors / np.sqrt(values) @ vectors.T  # the whole K^(-1/2)
    z = np.array([[kernel(s, sets[j]) for j in marks] for s in sets]) @ half
    y = np.array([[1.0 if lang == k else -1.0 for k in "abc"] for lang in langs])
    zc = z - z.mean(0)
    beta = np.linalg.solve(zc.T @ zc + 1e-2 * len(z) * np.eye(len(marks)), zc.T @ y)
    expected = zc @ beta + y.mean(0)
    got = model.margins(pa.array(texts, pa.string()))
    assert np.allclose(got, expected, atol=2e-3)  # hashing may join two n-grams


def test_language_sample_is_bounded_by_bytes(spark):
    rows = [(i, "short text", "en") for i in range(5)] + [(9, "long " * 1000, "en"), (10, "lang " * 2000, "de"), (11, "länger " * 3000, "de"), (12, None, "fr"), (13, "no label", None)]
    texts, langs = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200, 100)
    assert sorted(zip(langs, map(len, texts))) == [("de", 10_000), *[("en", 10)] * 5]
    got = language_id.predict(spark.createDataFrame([(1, "x", "old", 7)], "doc_id long, text string, lang_pred string, more int"), None)
    assert got.columns == ["doc_id", "text", "more", "lang_pred", "score"] and got.first()["lang_pred"] == "und"


@pytest.mark.parametrize("n", [0, 1, 200, 201, 10**6, 3 * 10**8, 10**10, 10**15])
def test_no_language_is_too_large_for_a_sample(n):
    share = _store.hash_share(n, 200)
    assert abs(share / _store.HASHES * n - min(n, 200)) < 1e-3
    assert 0 < share <= _store.HASHES


BODY = '<div class="article-body"><p>A, b, long text here.</p><p>More, text.</p></div>'


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><header><h1>T</h1></header>{BODY}</article>", "T A, b, long text here. More, text."),
        (f'<article><h1>T</h1><div class="intro"><p>Begin.</p></div>{BODY}</article>', "T Begin. A, b, long text here. More, text."),
        (f"<article><h1>T</h1>{BODY}<section><h2>H</h2><p>short</p></section></article>", "T A, b, long text here. More, text. H short"),
        (f'<div class="post"><header><h1>T</h1></header>{BODY}</div>', "T A, b, long text here. More, text."),
        (f'<article><h1>T</h1>{BODY}<div class="share-buttons"><a href=x>Tweet</a> <span>Share it</span></div></article>', "T A, b, long text here. More, text."),
        (f'<header class="post-list"><h1>Site</h1></header><main><div class="post">{BODY}</div></main>', "A, b, long text here. More, text."),
    ],
)
def test_html_keeps_articles_whole(page, text):
    assert html_extract.main_text(page) == text


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_html_of_generated_articles(data):
    """Trees of sections built beside their text, among parts that are none of it: what comes out is what went in."""
    word = st.text(alphabet="abcdefgh", min_size=1, max_size=9)
    said = []

    def text(most):
        t = " ".join(data.draw(st.lists(word, min_size=1, max_size=most)))
        said.append(t)
        return t

    def section(depth):
        out = f"<h2>{text(4)}</h2>" if data.draw(st.booleans()) else ""
        for _ in range(data.draw(st.integers(1, 3))):
            kind = data.draw(st.sampled_from(["p", "ul", "quote", "deeper", "table"]))
            if kind == "deeper" and depth < 3:
                out += f"<div class={data.draw(st.sampled_from(['part', 'text', 'x']))}>{section(depth + 1)}</div>"
            elif kind == "ul":
                out += "<ul>" + "".join(f"<li>{text(6)}" for _ in range(2)) + "</ul>"
            elif kind == "table":
                out += f"<table><tr><td>{text(3)}<td>{text(3)}</table>"
            else:
                out += f"<blockquote>{text(9)}</blockquote>" if kind == "quote" else f"<p>{text(30)}</p>"
        return out

    body = section(0) + f"<p>{text(40)}, and, more</p>"
    said[-1] += ", and, more"
    holder = data.draw(st.sampled_from(["<article>{}</article>", "<main><article class=x>{}</article></main>", "<main>{}</main>", "<div class='hentry post'>{}</div>"]))
    page = f"<nav><a href=1>menu</a></nav><div class=cookie-notice><p>We, use, cookies</p></div>{holder.format(body)}<aside><p>{'aside, ' * 30}</p></aside><footer>foot, foot</footer>"
    assert html_extract.main_text(page) == " ".join(said)
