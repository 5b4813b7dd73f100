"""Language ID: a string kernel, Nystrom landmarks and one-versus-rest kernel ridge.

Every text is laid out in pieces of at most ``PIECE`` bytes that together hold
each of its n-grams once. The kernel of two pieces counts the n-grams (UTF-8
bytes of the text with A-Z lowered, n = 1..4: a blended spectrum) that are
present in both, over the geometric mean of how many each has. n-grams are
hashed to ``dims`` buckets; as pieces are bounded, these never fill up. The
kernel of two texts is the mean over all pairs of their pieces, by the number of
letters in each piece, so it does not fall with a text's length. Landmarks are
training texts; with K their kernel matrix, a text's features are its kernel
row times K^(-1/2), and a ridge regression for each language is fitted on them.
Scoring is presence matrix x landmarks, then x weights, in batches.

The score follows from the lead of the best language over the mean of the
others, so it depends neither on the text's length nor on the number of
languages: a text that speaks for none gets 0.25, a sure one nearly 1, and with
one language alone it is 1.

The classifier is fitted on a bounded, documented sample: at most about
``per_lang`` texts of each language, of at most ``sample_bytes`` each (or as long
as a language's shortest text, where that is longer), chosen by a hash of doc_id.
All texts are scored whole.

Defined results: null texts and texts without a letter get ``und`` and score
0.0; repeated rows are scored one by one; an empty table gives no rows; without
labelled rows every text gets ``und``. Input columns named lang_pred or score are
replaced; all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bpe import frugal, slices
from ._store import HASHES, hash_share, small_batches
from ._words import WORD_BYTE, lowered

ORDERS = (1, 2, 3, 4)
PIECE = 1024
UNDETERMINED = "und"
ASCII_LETTER = re.compile("[A-Za-z]")


def _mark(data: np.ndarray, rows: np.ndarray, left: np.ndarray, texts: int, dims: int) -> np.ndarray:
    """texts x dims matrix of the n-grams that start at each byte, of row ``rows`` and with ``left`` bytes to the text's end."""
    out, n = np.zeros((texts, dims), bool), len(rows)
    flat = out.reshape(-1)
    gram = np.zeros(n, np.uint32)
    for order in range(1, max(ORDERS) + 1):
        gram = gram * np.uint32(0x01000193) + data[order - 1 : order - 1 + n] + np.uint32(1)
        if order not in ORDERS:
            continue
        h = (gram ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        whole = left >= order
        flat[rows[whole] * dims + (h[whole] & np.uint32(dims - 1))] = True
    return out.astype(np.float32)


def presence(column: pa.Array, dims: int) -> np.ndarray:
    """texts x dims matrix of n-gram presence, float32."""
    data, offsets = lowered(column)
    rows = np.repeat(np.arange(len(column), dtype=np.int64), np.diff(offsets))
    return _mark(data, rows, offsets[1:][rows] - np.arange(len(rows)), len(column), dims)


def pieces(column: pa.Array, dims: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts and rows of n-gram presence of their pieces, in order: length 1 times the piece's share of its text's letters.

    An n-gram belongs to the piece it starts in. The shares of a text without letters are equal.
    """
    data, offsets = lowered(column)
    sizes = np.diff(offsets)
    parts = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), parts)
    if not len(owner):
        return
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    bounds = np.append(offsets[owner] + nth * sizes[owner] // parts[owner], offsets[-1])
    letters = np.add.reduceat(WORD_BYTE[data[: offsets[-1]]], bounds[:-1], dtype=np.int64)
    total = np.bincount(owner, letters, len(sizes))[owner]
    share = np.where(total > 0, letters / np.maximum(total, 1), 1 / parts[owner])
    for a in range(0, len(owner), block):
        z = min(a + block, len(owner))
        rows = np.repeat(np.arange(z - a), np.diff(bounds[a : z + 1]))
        left = offsets[owner[a:z] + 1][rows] - np.arange(bounds[a], bounds[z])
        x = _mark(data[bounds[a] :], rows, left, z - a, dims)
        yield owner[a:z], x * (share[a:z] / np.sqrt(x.sum(1))).astype(np.float32)[:, None]


def add_up(out: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
    """Adds the rows ``values`` to the rows of ``out`` named by ``owner``, which is sorted."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    out[owner[first]] += np.add.reduceat(values, first, axis=0)


def mean_pieces(column: pa.Array, dims: int) -> np.ndarray:
    """texts x dims matrix: the weighted mean of each text's pieces."""
    out = np.zeros((len(column), dims), np.float32)
    for owner, x in pieces(column, dims):
        add_up(out, owner, x)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


@dataclass
class LanguageModel:
    """langs; landmarks (m x dims, means of their pieces); weights (m x langs), bias."""

    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    dims: int

    def margins(self, column: pa.Array) -> np.ndarray:
        kernel = np.zeros((len(column), len(self.landmarks)))
        for owner, x in pieces(column, self.dims):
            add_up(kernel, owner, x @ self.landmarks.T)
        return kernel @ self.weights + self.bias


def fit(texts: list[str], langs: list[str], per_class: int = 32, ridge: float = 1e-2, dims: int = 1 << 13) -> LanguageModel:
    """Fits on labelled texts. The first ``per_class`` texts of a language are landmarks."""
    names = sorted(set(langs))
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    x = np.concatenate([mean_pieces(pa.array(texts[a : a + 64], pa.string()), dims) for a in range(0, len(texts), 64)])
    order = [i for name in names for i in [j for j, lang in enumerate(langs) if lang == name][:per_class]]
    marks = x[order]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])  # K^(-1/2) on the range of K
    z = (x @ marks.T).astype(np.float64) @ root
    mean, share = z.mean(0), len(y) / (len(names) * np.maximum((y > 0).sum(0), 1))
    weight = np.array([share[names.index(lang)] for lang in langs])[:, None]  # languages count alike
    zc = z - mean
    beta = np.linalg.solve(zc.T @ (weight * zc) + ridge * len(y) * np.eye(z.shape[1]), zc.T @ (weight * y))
    offset = (weight * (y - zc @ beta)).sum(0) / weight.sum()
    return LanguageModel(names, marks.astype(np.float32), root @ beta, offset - mean @ beta, dims)


def training_sample(labelled: DataFrame, per_lang: int, sample_bytes: int) -> tuple[list[str], list[str]]:
    """About ``per_lang`` texts of each language, by a hash of doc_id: a share per language, no sort of all rows."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    size = F.octet_length("text")
    found = rows.groupBy("lang").agg(F.count_if(size <= sample_bytes).alias("n"), F.min(size).alias("least")).collect()  # one row per language
    if not found:
        return [], []
    entry = lambda r: (F.lit(r["lang"]), F.struct(F.lit(max(sample_bytes, r["least"])).alias("bytes"), F.lit(hash_share(r["n"], per_lang)).alias("share")))
    terms = F.element_at(F.create_map(*[x for r in sorted(found, key=lambda r: r["lang"]) for x in entry(r)]), F.col("lang"))
    rows = rows.filter((size <= terms["bytes"]) & (F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(HASHES)) < terms["share"]))
    got = rows.orderBy(F.xxhash64("doc_id"), "text").limit(2 * per_lang * len(found)).collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def train(labelled: DataFrame, per_lang: int = 200, per_class: int = 32, sample_bytes: int = 1 << 16) -> LanguageModel | None:
    texts, langs = training_sample(labelled, per_lang, sample_bytes)
    return fit(texts, langs, per_class) if texts else None


def certainty(margins: np.ndarray) -> np.ndarray:
    """Score of each row's best language by its lead over the mean of the others: what a softmax gives when three others stand there."""
    n = margins.shape[1]
    if n < 2:
        return np.ones(len(margins))
    best = margins.max(1)
    lead = best - (margins.sum(1) - best) / (n - 1)
    return 1 / (1 + 3 * np.exp(-4 * lead))


def predict(docs: DataFrame, model: LanguageModel | None, batch: int = 64) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def score(columns: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows in columns:
            texts = rows.column(rows.schema.get_field_index("text"))
            preds, scores = [], []
            for a, b in slices(texts):
                for c in range(a, b, batch):
                    part = texts.slice(c, min(batch, b - c))
                    known = [has_letter(t) and m is not None for t in part.to_pylist()]
                    if m is None:
                        preds += [UNDETERMINED] * len(part)
                        scores += [0.0] * len(part)
                        continue
                    f = m.margins(part)
                    preds += [m.langs[k] if ok else UNDETERMINED for k, ok in zip(f.argmax(1).tolist(), known)]
                    scores += [float(v) if ok else 0.0 for v, ok in zip(certainty(f), known)]
            out = [*rows.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, schema=rows.schema.append(pa.field("lang_pred", pa.string())).append(pa.field("score", pa.float64())))

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*keep)
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(frugal(score), schema)
