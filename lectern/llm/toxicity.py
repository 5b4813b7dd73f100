"""Toxicity by weak supervision.

Voters: every word of a lexicon and patterns over the whole text; a voter votes
for toxic or abstains. The lexicon has a fixed part for four languages and a part
that is mined from labelled training rows: words and stems that are many times
as frequent in toxic texts. So labels of the sample do name voters; beyond that
they set the class balance and choose the sample, and no label of a single text
is looked at again.

A generative label model has a hidden class, a factor for whether anybody votes
at all, and for each vote cast a factor that depends on one other voter: P(vote |
class, vote of its parent). Who abstains in a text in which others vote says
nothing: texts differ in length and language. Which voters are paired is
estimated from their dependence given the class (a spanning forest of the largest
conditional mutual information), the factors by expectation-maximisation, under
the known share of toxic texts. As abstentions are left out, this is a conditional
model of the votes cast and no normalised one of all voters. Voters that say the same, such as a word and its
stem, are so counted about once, and a voter that is heard where nobody else
votes counts for little. A logistic regression over words and stems (once, and at
least twice), patterns and capitals is then trained on the posterior labels and
scores all texts in batches.

Fitted on a bounded sample: at most about ``per_class`` labelled texts of each
class, of at most ``sample_bytes`` each, chosen by a hash of doc_id. Every text
is scored whole, from itself alone.

Defined results: null and empty texts get the score of a text without words;
repeated rows are scored one by one; rows with a null label do not teach; where
the sample lacks a class nothing is fitted, and the fixed lexicon scores with set
weights (``ALONE``: one word reaches 0.73); an empty table gives no rows. Input
columns named score or predicted are replaced; all others stay.
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

from ._bpe import frugal, hash_pieces, slices, utf8
from ._store import HASHES, hash_share, small_batches
from ._words import WORD_BYTE, lowered, runs

#: Words that insult, by language; a-z and non-ASCII letters, lower case.
LEXICON = {
    "en": "idiot moron stupid loser pathetic worthless scum trash clown disgusting dumb imbecile vermin filth jerk fool garbage coward freak creep degenerate parasite bastard dumbass".split(),
    "de": "idiot trottel dummkopf abschaum wertlos widerlich erbärmlich versager depp arschloch miststück schwachkopf".split(),
    "fr": "idiot imbécile crétin ordure minable abruti connard débile raté salaud dégoûtant pathétique".split(),
    "es": "idiota imbécil estúpido estúpida basura escoria patético asqueroso inútil perdedor payaso cabrón".split(),
}
FIXED = sorted({w for words in LEXICON.values() for w in words})
#: Weight of a word of the fixed lexicon and bias, where nothing can be fitted.
ALONE = (4.0, -3.0)
#: Patterns over the lower-cased text: threats, dismissals, and shouting.
PATTERNS = {
    "threat": r"\b(?:kill|hurt|hate) (?:you|yourself|them)\b",
    "dismissal": r"\b(?:shut up|go to hell|get lost|drop dead)\b",
    "name_calling": r"\b(?:you|you are|you're|they are|he is|she is) (?:an? )?(?:such an? )?(?:idiot|moron|loser|clown|fool|coward|scum|trash|pathetic|worthless|disgusting|stupid)\b",
    "shouting": r"!{3,}",
}
COMPILED = [re.compile(p) for p in PATTERNS.values()]

#: Lengths in bytes of the stems that stand beside the words; longer words of a family share them.
STEMS = (4, 5, 6, 7)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters, A-Z lowered) and of their stems, and the text of each."""
    data, offsets = lowered(column)
    starts, ends = runs(WORD_BYTE[data], offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    hashes, owners = [hash_pieces(data, starts, ends - starts)], [owner]
    for n in STEMS:
        longer = ends - starts > n
        stem = hash_pieces(data, starts[longer], np.full(int(longer.sum()), n))
        hashes.append(stem ^ np.uint64(n))  # a stem is not the word of the same letters
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


#: Turns the name of a word or stem into that of "at least twice".
TWICE = np.uint64(0x6A09E667F3BCC909)


def with_repeats(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, and a name of its own for each word or stem that a text holds at least twice: a stem in one word may be chance."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return np.concatenate([hashes, h[1:][same] ^ TWICE]), np.concatenate([owner, o[1:][same]])


def hash_words(words: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array(words, pa.string()))
    return hash_pieces(data, offsets[:-1], np.diff(offsets))


def mark(keys: np.ndarray, hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """texts x keys matrix: which of the sorted ``keys`` occur, at least once or twice as their names say."""
    out = np.zeros((texts, len(keys)), bool)
    if len(keys) and len(hashes):
        names = np.unique(np.concatenate([keys, keys ^ TWICE]))
        known = names[np.minimum(np.searchsorted(names, hashes), len(names) - 1)] == hashes
        hashes, owner = with_repeats(hashes[known], owner[known])
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[at] == hashes
        out[owner[hit], at[hit]] = True
    return out


def distinct_pairs(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct words, then (word index, text) of each word that a text holds."""
    keys, at = np.unique(hashes, return_inverse=True)
    code = np.unique(at * texts + owner)
    return keys, code // max(texts, 1), code % max(texts, 1)


def mine(hashes: np.ndarray, owner: np.ndarray, toxic: np.ndarray, least: int = 8, odds: float = 40.0) -> np.ndarray:
    """Words found in at least ``least`` toxic texts and ``odds`` times as often there as in clean ones."""
    keys, at, who = distinct_pairs(hashes, owner, len(toxic))
    bad = toxic[who]
    n1, n0 = np.bincount(at[bad], minlength=len(keys)), np.bincount(at[~bad], minlength=len(keys))
    rate1, rate0 = n1 / max(1, toxic.sum()), (n0 + 0.5) / max(1, (~toxic).sum())
    return keys[(n1 >= least) & (rate1 >= odds * rate0)]


def votes(column: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """texts x voters: which lexicon words occur, then which patterns do."""
    hashes, owner = words_of(column)
    return np.concatenate([mark(lexicon, hashes, owner, len(column)), patterns_of(column)], 1)


def patterns_of(column: pa.Array) -> np.ndarray:
    """texts x patterns: which of ``PATTERNS`` occur, and whether most letters (a to z) of the text are capitals."""
    out = np.zeros((len(column), len(PATTERNS) + 1), bool)
    for i, t in enumerate(column.to_pylist()):
        if t:
            low = t.lower()
            out[i, :-1] = [p.search(low) is not None for p in COMPILED]
            raw = np.frombuffer(t.encode(), np.uint8)
            out[i, -1] = ((raw >= 65) & (raw <= 90)).sum() > ((raw >= 97) & (raw <= 122)).sum()
    return out


@dataclass
class LabelModel:
    """``parent`` of each voter (itself: none), ``logs``: log P(vote | class, parent's vote), voters x class x parent's
    vote x vote; ``heard``: log P(any vote | class), class x whether; ``bias``: log odds of the classes before any evidence."""

    parent: np.ndarray
    logs: np.ndarray
    heard: np.ndarray
    bias: float

    def evidence(self, v: np.ndarray) -> np.ndarray:
        """Log odds that the votes of each row add."""
        v = v.astype(np.int64)
        gain = self.logs[:, 1, :, 1] - self.logs[:, 0, :, 1]  # of a vote, by the parent's
        cast = np.where(v == 1, gain[np.arange(v.shape[1]), v[:, self.parent]], 0.0)
        return cast.sum(1) + (self.heard[1] - self.heard[0])[v.any(1).astype(int)]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each row."""
        return _sigmoid(self.bias + self.evidence(v))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bias(evidence: np.ndarray, balance: float) -> float:
    """The log odds at which the rows are toxic in the known share."""
    low, high = -60.0, 60.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if _sigmoid(mid + evidence).mean() > balance else (mid, high)
    return low


def _tables(one: np.ndarray, other: np.ndarray, both: np.ndarray, total: float) -> np.ndarray:
    """Counts by vote of the first and vote of the second, from the counts of votes, of votes by both, and of rows."""
    return np.stack([np.stack([total - one - other + both, other - both], -1), np.stack([one - both, both], -1)], -2)


def pairs_of(v: np.ndarray, q: np.ndarray, least: float = 12.0) -> np.ndarray:
    """The parent of each voter: a spanning forest of the pairs that depend most on each other within the classes.

    ``least``: twice the rows times the conditional mutual information that a pair must have.
    """
    m = v.shape[1]
    gain = np.zeros((m, m))
    x = v.astype(np.float64)
    for w in (q, 1 - q):
        both, total = (x * w[:, None]).T @ x, max(w.sum(), 1e-9)
        one = np.diag(both)
        n = np.maximum(_tables(one[:, None], one[None, :], both, total), 0)
        apart = n.sum(-1, keepdims=True) * n.sum(-2, keepdims=True) / total
        gain += np.where(n > 0, n * np.log(np.maximum(n, 1e-12) / np.maximum(apart, 1e-12)), 0).sum((-1, -2))
    gain = np.where(2 * gain > least, gain, 0)
    np.fill_diagonal(gain, 0)
    parent, best, left = np.arange(m), np.zeros(m), np.ones(m, bool)
    for _ in range(m):  # Prim's way; a new root where nothing is tied to those taken
        i = int(np.argmax(np.where(left, best, -1)))
        left[i] = False
        nearer = left & (gain[i] > best)
        parent[nearer], best[nearer] = i, gain[i][nearer]
    return parent


def fit_label_model(v: np.ndarray, balance: float, rounds: int = 24) -> LabelModel:
    """EM from "any vote at all". Pairs are chosen anew up to two thirds of the rounds; then only factors are estimated."""
    m = v.shape[1]
    any_vote, cols, x = v.any(1), np.arange(m), v.astype(np.float64)
    q = np.where(any_vote, 0.9, balance * 0.1)
    parent = cols
    for i in range(rounds):
        if i and i % 4 == 0 and i <= 2 * rounds // 3:
            parent = pairs_of(v, q)
        logs, heard = np.zeros((m, 2, 2, 2)), np.zeros((2, 2))
        for c, w in enumerate((1 - q, q)):
            one, total = w @ x, w.sum()
            alone = np.stack([total - one + 0.5, one + 0.5], 1) / (total + 1.0)  # P(vote | class)
            n = _tables(one[parent], one, w @ (x * x[:, parent]), total)
            tied = (n + 2 * alone[:, None, :]) / (n.sum(-1, keepdims=True) + 2)
            logs[:, c] = np.log(np.where((parent == cols)[:, None, None], alone[:, None, :], tied))
            heard[c] = np.log((np.array([w[~any_vote].sum(), w[any_vote].sum()]) + 0.5) / (w.sum() + 1.0))
        model = LabelModel(parent, logs, heard, 0.0)
        model.bias = _bias(model.evidence(v), balance)
        q = model.posterior(v)
    return model


@dataclass
class ToxicityModel:
    keys: np.ndarray  # sorted word hashes
    weights: np.ndarray  # of keys, then of patterns
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        x = votes(column, self.keys)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit_classifier(column: pa.Array, q: np.ndarray, sample_weight: np.ndarray, features: int = 400, ridge: float = 0.05) -> ToxicityModel:
    """Logistic regression on soft labels, over the ``features`` words that tell the classes apart best."""
    hashes, owner = words_of(column)
    keys, at, who = distinct_pairs(*with_repeats(hashes, owner), len(column))
    n = np.bincount(at, minlength=len(keys))
    p = q.mean()
    z = (np.bincount(at, q[who], len(keys)) - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
    best = np.argsort(-np.abs(z), kind="stable")[:features]
    keys = np.sort(keys[best[(np.abs(z[best]) > 6) & (n[best] >= 5)]])
    x = np.concatenate([votes(column, keys), np.ones((len(column), 1), bool)], 1).astype(np.float64)
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(12):
        pred = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = sample_weight * np.maximum(pred * (1 - pred), 1e-4)
        grad = x.T @ (sample_weight * (q - pred)) - penalty @ beta
        beta += np.linalg.solve(x.T @ (w[:, None] * x) + penalty, grad)
    return ToxicityModel(keys, beta[:-1], float(beta[-1]))


def fit(texts: list[str | None], toxic: list[int], balance: float) -> ToxicityModel:
    """``toxic`` labels mine words and give the sample's balance; ``balance``: share of toxic texts in the table."""
    column = pa.array(texts, pa.string())
    label = np.array(toxic, bool)
    hashes, owner = words_of(column)
    lexicon = np.unique(np.concatenate([hash_words(FIXED), mine(*with_repeats(hashes, owner), label)]))
    v = votes(column, lexicon)
    v = v[:, v.any(0)]
    in_sample = float(np.clip(label.mean() if len(label) else 0.5, 0.02, 0.98))
    q = fit_label_model(v, in_sample).posterior(v) if v.shape[1] else np.full(len(texts), in_sample)
    # the sample holds the classes in other shares than the table
    weight = q * balance / in_sample + (1 - q) * (1 - balance) / (1 - in_sample)
    return fit_classifier(column, q, weight)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, sample_bytes: int = 1 << 15) -> ToxicityModel:
    """``docs``: doc_id, text and ``labels``: doc_id, toxic, training rows only."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "toxic")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) == 2:
        lot = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(HASHES))
        share = F.when(F.col("toxic") == 1, hash_share(counts[1], per_class)).otherwise(hash_share(counts[0], per_class))
        chosen = known.filter(lot < share).distinct()  # about per_class rows of each class
        text = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
        rows = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).orderBy("doc_id", "text", "toxic").limit(3 * per_class).collect()
        if len({r["toxic"] for r in rows}) == 2:
            return fit([r["text"] for r in rows], [r["toxic"] for r in rows], counts[1] / (counts[0] + counts[1]))
    weights = np.append(np.full(len(FIXED), ALONE[0]), np.zeros(len(PATTERNS) + 1))
    return ToxicityModel(np.sort(hash_words(FIXED)), weights, ALONE[1])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """Adds score and predicted to every row of ``docs``, from ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    source = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows in batches:
            texts = rows.column(rows.schema.get_field_index("text"))
            got = [m.score(texts.slice(a, b - a)) for a, b in slices(texts)]
            s = np.concatenate(got) if got else np.zeros(0)
            out = [*rows.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, schema=rows.schema.append(pa.field("score", pa.float64())).append(pa.field("predicted", pa.int32())))

    return source.mapInArrow(frugal(run), schema)
