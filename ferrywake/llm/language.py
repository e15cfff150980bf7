"""Language of words and documents by a linear-chain conditional random field.

Words (runs of letters with their combining marks, lower-cased) are labelled in their order. A word's scores come from hashed
features: its affixes, its character n-grams, and itself if it is in the lexicon of words the training
sample repeats; learned transitions join neighbours. Training maximises the likelihood of label chains
cut from documents of known language, spliced so that chains switch between languages; labelling takes
the marginals of forward-backward over the whole document, and the document gets the label with the
greatest mean marginal, which is its score.

The model is fitted on a sample bounded by SPANS chains of at most SPAN words, at most CHAINS of one
document, from about SAMPLE documents chosen by a hash of their id (the bound is the parameters' product,
whatever the input); at most LEXICON words of it have features of their own. What is sent to the executors
is the weight table: 2^BITS rows of one number for each label. Everything else covers all rows and whole
texts, with no exchange of rows.

Forward-backward runs over the chain of all documents of a batch at once, restarted at each document, in
two levels: products of the step matrices of each block, then vectors inside the blocks.

Defined results: a null text or one without letters is `und` with score 0, as is every text if no row
has a label to learn from; a row with a null doc_id is neither learned from nor held out; equal texts get
equal results; of equal means the first label in order wins.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, slices, table

LETTERS = re.compile(r"[^\W\d_]+")


def _class(kinds: str, top: int = 0x10000) -> str:
    """The characters below `top` whose category begins with one of the kinds, as the inside of a character class."""
    out, low = [], None
    for c in range(top + 1):
        inside = c < top and any(unicodedata.category(chr(c)).startswith(k) for k in kinds.split())
        if inside and low is None:
            low = c
        elif not inside and low is not None:
            out.append(f"\\U{low:08x}-\\U{c - 1:08x}")
            low = None
    return "".join(out)


#: LETTERS takes numbers such as \u00bd for letters and cuts words at combining marks: texts with either are read by WORDS.
UNUSUAL = re.compile(f"[{_class('M Nl No')}\U00010000-\U0010ffff]")
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
BITS = 18
SAMPLE = 3000
SPANS = 6000
SPAN = 48
#: Chains cut from one document, at most, so that no long one makes the sample.
CHAINS = 4
#: Words with a feature of their own, the most frequent that the sample repeats.
LEXICON = 20_000
#: Words held with their scores in one task, at most.
KNOWN = 400_000
#: Words labelled at once, unless one document has more.
AT_ONCE = 400_000
UND = "und"


def words(text: str | None) -> list[str]:
    """Runs of letters, with the marks that follow a letter, in lower case."""
    if not text:
        return []
    text = text.lower()
    return LETTERS.findall(text) if text.isascii() or not UNUSUAL.search(text) else WORDS.findall(text)


def features(ws: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, flat, and where each word's begin."""
    n = len(ws)
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in ws).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, ws), np.int64, n) + 2
    start = np.append(0, np.cumsum(size))
    place = np.arange(len(code)) - np.repeat(start[:-1], size)
    left = np.repeat(size, size) - place
    word = np.repeat(np.arange(n), size)
    c1, c2, c3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    out_f, out_w = [], []

    def add(kind: int, h: np.ndarray, w: np.ndarray) -> None:
        x = (h + np.uint64((kind + 1) * int(c3) % (1 << 64))) * c1
        x ^= x >> np.uint64(32)
        out_f.append(((x * c2) >> np.uint64(64 - BITS)).astype(np.int32))
        out_w.append(w)

    h = code.copy()
    for k in (2, 3, 4):  # n-grams, with the word's ends as characters
        h = h[:-1] * c2 + code[k - 1 :] if k > 2 else code[:-1] * c2 + code[1:]
        ok = left[: len(h)] >= k
        if k < 4:
            add(k, h[ok], word[: len(h)][ok])
        for kind, at in ((10, place[: len(h)] == 0), (20, left[: len(h)] == k)):  # affixes
            at = at & ok
            add(kind + k, h[at], word[: len(h)][at])
    known = np.fromiter((lexicon.get(w, -1) for w in ws), np.int64, n)
    at = np.flatnonzero(known >= 0)
    add(30, known[at].astype(np.uint64), at)
    f, w = np.concatenate(out_f), np.concatenate(out_w)
    by = np.argsort(w, kind="stable")
    return f[by], np.searchsorted(w[by], np.arange(n))


def summed(weights: np.ndarray, f: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[f], at, axis=0) if len(at) else np.zeros((0, weights.shape[1]))


def messages(scores: np.ndarray, first: np.ndarray, step: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward messages (a place's own scores included) and backward messages at each place of a chain, each scaled to sum
    to 1. first: whether a place starts a new chain; step[i, j]: score of label j after i; begin[j]: of starting with j."""
    n, k = scores.shape
    width = max(1, int(np.sqrt(n) / 2))
    rows = -(-n // width)
    pad = rows * width - n
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, k))]).reshape(rows, width, k)
    new = np.concatenate([first, np.ones(pad, bool)]).reshape(rows, width)
    move, start = np.exp(step - step.max()), np.exp(begin - begin.max())

    def onward(p: np.ndarray, s: int) -> np.ndarray:
        shape = (-1, *[1] * (p.ndim - 2), 1)
        q = np.where(new[:, s].reshape(shape), p.sum(axis=-1, keepdims=True) * start, p @ move) * e[:, s].reshape(-1, *[1] * (p.ndim - 2), k)
        return q / q.sum(axis=tuple(range(1, q.ndim)), keepdims=True)

    p = np.broadcast_to(np.eye(k) / k, (rows, k, k))
    for s in range(width):
        p = onward(p, s)
    a, b = np.empty((rows, k)), np.empty((rows, k))
    v = np.full(k, 1 / k)
    for r in range(rows):
        a[r] = v
        v = v @ p[r]
        v /= v.sum()
    v = np.full(k, 1 / k)
    for r in range(rows - 1, -1, -1):
        b[r] = v
        v = p[r] @ v
        v /= v.sum()
    ahead, back = np.empty((rows, width, k)), np.empty((rows, width, k))
    for s in range(width):
        a = onward(a, s)
        ahead[:, s] = a
    for s in range(width - 1, -1, -1):
        back[:, s] = b
        x = e[:, s] * b
        b = np.where(new[:, s, None], (x @ start)[:, None], x @ move.T)
        b /= b.sum(axis=1, keepdims=True)
    return ahead.reshape(-1, k)[:n], back.reshape(-1, k)[:n]


def marginals(scores: np.ndarray, first: np.ndarray, step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Probability of each label at each place of a chain."""
    a, b = messages(scores, first, step, begin)
    a *= b
    return a / a.sum(axis=1, keepdims=True)


def expected(scores: np.ndarray, first: np.ndarray, step: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradient of the log of the sum over all labellings: by the scores (the marginals), by step (expected pairs of
    neighbours) and by begin (expected first labels)."""
    a, b = messages(scores, first, step, begin)
    p = a * b
    p /= p.sum(axis=1, keepdims=True)
    on = np.flatnonzero(~first)
    ahead = np.exp(scores[on] - scores[on].max(axis=1, keepdims=True)) * b[on]
    pair = a[on - 1][:, :, None] * np.exp(step - step.max())[None] * ahead[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p, pair.sum(axis=0), p[first].sum(axis=0)


class Model:
    """Labels, hashed weights and transitions."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon, k = labels, lexicon, len(labels)
        self.weights, self.step, self.begin = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), np.zeros(k)

    def word_scores(self, ws: list[str]) -> np.ndarray:
        return summed(self.weights, *features(ws, self.lexicon))

    def label(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(scores, first, self.step, self.begin)


def unambiguous(spans: list[tuple[str, list[str]]], run: int = 4) -> list[tuple[str, list[str]]]:
    """The spans without runs of words that are found under different labels: passages that documents of several languages
    share say nothing about a language."""
    label_of: dict[tuple, str] = {}
    mixed: set[tuple] = set()
    for lab, ws in spans:
        for i in range(len(ws) - run + 1):
            g = tuple(ws[i : i + run])
            if label_of.setdefault(g, lab) != lab:
                mixed.add(g)
    out = []
    for lab, ws in spans:
        gone = [False] * len(ws)
        for i in range(len(ws) - run + 1):
            if tuple(ws[i : i + run]) in mixed:
                gone[i : i + run] = [True] * run
        at = 0
        for i in range(len(ws) + 1):
            if i == len(ws) or gone[i]:
                if i > at:
                    out.append((lab, ws[at:i]))
                at = i + 1
    return out


def fit(spans: list[tuple[str, list[str]]], epochs: int = 6, rate: float = 0.2, batch: int = 128, seed: int = 7, lexicon: int = LEXICON) -> Model | None:
    """Learns from (label, words) spans by stochastic gradients of the chain likelihood: weights, transitions, beginnings."""
    spans = unambiguous(spans) or [(lab, ws) for lab, ws in spans if ws]
    if not spans:
        return None
    labels = sorted({lab for lab, _ in spans})
    counts: dict[str, int] = {}
    for _, ws in spans:
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
    common = sorted((w for w, c in counts.items() if c > 1), key=lambda w: (-counts[w], w))[:lexicon]
    model = Model(labels, {w: i for i, w in enumerate(common)})
    number = {lab: i for i, lab in enumerate(labels)}
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in ws]) for _, ws in spans]
    f, at = features(list(vocab), model.lexicon)
    ends = np.append(at[1:], len(f))
    rng = np.random.default_rng(seed)
    squares, step_squares, begin_squares = (np.full_like(x, 1e-2) for x in (model.weights, model.step, model.begin))
    k = len(labels)
    for epoch in range(epochs):
        order = rng.permutation(len(spans))
        for i in range(0, len(order), batch):
            mine = order[i : i + batch]
            w = np.concatenate([ids[j] for j in mine])
            y = np.concatenate([np.full(len(ids[j]), number[spans[j][0]]) for j in mine])
            size = np.array([len(ids[j]) for j in mine])
            first = np.zeros(len(w), bool)
            begins = np.cumsum(size) - size
            first[begins[rng.random(len(mine)) < 0.5]] = True  # half of the spans go on from the one before
            first[0] = True
            own, back = np.unique(w, return_inverse=True)
            n = ends[own] - at[own]
            mf = f[np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            score = np.add.reduceat(model.weights[mf], np.cumsum(n) - n, axis=0).astype(np.float64)[back]
            p, pairs, begins_ = expected(score, first, model.step, model.begin)
            g = -p
            g[np.arange(len(w)), y] += 1
            per_word = np.zeros((len(own), k))
            np.add.at(per_word, back, g)
            uf, inv = np.unique(mf, return_inverse=True)
            grad = np.zeros((len(uf), k))
            np.add.at(grad, inv, np.repeat(per_word, n, axis=0))
            grad /= len(mine)
            squares[uf] += grad**2
            model.weights[uf] += rate * (grad - 1e-4 * model.weights[uf]) / np.sqrt(squares[uf])
            # transitions and beginnings: what was seen less what is expected
            inner = np.flatnonzero(~first)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[inner - 1], y[inner]), 1)
            for x, x_squares, gx in ((model.step, step_squares, seen - pairs), (model.begin, begin_squares, np.bincount(y[first], minlength=k) - begins_)):
                gx = gx / len(mine)
                x_squares += gx**2
                x += rate * gx / np.sqrt(x_squares)
                x -= x.mean()
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, documents: int = SAMPLE, spans: int = SPANS, span: int = SPAN, chains: int = CHAINS) -> list[tuple[str, list[str]]]:
    """At most `spans` chains of at most `span` words, `chains` of one document, from about `documents` of the labelled rows."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = docs.count()
    if not n:
        return []
    rank = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    some = docs.where(rank < int(min(1.0, documents / n) * (1 << 30))).select("doc_id", "text", "lang")

    def cut(batches):
        for b in batches:
            out = []
            for d, t, lang in zip(*(b.column(i).to_pylist() for i in range(3))):
                ws = words(t)
                rng = np.random.default_rng([abs(d or 0), len(ws)])
                for _ in range(min(chains, -(-len(ws) // span))):
                    i = int(rng.integers(0, max(1, len(ws) - span + 1)))
                    out.append((int(rng.integers(1 << 40)), lang, " ".join(ws[i : i + span])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))], ["rank", "lang", "words"])

    got = some.mapInArrow(cut, "rank long, lang string, words string").orderBy("rank", "lang", "words").limit(spans).collect()
    return [(r.lang, r.words.split(" ")) for r in got]


def _label(sent, text: int, names: list[str]):
    """Batches with label and score behind their columns; text: which of them is the text."""

    def work(batches):
        model: Model | None = sent.value
        known: dict[str, int] = defaultdict(count().__next__)
        scores = np.zeros((0, 0))
        for b in slices(batches, 4096):
            texts = b.column(text).to_pylist()
            lang, best = [UND] * len(texts), np.zeros(len(texts))
            held, size = [], 0

            def done():
                nonlocal scores, known
                if not size:
                    return
                if len(known) > KNOWN:
                    known, scores = defaultdict(count().__next__), np.zeros((0, 0))
                before = len(known)
                ids = np.fromiter(map(known.__getitem__, chain.from_iterable(ws for _, ws in held)), np.int64, size)
                if len(known) > before:
                    fresh = model.word_scores(list(known)[before:] if before else list(known))
                    scores = np.concatenate([scores, fresh]) if before else fresh
                n = np.array([len(ws) for _, ws in held])
                at = np.cumsum(n) - n
                first = np.zeros(len(ids), bool)
                first[at] = True
                mean = np.add.reduceat(model.label(scores[ids].astype(np.float64), first), at, axis=0) / n[:, None]
                for (i, _), m, top in zip(held, mean, mean.argmax(axis=1)):
                    lang[i], best[i] = model.labels[top], min(1.0, m[top])

            for i, t in enumerate(texts):
                ws = words(t) if model else []
                if ws:
                    held.append((i, ws))
                    size += len(ws)
                if size >= AT_ONCE:
                    done()
                    held, size = [], 0
            done()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(best)], [*b.schema.names, *names])

    return work


def train(docs: DataFrame) -> Model | None:
    """The model of the rows that are not held out. docs: doc_id, text, lang."""
    return fit(sample(docs.where(F.col("doc_id").isNotNull() & ~held_out())))


def label(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (any columns, with text) with label and score appended by the given names; other columns go through untouched."""
    if {x.lower() for x in names} & {x.lower() for x in docs.columns}:
        raise ValueError(f"columns of the names {names} are there already")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(_label(sent, docs.columns.index("text"), list(names)), schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = train(docs)
    found = label(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
