"""Toxicity by a linear-chain conditional random field over words.

Labels mark whole documents, so tokens get theirs by distant supervision. A word's
features are itself and its first 4 to 8 bytes, hashed to a fixed number of buckets. Over
all learning texts (equal texts once) a bucket is a *cue* if it occurs in at least ``TEXTS``
toxic texts, at least ``RATIO`` times as often per word in toxic texts as in clean ones, and
in more toxic texts than chance would give (``_by_chance``); its strength is the logarithm of that ratio. In a toxic text the
words with a cue are labelled toxic, all other words clean.

The field has the states clean and toxic. Emission features of a word are its strongest
cue, whether it has one, and the neighbours' strongest cue; the text begins in the clean
state. It is fitted on windows of a bounded sample of learning documents (``sample``), half
of each label if there are so many; windows are weighted by the labels' true shares.
Forward-backward marginals give each word its probability of being toxic; their sum, their
density and their maximum give the document's score by a logistic regression that is
fitted on the same sample, its constant corrected for the shares. Words of probability 0.5 or more are the offending spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agriclime.llm.common import append_columns, flat, small, steps
from agriclime.llm.hashing import LOWER, prefix, seeds, span_hash, words
from agriclime.sources.tables import materialize

BUCKETS = 1 << 20
TEXTS = 3
CHANCE = 0.05  # of any bucket becoming a cue by chance
RATIO = 10.0
SAMPLE = 6_000
WINDOW = 64
_PREFIXES = (4, 5, 6, 7, 8)
_SEEDS = seeds(len(_PREFIXES) + 1, 1)
_CHUNK = 64

# Letters are ASCII letters and all bytes of multi-byte characters.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters; all else as it is."""
    out = LOWER[data]
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)
    out[second] += 32
    return out


def _features(texts: pa.Array):
    """Buckets (feature x word; -1: none), word starts and ends, first word of each text."""
    data, starts = flat(texts)
    data = _lower(data)
    begin, end, first = words(data, starts, _NO_LETTER)
    sums = prefix(data)
    buckets = np.full((len(_PREFIXES) + 1, len(begin)), -1, np.int64)
    mask = np.uint64(BUCKETS - 1)
    buckets[0] = (span_hash(sums, begin, end) ^ _SEEDS[0]) & mask
    for k, length in enumerate(_PREFIXES, 1):
        at = np.flatnonzero(end - begin > length)
        buckets[k, at] = (span_hash(sums, begin[at], begin[at] + length) ^ _SEEDS[k]) & mask
    return data, starts, buckets, begin, end, first


def _counter(wanted: np.ndarray | None):
    """Occurrences and texts of each bucket, over a partition; bucket -1 holds all words."""

    def run(batches):
        total, occurs, texts = 0, np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in steps(batch, "text"):
                _, _, buckets, begin, _, first = _features(part.column("text"))
                total += len(begin)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                owner = np.broadcast_to(owner, buckets.shape)[buckets >= 0]
                own = buckets[buckets >= 0]
                if wanted is not None:
                    owner, own = owner[wanted[own]], own[wanted[own]]
                occurs += np.bincount(own, minlength=BUCKETS)
                pairs = np.unique(owner * BUCKETS + own)
                texts += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(occurs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(occurs[at], total)), pa.array(np.append(texts[at], 0))],
            ["bucket", "occurs", "texts"],
        )

    return run


@dataclass
class Model:
    strength: np.ndarray  # of each bucket, 0: no cue
    emission: np.ndarray  # constant, strongest cue, has one, neighbours' strongest
    transition: np.ndarray  # log weights, state before x state
    document: np.ndarray | None = None  # logistic regression, standardised inputs
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None


def _cue(strength: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    out = np.zeros(buckets.shape[1], np.float32)
    for row in buckets:
        np.maximum(out, np.where(row >= 0, strength[row], 0), out=out)
    return out


def _emissions(cue: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Features of each word; ``edge`` marks a text's first word."""
    before, after = np.zeros_like(cue), np.zeros_like(cue)
    before[1:], after[:-1] = cue[:-1], cue[1:]
    before[edge] = 0
    after[:-1][edge[1:]] = 0
    return np.stack([np.ones_like(cue), cue, cue > 0, np.maximum(before, after)], -1)


def marginals(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of every word, exactly.

    ``score`` holds the toxic state's log weights of the words of all texts; ``first`` each
    text's first word. Texts are cut into chunks: chunk products first, then states at
    chunk borders, then all words, each step over all chunks at once.
    """
    lengths = np.diff(first)
    per = -(-lengths // _CHUNK)
    chunk0 = np.concatenate([[0], np.cumsum(per)])
    chunks = int(chunk0[-1])
    if not chunks:
        return np.zeros(0)
    text = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(chunks) - chunk0[text]
    begin = first[text] + number * _CHUNK
    size = np.minimum(_CHUNK, first[text + 1] - begin)
    weights = np.exp(transition)
    gain = np.exp(np.clip(score, -50, 50))
    longest = int(size.max())
    place = np.minimum(begin + np.arange(longest)[:, None], len(score) - 1)
    held = np.arange(longest)[:, None] < size
    g = np.where(held, gain[place], 1.0)
    product = np.broadcast_to(np.eye(2), (chunks, 2, 2)).copy()
    for t in range(longest):
        step = product @ weights
        step[:, :, 1] *= g[t][:, None]
        step /= step.sum((1, 2), keepdims=True)
        product = np.where(held[t][:, None, None], step, product)
    ahead, behind = np.zeros((chunks, 2)), np.ones((chunks, 2))
    ahead[number == 0] = (1.0, 0.0)
    order = np.argsort(number, kind="stable")
    bounds = np.searchsorted(number[order], np.arange(per.max() + 1))
    for k in range(1, int(per.max())):
        at = order[bounds[k] : bounds[k + 1]]
        v = np.einsum("ci,cij->cj", ahead[at - 1], product[at - 1])
        ahead[at] = v / v.sum(1, keepdims=True)
    for k in range(int(per.max()) - 1, 0, -1):
        at = order[bounds[k] : bounds[k + 1]]
        v = np.einsum("cij,cj->ci", product[at], behind[at])
        behind[at - 1] = v / v.sum(1, keepdims=True)
    alphas = np.empty((longest, chunks, 2))
    state = ahead
    for t in range(longest):
        step = state @ weights
        step[:, 1] *= g[t]
        step /= step.sum(1, keepdims=True)
        state = np.where(held[t][:, None], step, state)
        alphas[t] = state
    out = np.empty((longest, chunks))
    state = behind
    for t in range(longest - 1, -1, -1):
        joint = alphas[t] * state
        out[t] = joint[:, 1] / joint.sum(1)
        step = state.copy()
        step[:, 1] *= g[t]
        step = step @ weights.T
        step /= step.sum(1, keepdims=True)
        state = np.where(held[t][:, None], step, state)
    return out.T[held.T]


def _by_chance(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Bound (Chernoff) of the log probability of so many toxic ones among a bucket's texts."""
    n = np.maximum(toxic + clean, 1)
    p = toxic / n
    apart = p * np.log(np.maximum(p, 1e-300) / share) + (1 - p) * np.log(np.maximum(1 - p, 1e-300) / (1 - share))
    return np.where(p > share, -n * apart, 0.0)


def fit_field(features: np.ndarray, labels: np.ndarray, held: np.ndarray, rounds: int = 300, weight: np.ndarray | None = None):
    """Weights of the field by gradient ascent on windows (window x word), L2 penalty."""
    count, length = labels.shape
    theta = np.array([-3.0, 0.5, 0.5, 0.0])
    trans = np.zeros((2, 2))
    y = labels.astype(int)
    before = np.concatenate([np.zeros((count, 1), int), y[:, :-1]], 1)
    seen = np.zeros((2, 2))
    w = np.ones(count) if weight is None else weight
    np.add.at(seen, (before[held], y[held]), np.broadcast_to(w[:, None], held.shape)[held])
    m, v = np.zeros(8), np.zeros(8)
    total = (held * w[:, None]).sum()
    for step in range(1, rounds + 1):
        weights = np.exp(trans)
        g = np.where(held, np.exp(np.clip(features @ theta, -50, 50)), 1.0)
        alpha = np.empty((length + 1, count, 2))
        alpha[0] = (1.0, 0.0)
        for t in range(length):
            nxt = alpha[t] @ weights
            nxt[:, 1] *= g[:, t]
            nxt /= nxt.sum(1, keepdims=True)
            alpha[t + 1] = np.where(held[:, t, None], nxt, alpha[t])
        beta, p, pairs = np.ones((count, 2)), np.zeros(held.shape), np.zeros((2, 2))
        for t in range(length - 1, -1, -1):
            right = beta.copy()
            right[:, 1] *= g[:, t]
            joint = alpha[t][:, :, None] * weights * right[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            joint[~held[:, t]] = 0
            pairs += (joint * w[:, None, None]).sum(0)
            p[:, t] = joint[:, :, 1].sum(1)
            nxt = right @ weights.T
            beta = np.where(held[:, t, None], nxt / nxt.sum(1, keepdims=True), beta)
        grad_theta = np.einsum("ct,ctf->f", (labels - p) * held * w[:, None], features) / total - 1e-4 * theta
        grad_trans = (seen - pairs) / total - 1e-4 * trans
        grad = np.concatenate([grad_theta, grad_trans.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        theta, trans = theta + move[:4], trans + move[4:].reshape(2, 2)
    return theta, trans


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all weights but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - ridge @ w)
    return w


def _document_inputs(total, n, most) -> np.ndarray:
    density = total / np.maximum(n, 1)
    return np.column_stack([np.log1p(total), np.log(density + 1e-3), most])


def _read(model: Model, texts: pa.Array):
    """Per word: probability, start and end byte; per text: first word; the bytes."""
    data, starts, buckets, begin, end, first = _features(texts)
    edge = np.zeros(len(begin), bool)
    edge[first[:-1][first[:-1] < first[1:]]] = True
    score = _emissions(_cue(model.strength, buckets), edge) @ model.emission
    return marginals(score, first, model.transition), begin, end, first, data, starts


def _per_text(p: np.ndarray, first: np.ndarray):
    n = np.diff(first)
    total, most = np.zeros(len(n)), np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        total[full] = np.add.reduceat(p, first[full])
        most[full] = np.maximum.reduceat(p, first[full])
    return total, n, most


def learning_rows(documents: DataFrame, labels: DataFrame, learn) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents that pass ``learn``, equal texts once.

    A text with several labels counts as toxic if one of them says so; null labels, ids
    and texts teach nothing.
    """
    marks = labels.where("doc_id is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = documents.select("doc_id", "text").where(F.col("text").isNotNull() & learn)
    keys = known.select("doc_id", F.xxhash64("text").alias("_text")).join(marks, "doc_id")
    one = keys.groupBy("_text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    one = materialize(one.drop("_text"), "crf-rows")
    return materialize(known.join(small(one), "doc_id"), "crf-texts")


def learn(rows: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of (doc_id, text, toxic) rows; None without toxic or without clean texts."""
    spark = rows.sparkSession
    schema = "bucket long, occurs long, texts long"

    def counted(toxic: int, wanted=None):
        found = rows.where(F.col("toxic") == toxic).select("text").mapInArrow(_counter(wanted), schema)
        return found.groupBy("bucket").agg(F.sum("occurs").alias("occurs"), F.sum("texts").alias("texts"))

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    cues = counted(1).where((F.col("bucket") < 0) | (F.col("texts") >= TEXTS)).toPandas()
    all_toxic = max(1, cues.loc[cues.bucket < 0, "occurs"].sum())
    cues = cues[cues.bucket >= 0]
    wanted = np.zeros(BUCKETS, bool)
    wanted[cues.bucket] = True
    clean = counted(0, wanted).toPandas()
    all_clean = max(1, clean.loc[clean.bucket < 0, "occurs"].sum())
    clean = clean[clean.bucket >= 0]
    in_clean = np.zeros(BUCKETS)
    in_clean[clean.bucket] = clean.occurs
    clean_texts = np.zeros(BUCKETS)
    clean_texts[clean.bucket] = clean.texts
    ratio = ((cues.occurs.to_numpy() + 0.5) / all_toxic) / ((in_clean[cues.bucket] + 0.5) / all_clean)
    strength = np.zeros(BUCKETS, np.float32)
    share = sizes[1] / (sizes[0] + sizes[1])
    chance = _by_chance(cues.texts.to_numpy(), clean_texts[cues.bucket], share)
    sure = chance <= np.log(CHANCE / max(1, len(cues)))
    strength[cues.bucket] = np.where((ratio >= RATIO) & sure, np.log(ratio), 0)

    # ``sample`` bounds the broadcast; texts stay where they are.
    wanted_toxic = min(sizes[1], max(sample // 2, sample - sizes[0]))
    drawn = None
    for toxic, count in ((1, wanted_toxic), (0, sample - wanted_toxic)):
        one = rows.where(F.col("toxic") == toxic).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(count)
        drawn = one if drawn is None else drawn.unionByName(one)
    picked = rows.join(F.broadcast(drawn), "doc_id")
    shared = spark.sparkContext.broadcast(strength)

    def windows(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                _, _, buckets, _, _, first = _features(part.column("text"))
                cue = _cue(shared.value, buckets)
                rows_out = []
                for a, b in zip(first[:-1], first[1:]):
                    at = a + int(np.argmax(cue[a:b] > 0)) if b > a else a
                    start = min(max(a, at - WINDOW // 2), max(a, b - WINDOW))
                    rows_out.append(cue[start : min(b, start + WINDOW)].astype(float).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), pa.array(rows_out, pa.list_(pa.float64()))], ["toxic", "cue"]
                )

    picked = materialize(picked, "crf-sample")
    found = picked.select("toxic", "text").mapInArrow(windows, "toxic int, cue array<double>").toPandas()
    held = np.array([np.arange(WINDOW) < len(c) for c in found.cue])
    cue = np.zeros(held.shape, np.float32)
    cue[held] = np.concatenate([np.asarray(c, np.float32) for c in found.cue])
    edge = np.zeros(held.shape, bool)
    edge[:, 0] = True
    features = _emissions(cue.ravel(), edge.ravel()).reshape(*held.shape, 4).astype(float)
    labels = (cue > 0) & (found.toxic.to_numpy()[:, None] == 1)
    marks = found.toxic.to_numpy()
    times = np.array([sizes[k] / max(1, (marks == k).sum()) for k in (0, 1)])
    weight = times[marks] / times[marks].mean()
    theta, trans = fit_field(features, labels, held, weight=weight)
    model = Model(strength, theta, trans)

    scored = score(picked, model).select("toxic", "n_words", "expected", "most").toPandas()
    inputs = _document_inputs(scored.expected.to_numpy(), scored.n_words.to_numpy(), scored.most.to_numpy())
    model.centre, model.spread = inputs.mean(0), inputs.std(0) + 1e-9
    model.document = _logistic((inputs - model.centre) / model.spread, scored.toxic.to_numpy())
    model.document[0] += np.log(times[1] / times[0])
    return model


def score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``score``, ``n_words``, ``expected``, ``most`` and ``spans``.

    ``expected`` is the sum and ``most`` the maximum of the words' probabilities, ``spans``
    the offending words (start and end character, probability) in order. A null text is
    scored as an empty one; without a model every score is 0.
    """
    span = T.StructType(
        [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]
    )
    fields = [
        T.StructField("score", T.DoubleType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("expected", T.DoubleType()),
        T.StructField("most", T.DoubleType()),
        T.StructField("spans", T.ArrayType(span)),
    ]
    shared = df.sparkSession.sparkContext.broadcast(model) if model else None

    def compute(texts):
        own = shared.value if shared else Model(np.zeros(BUCKETS, np.float32), np.zeros(4), np.zeros((2, 2)))
        p, begin, end, first, data, starts = _read(own, texts)
        if shared is None:
            p = np.zeros(len(p))
        total, n, most = _per_text(p, first)
        result = np.zeros(len(n))
        if own.document is not None:
            inputs = (_document_inputs(total, n, most) - own.centre) / own.spread
            result = 1 / (1 + np.exp(-np.clip(own.document[0] + inputs @ own.document[1:], -30, 30)))
        at = np.flatnonzero(p >= 0.5)
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        owner = np.searchsorted(first, at, "right") - 1
        base = characters[starts[owner]]
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(at, first), pa.int32()),
            pa.StructArray.from_arrays(
                [
                    pa.array(characters[begin[at]] - base, pa.int32()),
                    pa.array(characters[end[at]] - base, pa.int32()),
                    pa.array(p[at], pa.float64()),
                ],
                ["start", "end", "p"],
            ),
        )
        return [pa.array(result), pa.array(n.astype(np.int64)), pa.array(total), pa.array(most), spans]

    return append_columns(df, text, fields, compute)
