"""A document classifier from weak labels: good, junk or toxic.

Overlapping heuristic labellers vote on every document or abstain. How often each labeller gives each vote for each class is not known: it is
estimated by expectation-maximisation over the counts of vote patterns of the whole table, of which there are at most 3 to the power of the
number of labellers at any size. The posterior of each pattern is then the soft label on which a linear scorer over hashed features (words
and binned measurements) is trained, on a bounded sample. The scorer decides on all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrail.llm.shared import Scratch, cleared, column, slices, text_buffers, widened
from rowtrail.llm.words import BLANK, KEEP, LOWER, SEPARATOR, U, mix, segment_sum, words_of

CLASSES = ("good", "junk", "toxic")
TRAIN_ROWS = 8_000
"""Rows that the scorer is trained on, the smallest hashes of doc_id. The only part of the table that is bounded."""
LABEL_ROWS, LEXICON_SIZE = 20_000, 5_000
"""Labelled rows from which further insults are learned, and how many of them at most."""
BUCKETS = 1 << 16
BINS = 12
# Frequent words of English, German, French and Spanish.
COMMON = (
    "the of and to in is that it was for on are as with be by this have from or at not an but they which "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et en un une du que est pour qui dans sur pas par au avec "
    "el los las y del que se por con su para no al lo como más"
).split()
# Insults that hardly stand in neutral prose.
INSULTS = (
    "idiot idiots moron morons imbecile stupid dumbass loser losers scum trash garbage clown clowns pathetic worthless disgusting "
    "bastard bitch asshole fuck fucking shit vermin filthy retard retarded whore slut "
    "idiotisch dummkopf arschloch abschaum wertlos "
    "connard salope merde débile ordure "
    "imbécil estúpido basura mierda escoria"
).split()


def _hashes(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    return np.unique(words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True, blank=SEPARATOR).hashes)


COMMON_HASHES, INSULT_HASHES = _hashes(COMMON), _hashes(INSULTS)
UPPER, LETTER, SIGN, ENDING = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
SIGN[[ord(c) for c in "#$%&*!|@^~=+<>{}[]\\_"]] = True
ENDING[[ord(c) for c in ".,;:!?"]] = True



def stems(data: np.ndarray, content) -> np.ndarray:
    """Hashes of the first five bytes of each word, lower-cased; kept apart from hashes of whole words."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data]
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    return mix((eight[content.starts] & KEEP[np.minimum(content.ends - content.starts, 5)]) ^ U(0x9FB21C651E98DF25))


# name, junk from, good from, good to (as shares); between them the labeller abstains
MEASURES = (
    ("upper", (0.4, 1.1), (-1, 0.25)),
    ("signs", (0.06, 1.1), (-1, 0.02)),
    ("sign_words", (0.15, 1.1), (-1, 0.03)),
    ("repeats", (0.15, 1.1), (-1, 0.05)),
    ("sameness", (0.7, 1.1), (-1, 0.5)),
    ("top_word", (0.25, 1.1), (-1, 0.15)),
    ("endings", (-1, 0.02), (0.03, 0.4)),
    ("common", (-1, 0.02), (0.06, 0.8)),
    ("long_words", (0.5, 1.1), (-1, 0.25)),
)
LEXICON = ("insults", "insult_share", "insult_kinds")
LABELLERS = len(MEASURES) + len(LEXICON)


def measure(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray = INSULT_HASHES):
    """Measurements (one row per text), number of words, and the content words of texts lying one after the other."""
    words = words_of(data, offsets)
    content = words_of(data, offsets, lower=True, blank=SEPARATOR)
    n = np.maximum(words.counts, 1)
    per = lambda flags, at: segment_sum(flags.astype(np.int64), at)
    solid = np.maximum(per(~BLANK[data], offsets), 1)
    last = data[words.ends - 1] if len(words.ends) else data[:0]
    h, m = content.hashes, np.maximum(content.counts, 1)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[content.bounds[:-1][content.counts > 0]] = False
    kinds, insult_kinds = (np.zeros(len(n), np.int64) for _ in range(2))
    insult = np.isin(h, lexicon) | np.isin(stems(data, content), lexicon)
    top = np.zeros(len(n))
    for i, (lo, hi) in enumerate(zip(content.bounds[:-1], content.bounds[1:], strict=True)):
        if lo == hi:
            continue
        _, times = np.unique(h[lo:hi], return_counts=True)
        kinds[i], top[i] = len(times), times.max() / (hi - lo) if hi - lo >= 20 else 0
        insult_kinds[i] = len(np.unique(h[lo:hi][insult[lo:hi]])) if insult[lo:hi].any() else 0
    insults = per(insult, content.bounds)
    out = {
        "upper": per(UPPER[data], offsets) / np.maximum(per(LETTER[data], offsets), 1),
        "signs": per(SIGN[data], offsets) / solid,
        "sign_words": per(SIGN[last], words.bounds) / n,
        "repeats": per(again, content.bounds) / m,
        # the more words, the more of them come again: measured against what a text of that length has at least
        "sameness": np.where(content.counts >= 20, 1 - np.minimum(kinds / np.minimum(m, 40 + 4 * np.sqrt(m)), 1), 0),
        "top_word": top,
        "endings": per(ENDING[last], words.bounds) / n,
        "common": per(np.isin(h, COMMON_HASHES), content.bounds) / m,
        "long_words": per((words.ends - words.starts) > 14, words.bounds) / n,
        "insults": insults,
        "insult_share": insults / m,
        "insult_kinds": insult_kinds,
    }
    return out, words.counts, content


def votes(measured: dict[str, np.ndarray], n_words: np.ndarray) -> np.ndarray:
    """One column per labeller: 0 abstains, 1 for good, 2 for junk, 3 for toxic. Short texts get no votes on shares but the plainest."""
    out = np.zeros((len(n_words), LABELLERS), np.int8)
    long_enough = n_words >= 10
    for j, (name, junk, good) in enumerate(MEASURES):
        x = measured[name]
        out[(x >= junk[0]) & (x < junk[1]) & long_enough, j] = 2
        out[(x >= good[0]) & (x < good[1]) & long_enough, j] = 1
    for j, (name, least) in enumerate(zip(LEXICON, (1, 0.004, 2), strict=True), len(MEASURES)):
        out[measured[name] >= least, j] = 3
        out[measured[name] == 0, j] = 1
    return out


FAMILIES = (("upper", "signs", "sign_words", "endings", "common", "long_words"), ("repeats", "sameness", "top_word"), LEXICON)
"""Junk comes in two kinds that different labellers see, noise and repetition: the model keeps them apart, else one outvotes the other."""


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior (good, junk, toxic) of each vote pattern, by expectation-maximisation from the families that voted against the text.

    Each labeller has a table P(vote | class) over the votes it gives; abstaining says nothing. A prior of one in a hundred rows, in favour
    of a labeller's vote meaning its class, keeps the classes what they are called.
    """
    n, total = len(patterns), counts.sum()
    if not n:
        return np.zeros((0, 3))
    names = [m[0] for m in MEASURES] + list(LEXICON)
    of = np.array([next(k for k, family in enumerate(FAMILIES) if name in family) for name in names])
    against = np.stack([((patterns > 1) & (of == k)).sum(axis=1) for k in range(3)], axis=1).astype(float)
    start = np.concatenate([np.full((n, 1), 0.5), against], axis=1) + 0.02
    posterior = start / start.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        mass = posterior * counts[:, None]
        prior = mass.sum(axis=0) + 0.01 * total
        logs = np.log(prior / prior.sum())[None, :].repeat(n, axis=0)
        for j in range(LABELLERS):
            table = np.full((4, 2), 0.001 * total)  # votes for good, votes against
            table[:, 0] += 0.01 * total * (np.arange(4) != of[j] + 1)
            table[of[j] + 1, 1] += 0.01 * total
            table[:, 0] += mass[patterns[:, j] == 1].sum(axis=0)
            table[:, 1] += mass[patterns[:, j] > 1].sum(axis=0)
            table /= table.sum(axis=1, keepdims=True)
            voted = patterns[:, j] > 0
            logs[voted] += np.log(table[:, (patterns[voted, j] > 1).astype(int)]).T
        logs -= logs.max(axis=1, keepdims=True)
        posterior = np.exp(logs)
        posterior /= posterior.sum(axis=1, keepdims=True)
    return np.stack([posterior[:, 0], posterior[:, 1] + posterior[:, 2], posterior[:, 3]], axis=1)


def features(measured: dict[str, np.ndarray], content) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features as (bucket, weight) of all texts in a row, and n + 1 bounds: content words, weighing one together, and the bin of
    each measurement."""
    n = len(content.counts)
    names = [m[0] for m in MEASURES] + list(LEXICON)
    scale = {"insults": 0.34, "insult_share": 30.0, "insult_kinds": 0.34}
    binned = np.stack(
        [np.minimum(np.sqrt(np.minimum(measured[k] * scale.get(k, 1.0), 1.0)) * BINS, BINS - 1).astype(np.int64) for k in names], axis=1
    )
    dense = (np.arange(len(names)) * BINS + binned).reshape(n, -1)
    buckets = (content.hashes >> U(48)).astype(np.int64) + len(names) * BINS
    weight = np.repeat(1 / np.maximum(content.counts, 1), content.counts)
    sizes = content.counts + dense.shape[1]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.empty(bounds[-1], np.int64)
    w = np.empty(bounds[-1])
    is_dense = (np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)) < dense.shape[1]
    at[is_dense], at[~is_dense] = dense.reshape(-1), buckets
    w[is_dense], w[~is_dense] = 1.0, weight * 4
    return at, w, bounds


WIDTH = BUCKETS + LABELLERS * BINS


def train(at: np.ndarray, w: np.ndarray, bounds: np.ndarray, target: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Weights (WIDTH, 3) of a softmax regression on soft labels, by full-batch Adam with a small ridge."""
    weights = np.zeros((WIDTH, 3))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n = len(target)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    for step in range(1, rounds + 1):
        p = probabilities(weights, at, w, bounds)
        error = (p - target) / max(n, 1)
        slope = 1e-5 * weights
        for k in range(3):
            slope[:, k] += np.bincount(at, weights=w * error[owner, k], minlength=WIDTH)
        first += 0.1 * (slope - first)
        second += 0.01 * (slope**2 - second)
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


def probabilities(weights: np.ndarray, at: np.ndarray, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    raw = np.stack([segment_sum(weights[at, k] * w, bounds) for k in range(3)], axis=1)
    raw = np.exp(raw - raw.max(axis=1, keepdims=True)) if len(raw) else raw
    return raw / raw.sum(axis=1, keepdims=True) if len(raw) else raw


def _measured(batch: pa.RecordBatch, lexicon: np.ndarray = INSULT_HASHES):
    data, offsets = text_buffers(column(batch, "text"))
    for lo, hi in slices(offsets):
        yield lo, hi, *measure(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lexicon)


def _vote(lexicon: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, measured, n_words, _ in _measured(batch, lexicon):
                v = votes(measured, n_words)[n_words > 0]
                kinds, counts = np.unique(pack_votes(v), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(counts.astype(np.int64))], ["pattern", "n"])

    return run


def pack_votes(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 4 ** np.arange(LABELLERS)).sum(axis=1)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words and stems of each text, with its label."""
    for batch in batches:
        data, offsets = text_buffers(column(batch, "text"))
        toxic = column(batch, "toxic").to_pylist()
        for lo, hi in slices(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            content = words_of(part, at, lower=True, blank=SEPARATOR)
            both = stems(part, content)
            found = [
                np.unique(np.concatenate([content.hashes[x:y], both[x:y]]))
                for x, y in zip(content.bounds[:-1], content.bounds[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(found).view(np.int64)),
                    pa.array(np.repeat(np.array(toxic[lo:hi], np.int64), [len(f) for f in found])),
                ],
                ["word", "toxic"],
            )


def lexicon_of(docs: DataFrame, labels: DataFrame | None, label_rows: int = LABEL_ROWS) -> np.ndarray:
    """Hashes of insults: the built-in ones, and words and stems that hardly occur but in rows labelled toxic.

    Learned from the ``label_rows`` labelled documents with the smallest hashes of doc_id; at most ``LEXICON_SIZE`` of the commonest.
    """
    if labels is None:
        return INSULT_HASHES
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("toxic").cast("long")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # bounded by ``label_rows``
    words = rows.join(F.broadcast(known), "doc_id").select("text", "toxic").mapInArrow(_kinds, "word long, toxic long")
    counted = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).filter("toxic >= 5 AND toxic >= 0.95 * n")
    found = [r["word"] for r in counted.orderBy(F.desc("toxic"), "word").limit(LEXICON_SIZE).collect()]
    return np.unique(np.concatenate([INSULT_HASHES, np.array(found, np.int64).view(np.uint64)]))


def fit(docs: DataFrame, lexicon: np.ndarray, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The scorer's weights: the label model from the patterns of all rows, the scorer on ``train_rows`` of them in one task."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("text").mapInArrow(_vote(lexicon), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    packed = np.array(sorted(r["pattern"] for r in found), np.int64)
    counts = np.array([n for _, n in sorted((r["pattern"], r["n"]) for r in found)], float)
    patterns = packed[:, None] // 4 ** np.arange(LABELLERS) % 4
    posterior = label_model(patterns, counts)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, targets = [], []
        for frame in frames:
            batch = pa.RecordBatch.from_pandas(frame[["text"]].astype({"text": str}), schema=pa.schema([("text", pa.string())]))
            for _, _, measured, n_words, content in _measured(batch, lexicon):
                at = np.searchsorted(packed, pack_votes(votes(measured, n_words)))
                parts.append(features(measured, content))
                targets.append(posterior[np.minimum(at, len(posterior) - 1)])
        if not parts:
            return
        at, w = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
        parts.clear()  # held once more by ``at`` and ``w``
        weights = train(at, w, bounds, np.concatenate(targets)).astype(np.float32)
        yield pd.DataFrame({"weights": [weights.tobytes()]})

    # ids first: only they are sorted, and the texts of ``train_rows`` of them alone move
    ids = rows.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = rows.join(F.broadcast(ids), "doc_id").limit(train_rows)
    learned = scratch.write(sample.repartition(1).mapInPandas(learn, "weights binary"), "weights").collect()
    return np.frombuffer(learned[0]["weights"], np.float32).reshape(WIDTH, 3) if learned else np.zeros((WIDTH, 3), np.float32)


SCORES = "n_words long, good double, junk double, toxic double, kept boolean"


def classify(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The columns of ``docs`` and n_words, the scorer's probabilities good, junk and toxic, and kept (good is the likeliest).

    ``labels`` (doc_id, toxic), if given, only teaches the insult labellers further words; classes are learned without labels.
    A NULL text and one without words is junk with probability 1. Rows are taken as they are; equal texts have equal scores. Columns of
    ``docs`` named like the added ones are replaced. No rows give no rows. Fitting reads the table twice, classifying once more; the
    model is ``WIDTH`` x 3 numbers whatever the table's size.
    """
    spark = docs.sparkSession
    docs = cleared(docs, SCORES)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    lexicon = lexicon_of(docs, labels)
    shared = spark.sparkContext.broadcast(fit(docs, lexicon, train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.astype(np.float64)
        for batch in batches:
            sizes, scores = [np.zeros(0, np.int64)], [np.zeros((0, 3))]
            for _, _, measured, n_words, content in _measured(batch, lexicon):
                p = probabilities(model, *features(measured, content))
                p[n_words == 0] = (0, 1, 0)
                sizes.append(n_words)
                scores.append(p)
            p = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(np.concatenate(sizes).astype(np.int64)), *(pa.array(p[:, k]) for k in range(3)),
                    pa.array(p[:, 0] >= p[:, 1:].max(axis=1)) if len(p) else pa.array([], pa.bool_()),
                ],
                [*batch.schema.names, *(c.split()[0] for c in SCORES.split(", "))],
            )

    return docs.mapInArrow(run, widened(docs, SCORES))
