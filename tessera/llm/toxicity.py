"""Toxicity: a counterfactual-regularised classifier.

A logistic model over which words, and beginnings of words, a text holds. For each labelled text counterfactual
pairs are made: where it mentions an identity term, the text with the terms swapped for others of their group;
for every text, a neutral mention of one term put into it, against the same mention of another term, and
against none. The loss adds a penalty on the change of score within a pair, so that a neutral mention of a
group, or the beginning of a word that such a term shares with an insult, carries no weight of its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import batches, hash_sample, written

#: Groups of terms by language; a term is swapped for another of its group.
IDENTITY = {
    "en": (
        ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("muslims", "christians", "jews", "hindus", "atheists"),
        ("muslim", "christian", "jewish", "hindu", "atheist"), ("black", "white", "asian", "latino"), ("immigrants", "refugees", "natives"), ("disabled", "deaf", "blind", "autistic"), ("old", "young"),
    ),
    "fr": (("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("homosexuels", "hétérosexuels"), ("musulmans", "chrétiens", "juifs", "athées"), ("noirs", "blancs", "arabes", "asiatiques"), ("immigrés", "réfugiés"), ("handicapés", "sourds", "aveugles")),
    "de": (("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("schwule", "lesben", "heteros"), ("muslime", "christen", "juden", "atheisten"), ("schwarze", "weiße", "asiaten"), ("einwanderer", "flüchtlinge"), ("behinderte", "gehörlose", "blinde")),
    "es": (("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("gays", "lesbianas", "heterosexuales"), ("musulmanes", "cristianos", "judíos", "ateos"), ("negros", "blancos", "asiáticos"), ("inmigrantes", "refugiados"), ("discapacitados", "sordos", "ciegos")),
}
#: Neutral mentions of a term, by language.
MENTIONS = {
    "en": ("many {} live in this town", "the {} on our street", "a meeting for {} today"), "fr": ("beaucoup de {} vivent ici", "une réunion pour les {} aujourd'hui"),
    "de": ("viele {} leben in dieser stadt", "ein treffen für {} heute"), "es": ("muchos {} viven en esta ciudad", "una reunión para {} hoy"),
}
_SWAP = {t.encode(): g[(k + 1) % len(g)].encode() for groups in IDENTITY.values() for g in groups for k, t in enumerate(g)}
_ONLY_WORDS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_held(text: str | None) -> set[bytes]:
    """The distinct words of a text: runs of letters, A-Z lower-cased (other than ASCII: any character)."""
    return set(text.encode("utf-8", "surrogatepass").translate(_ONLY_WORDS).split()) if text else set()


#: Lengths in bytes of the beginnings of words that are features beside the words, against inflected forms.
BEGINNINGS = (4, 5, 6, 7)


def features_of(words: set[bytes]) -> set[bytes]:
    """Words, and beginnings of words marked by a star, or by two where several of the words have it."""
    out = set(words)
    for k in BEGINNINGS:
        seen = Counter(w[:k] for w in words if len(w) >= k)
        out.update(b + b"*" for b in seen)
        out.update(b + b"**" for b, n in seen.items() if n > 1)
    return out


@dataclass
class Index:
    """Some features by what they are, to find those that a text holds without making all of the text's."""

    words: dict[bytes, int]
    begun: dict[bytes, int]
    twice: dict[bytes, int]

    @staticmethod
    def of(features: list[bytes]) -> Index:
        at = dict(zip(features, range(len(features)), strict=True))
        return Index({w: k for w, k in at.items() if w[-1:] != b"*"}, {w[:-1]: k for w, k in at.items() if w[-1:] == b"*" and w[-2:] != b"**"}, {w[:-2]: k for w, k in at.items() if w[-2:] == b"**"})

    def held(self, words: set[bytes]) -> list[int]:
        """The places of the features of a text of these words."""
        out = [self.words[w] for w in words & self.words.keys()]
        seen: Counter[bytes] = Counter()
        known = self.begun.keys() | self.twice.keys()
        for k in BEGINNINGS:
            seen.update(b for b in (w[:k] for w in words if len(w) >= k) if b in known)
        out += [self.begun[b] for b in seen if b in self.begun]
        return out + [self.twice[b] for b, n in seen.items() if n > 1 and b in self.twice]


def swapped(words: set[bytes]) -> set[bytes]:
    return {_SWAP.get(w, w) for w in words}


def counterfactuals(text: str | None, turns: int = 2) -> list[tuple[set[bytes], set[bytes]]]:
    """Pairs of word sets that should score alike: the text and its swapped copy, if it mentions a term; and `turns` times
    the text with a neutral mention and with the same mention of another term, and without. Which mentions: by the text's
    hash, so that every language's terms meet texts of every language and label."""
    words, out = words_held(text), []
    if not words.isdisjoint(_SWAP):
        out.append((words, swapped(words)))
    h = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
    for turn in range(turns):
        r = zlib.crc32(f"{h} {turn}".encode())
        language = sorted(IDENTITY)[r % len(IDENTITY)]
        group, mention = IDENTITY[language][r // 7 % len(IDENTITY[language])], MENTIONS[language][r // 1009 % len(MENTIONS[language])]
        k = r // 100_003 % len(group)
        one, other = (words | words_held(mention.format(t)) for t in (group[k], group[(k + 1) % len(group)]))
        out += [(one, other), (one, words)]
    return out


@dataclass
class ToxicityModel:
    """pairs: how many counterfactual pairs the fit had, and how many of them change a feature; gap: their mean change of score (log odds)."""

    weights: dict[bytes, float]
    bias: float
    pairs: tuple[int, int] = (0, 0)
    gap: float = 0.0

    def __post_init__(self) -> None:
        self.index, self.values = Index.of(list(self.weights)), list(self.weights.values())

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.values[k] for k in sorted(self.index.held(words_held(text))))
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([c for r in rows for c in r], dtype=np.int64)


def fit_weights(
    rows: list[list[int]], pairs: list[tuple[list[int], list[int]]], y: np.ndarray, n: int, l2: float, penalty: float, steps: int = 400,
) -> tuple[np.ndarray, float]:
    """rows: the features that each text holds; pairs: the features of two texts that should score alike. The loss is the
    mean log loss, l2 / 2 times the squared weights, and penalty times the mean squared change of score in a pair."""
    (at, col), (lat, lcol), (rat, rcol) = _flat(rows), _flat([a for a, _ in pairs]), _flat([b for _, b in pairs])
    w, b, m = np.zeros(n), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), len(y)
    first, second, t = np.zeros(n + 1), np.zeros(n + 1), 0
    for t in range(1, steps + 1):
        z = b + np.bincount(at, w[col], m)
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / m
        grad = np.bincount(col, g[at], n) + l2 * w
        if pairs:
            d = (np.bincount(lat, w[lcol], len(pairs)) - np.bincount(rat, w[rcol], len(pairs))) * 2 * penalty / len(pairs)
            grad += np.bincount(lcol, d[lat], n) - np.bincount(rcol, d[rat], n)
        grad = np.append(grad, g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2), most_rows: int = 12_000, most_features: int = 1_000,
    l2: float = 1e-5, penalty: float = 1.0, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> ToxicityModel:
    """Fits on at most `most_rows` labelled rows (those of the smallest id hashes), leaving out the
    rows whose crc32(id as text) mod held_out[0] is held_out[1]. At most `most_features` words, those
    that tell the labels apart best, are features, and the identity terms. Rows of one id count as toxic if one of them is;
    null ids and null labels are no labels. Without labels of both kinds the score is constant: 0
    without toxic ones, 1 without others."""
    rows = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    if held_out:
        rows = rows.where(F.crc32(F.col("id").cast("string")) % held_out[0] != held_out[1])
    rows = hash_sample(rows, F.xxhash64("id"), most_rows)
    sample = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(rows), "id")  # at most most_rows rows

    def held(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features of each text, and whether it is toxic."""
        for b in batches(tables, 256 << 10):
            words, toxic = [], []
            for s, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = [w.decode("latin-1") for w in features_of(words_held(s))] + [""]
                for at in range(0, len(held), 1 << 16):
                    words += held[at : at + (1 << 16)]
                    toxic += [y] * len(held[at : at + (1 << 16)])
                    if len(words) >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "y"])
                        words, toxic = [], []
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "y"])

    sums = written(sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(held, "word string, y int").groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("t")), "words")
    whole = sums.where("word = ''").first()
    n, t = (whole["n"], whole["t"]) if whole else (0, 0)
    if not 0 < t < n:
        return ToxicityModel({}, 60.0 if t and t == n else -60.0)
    # The likelihood-ratio statistic of a word and the label, against what the best of so many words reaches by chance
    number = sums.count()
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    expected = F.col("n") * F.lit(t / n)
    gain = 2 * (part(F.col("t").cast("double"), expected) + part((F.col("n") - F.col("t")).cast("double"), F.col("n") - expected))
    top = sums.where("word != ''").select("word", gain.alias("gain")).where(F.col("gain") >= 2 * np.log(number)).orderBy(F.desc("gain"), "word").limit(most_features)
    chosen = [r[0].encode("latin-1") for r in top.select("word").collect()]  # at most most_features rows
    place = {w: k for k, w in enumerate(dict.fromkeys([*chosen, *sorted(_SWAP)]))}
    index, kind = Index.of(list(place)), pa.list_(pa.int32())

    def features(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lambda words: sorted(index.held(words))
        for b in batches(tables, 256 << 10):
            own, pairs = [], []
            for s in b.column(0).to_pylist():
                own.append(known(words_held(s)))
                pairs.append([side for one, other in counterfactuals(s) for side in (known(one), known(other))])
            yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array(pairs, pa.list_(kind)), b.column(1)], names=["own", "pairs", "y"])

    got = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(features, "own array<int>, pairs array<array<int>>, y int").collect()  # at most most_rows rows
    rows, sides = [list(r["own"]) for r in got], [r["pairs"] for r in got]
    pairs = [(list(a), list(b)) for p in sides for a, b in zip(p[::2], p[1::2], strict=True)]
    telling = [(sorted({*a} - {*b}), sorted({*b} - {*a})) for a, b in pairs if a != b]  # what both sides have cancels
    w, b = fit_weights(rows, telling, np.array([r["y"] for r in got], dtype=np.float64), len(place), l2, penalty)
    gap = float(np.mean([abs(w[x].sum() - w[z].sum()) for x, z in telling])) if telling else 0.0
    return ToxicityModel({word: float(w[k]) for word, k in place.items()}, b, (len(pairs), len(telling)), gap)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1, of the whole text; null and empty texts: that of no word) and predicted (1 from
    the threshold on) to the rows of docs; columns of those names are replaced. No rows: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features words and the terms
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted") and c != text])
    names = kept.columns
    at = names.index(text)

    def score(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches(tables, 2 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(x) for x in b.column(at).to_pylist()], pa.float64())], names=[*names, "score"])

    out = kept.mapInArrow(score, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
