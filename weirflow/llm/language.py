"""Language identification by hierarchical discrimination.

A linear support vector machine decides the language family first; within the
family, one-versus-one linear support vector machines separate the related
languages by vote. Features are shares of hashed byte trigrams and pairs and of words of
the whole text, so a machine's margin is a mean of weights over the text and no
histogram is built.

Training uses a bounded sample: at most SAMPLE labelled texts of each language,
those with the smallest hash of their id, and short pieces of each; texts of more than
LONGEST characters aren't learned from, nor languages beyond the MOST_LANGUAGES with
the most labels. Prediction covers every row and whole texts.

A text that is null or has no letter is ``und`` with score 0. Languages that the
table FAMILIES doesn't know are families of their own. Without any labelled text
everything is ``und``. Ids may repeat; rows are judged one by one. All columns pass
unchanged: if one has the name of a result, the result's name is that of fresh().

The score tells learned languages apart, and says nothing of text in none of them.
Fluency does: how far a text's mean log probability of trigrams, under the language
found, lies from that of labelled texts, in standard deviations for its length. Those
are measured across folds of the sample, each under tables of the other folds. A
language with fewer than FOLDS * 4 labelled texts has no measure; its fluency is 0.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm import textkernel as tk
from weirflow.llm.scratch import column, fresh
from weirflow.llm.shipping import send

#: Families of languages (ISO 639-1), fixed values.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "finnic": ["et", "fi"],
}
#: Labelled texts of a language that are learned from, at most.
SAMPLE = 400
#: Characters of a text that is learned from, and languages that are, at most.
LONGEST, MOST_LANGUAGES = 50_000, 64
#: Short pieces learned of each text, at most.
PIECES = 6
BITS, KINDS = 13, 3
UNKNOWN = "und"
#: Parts of the sample that fluency is measured across.
FOLDS = 5
#: The hashed trigram of blanks, which no fluency counts.
BLANK = (0x202020 * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS)


class Grams:
    """Hashed trigram and word features of Arrow texts in lower case; holds one worker's tables."""

    def __init__(self) -> None:
        self.hasher = tk.WordHasher()
        fold = np.arange(256)
        fold[65:91] += 32
        fold[:65] = fold[91:97] = fold[123:128] = 32  # ASCII that isn't a letter
        self.fold = fold.astype(np.uint32)

    def features(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """(first text, [(feature of each place, how many precede each text)] of trigrams, pairs and words)."""
        for base, data, offsets in self.hasher.chunks(pc.utf8_lower(texts.fill_null(""))):
            code = self.fold[data]
            starts = offsets[:-1][np.diff(offsets) > 0]
            before_it, before_that = np.empty_like(code), np.empty_like(code)
            before_it[1:] = code[:-1]
            before_it[starts] = 32  # what precedes a text is none of its own
            before_that[1:] = before_it[:-1]
            before_that[starts] = 32
            pair = code | before_it << 8
            gram = (pair | before_that << 16) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
            pair = pair * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
            hashed, _, _, before = self.hasher.words(data, offsets)
            yield base, [(gram, offsets), (pair, offsets), ((hashed >> np.uint64(64 - BITS)).astype(np.uint32), before)]


def _shares(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the features that it has and their shares of its trigrams, of its pairs, or of its words."""
    out = []
    for _, kinds in Grams().features(texts):
        for t in range(len(kinds[0][1]) - 1):
            index, share = [], []
            for k, (feature, ahead) in enumerate(kinds):
                found, count = np.unique(feature[ahead[t] : ahead[t + 1]], return_counts=True)
                index.append(found.astype(np.int64) + (k << BITS))
                share.append(count / max(1, count.sum()))
            out.append((np.concatenate(index), np.concatenate(share)))
    return out


def fit_machine(rows: list[tuple], size: int, y: np.ndarray, rounds: int = 40, strength: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge, dual coordinate steps); y is -1 or 1.

    A row is (where, values): the places of its values among ``size`` features, as
    indices or a slice. Both classes weigh the same in sum.
    """
    n = len(y)
    cost = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) / strength / n
    slack = 1 / (2 * cost)
    square = np.array([float(v @ v) for _, v in rows]) + 1.0 + slack
    alpha = np.zeros(n)
    weights, bias = np.zeros(size), 0.0
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(n):
            where, values = rows[i]
            gradient = y[i] * (float(weights[where] @ values) + bias) - 1 + alpha[i] * slack[i]
            step = max(-alpha[i], -gradient / square[i])
            if step:
                alpha[i] += step
                weights[where] += values * (step * y[i])
                bias += step * y[i]
    return weights, bias


def _piece(text: str, number: int) -> str:
    """A few words of a text, from a place that its length decides: short texts are learned beside whole ones."""
    words = text.split()
    n = 1 + (len(text) + 3 * number) % 8
    at = (len(text) * 31 + number * 7919) % max(1, len(words) - n + 1)
    return " ".join(words[at : at + n])


class Fluency:
    """How usual a text's trigrams are in each language, beside labelled texts of it."""

    def __init__(self, languages: list[str], texts: pa.Array, labels: list[str]) -> None:
        rows = []
        for _, kinds in Grams().features(texts):
            gram, ahead = kinds[0]
            for a, b in zip(ahead[:-1].tolist(), ahead[1:].tolist(), strict=True):
                rows.append(gram[a:b][gram[a:b] != BLANK])
        numbers = {x: [i for i, label in enumerate(labels) if label == x] for x in languages}
        counts = np.zeros((FOLDS, len(languages), 1 << BITS))
        for k, x in enumerate(languages):
            for j, i in enumerate(numbers[x]):
                counts[j % FOLDS, k] += np.bincount(rows[i], minlength=1 << BITS)
        total = counts.sum(axis=0)
        self.tables = self._logs(total).astype(np.float32)
        self.usual: list[tuple[float, float, float] | None] = [None] * len(languages)
        without = [self._logs(total - counts[f]) for f in range(FOLDS)]
        for k, x in enumerate(languages):
            if len(numbers[x]) < FOLDS * 4:
                continue
            held = [without[j % FOLDS][k][rows[i]] for j, i in enumerate(numbers[x]) if len(rows[i])]
            long = np.array([v.mean() for v in held if len(v) >= 100] or [v.mean() for v in held])
            every = np.concatenate(held)
            self.usual[k] = (float(long.mean()), float(long.var()), float(every.var()))

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        """Log probabilities; a part of each is of all languages, as texts quote others."""
        own = (counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True)
        return np.log(0.8 * own + 0.2 * own.mean(axis=0)) if len(own) else own

    def of(self, k: int, gram: np.ndarray) -> float:
        """Standard deviations of a text's trigrams from the mean of language number ``k``."""
        gram = gram[gram != BLANK]
        if self.usual[k] is None or not len(gram):
            return 0.0
        mean, between, within = self.usual[k]
        # Three trigrams share a byte, so that they vary together.
        return (float(self.tables[k][gram].mean(dtype=np.float64)) - mean) / float(np.sqrt(between + 3 * within / len(gram) + 1e-9))


class Model:
    """The machines: one for each two families, and for each two languages of a family."""

    def __init__(self, languages: list[str], texts: pa.Array, labels: list[str]) -> None:
        self.languages = languages
        self.fluency = Fluency(languages, texts, labels)
        of = {x: f for f, members in FAMILIES.items() for x in members}
        self.families: dict[str, list[str]] = {}
        for x in languages:
            self.families.setdefault(of.get(x, x), []).append(x)
        # The fewer texts a language has, the more pieces of each.
        rounds = {x: max(1, min(PIECES, SAMPLE // labels.count(x))) for x in languages}
        pieces = [(_piece(text, k), x) for text, x in zip(texts.to_pylist(), labels, strict=True) for k in range(rounds[x])]
        shares = _shares(texts) + _shares(pa.array([p for p, _ in pieces], pa.string()))
        labels = labels + [x for _, x in pieces]
        mean = np.zeros(KINDS << BITS)
        for where, values in shares:
            mean[where] += values / len(shares)
        scale = 1 / np.sqrt(mean + 1e-6)
        shares = [(where, values * scale[where]) for where, values in shares]
        shares = [(where, values / max(1e-9, float(np.sqrt(values @ values)))) for where, values in shares]
        label = np.array(labels)
        family = np.array([of.get(x, x) for x in labels])
        self.pairs: list[tuple[bool, str, str]] = [(True, a, b) for a, b in itertools.combinations(sorted(self.families), 2)]
        for members in self.families.values():
            self.pairs += [(False, a, b) for a, b in itertools.combinations(members, 2)]
        weights, biases = [], []
        for top, a, b in self.pairs:
            held = family if top else label
            rows = np.flatnonzero((held == a) | (held == b))
            w, bias = fit_machine([shares[i] for i in rows], KINDS << BITS, np.where(held[rows] == a, 1.0, -1.0))
            weights.append(w * scale)
            biases.append(bias)
        weights = np.array(weights or np.zeros((0, KINDS << BITS)))
        self.scale = scale.astype(np.float32)
        self.weights = np.ascontiguousarray(weights.T.reshape(KINDS, 1 << BITS, -1)).astype(np.float32)
        self.biases = np.array(biases)

    def predict(self, texts: pa.Array, grams: Grams, fluent: bool = False) -> tuple[list[str], list[float], list[float]]:
        """Names, scores and, if asked for, fluencies of texts."""
        names, scores, fluencies = [], [], []
        letters = self._letters(texts)
        for base, kinds in grams.features(texts):
            n = len(kinds[0][1]) - 1
            margins = np.zeros((n, len(self.pairs)))
            square = np.zeros(n)
            for k, (feature, ahead) in enumerate(kinds):
                full = np.flatnonzero(np.diff(ahead) > 0)
                if not len(full):
                    continue
                size = np.diff(ahead)[full].astype(np.float64)
                starts = ahead[:-1][full]
                for p in range(len(self.pairs)):
                    margins[full, p] += np.add.reduceat(self.weights[k, :, p][feature], starts, dtype=np.float64) / size
                for t, s, e in zip(full.tolist(), starts.tolist(), ahead[1:][full].tolist(), strict=True):
                    share = np.bincount(feature[s:e], minlength=1 << BITS) * self.scale[k << BITS : (k + 1) << BITS]
                    square[t] += float(share @ share) / (e - s) ** 2
            margins = margins / np.maximum(np.sqrt(square), 1e-9)[:, None] + self.biases
            for t in range(n):
                name, score = self._choose(margins[t]) if letters[base + t] and self.languages else (UNKNOWN, 0.0)
                names.append(name)
                scores.append(score)
                if fluent:
                    gram, ahead = kinds[0]
                    fluencies.append(self.fluency.of(self.languages.index(name), gram[ahead[t] : ahead[t + 1]]) if name in self.languages else 0.0)
        return names, scores, fluencies

    @staticmethod
    def _letters(texts: pa.Array) -> list[bool]:
        return pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_pylist()

    def _choose(self, margins: np.ndarray) -> tuple[str, float]:
        """The family with most won duels, then the language of it; the score is the product of the weakest wins."""
        family, sure = self._duel(True, sorted(self.families), margins)
        name, surer = self._duel(False, self.families[family], margins)
        return name, sure * surer

    def _duel(self, top: bool, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        won: dict[str, list[float]] = {x: [] for x in names}
        for (level, a, b), m in zip(self.pairs, margins.tolist(), strict=True):
            if level == top and a in won and b in won:
                won[a].append(m)
                won[b].append(-m)
        best = max(names, key=lambda x: (sum(m > 0 for m in won[x]), sum(won[x])))
        return best, 1 / (1 + float(np.exp(-3 * min(won[best]))))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of doc_id, text and lang; rows with null text or lang are left out.

    At most ``sample`` rows of a language reach the driver: those with the smallest
    hash of their id, found with a partial top-k of each hash bucket.
    """
    rows = labelled.filter(f"text is not null and lang is not null and length(text) <= {LONGEST}").select("lang", "text", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    rows = rows.filter(F.col("lang").isin(*counts))
    if counts:
        # About twice the sample by hash alone, before anything is sorted.
        wide = {x: min(1.0, 2 * sample / n + 20 / n) for x, n in counts.items()}
        limit = F.create_map(*itertools.chain.from_iterable((F.lit(x), F.lit(v)) for x, v in wide.items()))
        rows = rows.filter(F.pmod("h", F.lit(1 << 20)) <= limit[F.col("lang")] * (1 << 20))
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", "text")
    table = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample).select("lang", "text", "h").orderBy("lang", "h", "text").toArrow().combine_chunks()
    labels = table.column("lang").to_pylist()
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    return Model(sorted(set(labels)), texts, labels)


def identify(docs: DataFrame, model: Model, fluent: bool = False) -> DataFrame:
    """All columns of ``docs``, then lang_pred, score and, if asked for, fluency, from the column text alone."""
    sent = send(docs.sparkSession, model)
    kinds = {"lang_pred": "string", "score": "double"} | ({"fluency": "double"} if fluent else {})
    found, *new = fresh(docs.columns, "_found", *kinds)

    @F.arrow_udf(", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    def predict(text: pa.Array) -> pa.Array:
        names, *numbers = sent.value.predict(text, Grams(), fluent)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), *[pa.array(x, pa.float64()) for x in numbers[: len(kinds) - 1]]], list(kinds))

    own = [column(c) for c in docs.columns]
    return docs.select(*own, predict(F.col("text").cast("string")).alias(found)).select(*own, *[column(found)[c].alias(name) for c, name in zip(kinds, new, strict=True)])


def held_out(doc_id: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
