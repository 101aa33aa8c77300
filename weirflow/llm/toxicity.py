"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

The kernel of two words counts common subsequences of three characters (word ends
are characters too), each weighed DECAY to the power of its span, with spans up to
SPAN: an insult with gaps or inserted characters keeps most of its subsequences. A
sentence is a window of one to WIDTH consecutive words, and the kernel of two sentences
sums those of their pairs of words, over the roots of both numbers of words. The
subsequences are hashed, so the kernel is an inner product in a finite space, and a
machine over Nystroem features of LANDMARKS sentences folds into one weight for each
hashed subsequence: a sentence's margin is a running sum over its words.

A text's label says that some sentence of it is toxic, or that none is. So training is
multiple-instance learning: first each word's difference in share between toxic and
clean texts (in units of its sampling error) ranks sentences, later the machine's own
margin does. Each round adds to the toxic training sentences at most PICKS of each toxic
text, those that rank above the highest of nearly all clean texts (USUAL), as labels err
and not each sentence of a toxic text is toxic; and to the clean ones, beside one from
anywhere in each clean text, the highest of the HARD clean texts that rank highest. In
copies of training sentences of either label a word is disguised (gaps, an inserted,
doubled or replaced character). The score is Platt's logistic function of a text's
highest margins and of how many there are, fitted to the labels at their own rate.

The labelled sample is bounded: at most TOXIC and CLEAN labelled texts, those with the
smallest hash of their id, of at most LONGEST characters; near copies count once. Scoring
covers every sentence of every text; runs of single letters count as a word, too.
Texts that are null or have no word get the score of a text without any hint. Labels
other than 0 and 1 are left out, repeated ones count once (toxic, if any says so); without
labels of both kinds, every score is 0. Columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm import textkernel as tk
from weirflow.llm.language import fit_machine
from weirflow.llm.scratch import column, fresh
from weirflow.llm.shipping import send

#: Labelled texts of either kind that are learned from, and characters of one, at most.
TOXIC, CLEAN, LONGEST = 1500, 3000, 50_000
DECAY, SPAN, BITS = 0.7, 6, 15
#: Words of a sentence, at most.
WIDTH = 2
LANDMARKS, ROUNDS, STRENGTH = 512, 4, 1e-4
#: Sentences of a toxic text that are learned as toxic, at most.
PICKS = 5
#: The share of clean texts whose highest margin a sentence of a toxic text must exceed to be learned as toxic.
USUAL = 0.97
#: Clean texts whose highest sentence each round adds to the training, at most.
HARD = 1000
#: The margin of a text without words.
NO_SIGN = -1.5
EDGE = string.punctuation + "¡¿«»„“”‚‘’…–—"
_OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]


def _subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, word, weight) of the hashed subsequences of each word, by word; a word's weights have length 1."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(w) + 2 for w in words], np.int64)
    word, end = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size)
    flat = flat.astype(np.uint32) * np.uint32(0x85EBCA6B)
    place = np.arange(len(flat))
    keys = []
    for a, b in _OFFSETS:
        at = place[place + a + b < end]
        feature = flat[at] ^ (flat[at + a] << np.uint32(9) | flat[at + a] >> np.uint32(23)) ^ (flat[at + a + b] << np.uint32(18) | flat[at + a + b] >> np.uint32(14))
        feature = feature * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
        keys.append((word[at] << BITS | feature.astype(np.int64)) << 3 | a + b)
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    first = np.flatnonzero(np.append(True, key[1:] >> 3 != key[:-1] >> 3))
    weight = np.add.reduceat((DECAY ** (np.arange(8) + 1.0))[key & 7], first)
    key = key[first] >> 3
    word = key >> BITS
    square = np.bincount(word, weight * weight, minlength=len(words))
    return key & (1 << BITS) - 1, word, weight / np.sqrt(square)[word]


def _kernel_rows(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """The kernel of each word with each landmark (given as rows over the hashed features)."""
    by_feature = np.ascontiguousarray(landmarks.T)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for a in range(0, len(words), 100):
        feature, word, weight = _subsequences(words[a : a + 100])
        if len(word):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            out[a + word[starts]] = np.add.reduceat(by_feature[feature] * weight[:, None].astype(np.float32), starts, axis=0)
    return out


def _dense(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), 1 << BITS), np.float32)
    feature, word, weight = _subsequences(words)
    out[word, feature] = weight
    return out


def margins(words: list[str], weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words))
    for a in range(0, len(words), 2000):
        feature, word, weight = _subsequences(words[a : a + 2000])
        out[a : a + 2000] = np.bincount(word, weights[feature] * weight, minlength=len(words[a : a + 2000]))
    return out


class Words:
    """The distinct normal forms of a batch's words, and where they occur."""

    def __init__(self) -> None:
        self.hasher = tk.WordHasher()

    def bags(self, texts: pa.Array):
        """(first text, distinct words, index of each occurrence, how many occurrences precede each text)."""
        for base, data, offsets in self.hasher.chunks(texts):
            hashed, first, last, before = self.hasher.words(data, offsets)
            _, pick, index = np.unique(hashed, return_index=True, return_inverse=True)
            raw = data.tobytes()
            names = [raw[a:b].decode().lower().strip(EDGE) for a, b in zip(first[pick].tolist(), last[pick].tolist(), strict=True)]
            spelled = self._spelled(data, raw, first, last, before)
            if spelled:
                place, more = zip(*spelled, strict=True)
                index = np.insert(index, place, len(names) + np.arange(len(more)))
                names += more
                before = before + np.searchsorted(np.array(place), before, "left")
            yield base, names, index, before

    @staticmethod
    def _spelled(data: np.ndarray, raw: bytes, first: np.ndarray, last: np.ndarray, before: np.ndarray) -> list[tuple[int, str]]:
        """Runs of three or more words of one character each inside a text, as (first word, the characters)."""
        if not ((last - first) <= 4).any():
            return []
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        alone = leads[last] - leads[first] == 1
        if alone.sum() < 3:
            return []
        new = np.ones(len(alone) + 1, bool)
        new[1:-1] = alone[1:] != alone[:-1]
        new[before] = True
        at = np.flatnonzero(new)
        return [(int(a), b"".join(raw[first[i] : last[i]] for i in range(a, b)).decode().lower()) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > 2 and alone[a]]


def _distinct(texts: pa.Array) -> np.ndarray:
    """The first text of each group of likely near copies: those of which no minimum of sixteen over word triples was seen.

    Copies would pass off any rare word of theirs as a sign.
    """
    hasher, seen, keep, at = tk.WordHasher(), [set() for _ in range(16)], [], 0
    for found in tk.shingle_sets(hasher, texts, 3):
        minima = [int(tk.mix64(found ^ np.uint64(f)).min()) if len(found) else 0 for f in range(16)]
        if not any(m in s for m, s in zip(minima, seen, strict=True)):
            keep.append(at)
        for m, s in zip(minima, seen, strict=True):
            s.add(m)
        at += 1
    return np.array(keep, np.int64)


def _disguised(word: str, kind: int) -> str:
    """A word with gaps, or an inserted, doubled or replaced character."""
    k = len(word) // 2
    kinds = ("-".join(word), ".".join(word), f"{word[:k]}*{word[k:]}", f"{word[:k]}x{word[k:]}", word[:k] + word[max(0, k - 1) : k] + word[k:], f"{word[:k]}{word[k : k + 1]}_{word[k + 1 :]}")
    return kinds[kind % len(kinds)]


def _windows(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values' sums over each sentence divided by the root of its words, and how many sentences precede each text.

    A text's sentences are those of one word, then those of two, and so on up to WIDTH.
    """
    counts = np.diff(before)
    number = np.stack([np.maximum(counts - k, 0) for k in range(WIDTH)])
    ahead = np.concatenate([[0], np.cumsum(number.sum(0))])
    total = np.concatenate([[0.0], np.cumsum(values)])
    out = np.zeros(ahead[-1])
    for k in range(WIDTH):
        own = number[k]
        within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        start = np.repeat(before[:-1], own) + within
        out[np.repeat(ahead[:-1] + number[:k].sum(0), own) + within] = (total[start + k + 1] - total[start]) / np.sqrt(k + 1)
    return out, ahead


def _span(words: int, number: int) -> tuple[int, int]:
    """(first word, end) of a sentence of a text of so many words, by its number."""
    width = 1
    while number >= words - width + 1:
        number -= words - width + 1
        width += 1
    return number, number + width


def _pooled(margin: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """What Platt's function gets of each text: its three highest sentence margins, and the logarithms of how many are positive and of how many there are."""
    counts = np.diff(ahead)
    out = np.full((len(counts), 5), NO_SIGN)
    out[:, 4] = np.log1p(counts)
    out[:, 3] = np.log1p(np.diff(np.concatenate([[0], np.cumsum(margin > 0)])[ahead]))
    # Sorted within each text, the highest last.
    text = np.repeat(np.arange(len(counts)), counts)
    ranked = margin[np.lexsort((margin, text))]
    for k in range(3):
        full = np.flatnonzero(counts > k)
        out[full, k] = ranked[ahead[1:][full] - 1 - k]
    return out


def _tops(margin: np.ndarray, words: int, least: float) -> list[int]:
    """The likeliest sentences of a toxic text: at most PICKS of the highest above ``least`` that don't overlap."""
    picked: list[int] = []
    taken = np.zeros(words, bool)
    for k in np.argsort(-margin, kind="stable").tolist():
        if len(picked) == PICKS or margin[k] <= least:
            break
        a, b = _span(words, k)
        if not taken[a:b].any():
            taken[a:b] = True
            picked.append(k)
    return picked


class Sentences:
    """Sentences of a training sample as rows of word numbers."""

    def __init__(self, texts: pa.Array) -> None:
        number: dict[str, int] = {}
        places, counts = [], []
        for _, names, index, before in Words().bags(texts):
            own = np.array([number.setdefault(x, len(number)) for x in names] or [0], np.int64)
            places.append(own[index])
            counts.append(np.diff(before))
        self.number, self.words = number, list(number)
        self.place = np.concatenate(places or [np.zeros(0, np.int64)])
        self.before = np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))])

    def named(self, word: str) -> int:
        if word not in self.number:
            self.number[word] = len(self.words)
            self.words.append(word)
        return self.number[word]

    def sentence(self, text: int, number: int) -> list[int]:
        a, b = _span(int(self.before[text + 1] - self.before[text]), number)
        return self.place[self.before[text] + a : self.before[text] + b].tolist()

    def disguised(self, sentence: list[int], which: int, kind: int) -> list[int]:
        """A copy in which one word is disguised."""
        word = self.words[sentence[which]]
        return [*sentence[:which], self.named(_disguised(word, kind)), *sentence[which + 1 :]] if len(word) > 3 else sentence


def _tells(sample: Sentences, toxic: np.ndarray) -> np.ndarray:
    """How much more toxic than clean texts, by share, hold each word, in units of the difference's sampling error."""
    n = np.bincount(toxic, minlength=2)
    held = np.zeros((len(sample.words), 2))
    for t in range(len(toxic)):
        held[np.unique(sample.place[sample.before[t] : sample.before[t + 1]]), toxic[t]] += 1
    share = held.sum(1) / n.sum()
    return (held[:, 1] / n[1] - held[:, 0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n).sum())


class Model:
    def __init__(self, texts: pa.Array, toxic: np.ndarray, rate: float) -> None:
        self.weights, self.bias, self.logit = np.zeros(1 << BITS, np.float32), 0.0, None
        if not 0 < toxic.sum() < len(toxic):
            return
        # Of each label apart: a copy with another label tells most.
        kinds = [np.flatnonzero(toxic == k) for k in (0, 1)]
        keep = np.sort(np.concatenate([rows[_distinct(texts.take(pa.array(rows)))] for rows in kinds]))
        texts, toxic = texts.take(pa.array(keep)), toxic[keep]
        sample = Sentences(texts)
        counts = np.diff(sample.before)
        bad, good = (np.flatnonzero((toxic == k) & (counts > 0)) for k in (1, 0))
        if not len(bad) or not len(good):
            return
        tells = _tells(sample, toxic)
        own: dict[tuple, None] = {}
        against: dict[tuple, None] = {}
        for text in good.tolist():  # a sentence from anywhere in each clean text
            words = int(counts[text])
            against.setdefault(tuple(sample.sentence(text, text * 7919 % sum(max(words - k, 0) for k in range(WIDTH)))))
        for r in range(ROUNDS):
            value = self.words(sample.words) if r else tells
            margin, ahead = _windows(value[sample.place], sample.before)
            margin = margin + self.bias
            best = _pooled(margin, ahead)[:, 0]
            usual = float(np.quantile(best[good], USUAL))
            for t in bad.tolist():
                for k in _tops(margin[ahead[t] : ahead[t + 1]], int(counts[t]), usual):
                    own.setdefault(tuple(sample.sentence(t, k)))
            if not own:
                return
            for t in good[np.argsort(-best[good], kind="stable")][:HARD].tolist():
                against.setdefault(tuple(sample.sentence(t, int(np.argmax(margin[ahead[t] : ahead[t + 1]])))))
            self._fit(sample, [list(x) for x in own], [list(x) for x in against], value)
        margin, ahead = _windows(self.words(sample.words)[sample.place], sample.before)
        weight = np.where(toxic == 1, rate / max(1, (toxic == 1).sum()), (1 - rate) / max(1, (toxic == 0).sum())) * len(toxic)
        self._fit_logit(_pooled(margin + self.bias, ahead), toxic, weight)

    def _fit(self, sample: Sentences, own: list[list[int]], against: list[list[int]], tells: np.ndarray) -> None:
        """The machine of toxic sentences against others, over Nystroem features of sentences of both; ``tells`` has what each word says so far."""
        strongest = lambda s: int(np.argmax(tells[np.array(s)]))
        marks = [*self._various(own, strongest), *self._various(against, strongest)]
        own = own + [sample.disguised(s, strongest(s), i + k) for i, s in enumerate(own) for k in (range(6) if len(s) == 1 else (0, 3))]
        against = against + [sample.disguised(s, i % len(s), i) for i, s in enumerate(against) if i % 3 == 0]
        rows = np.zeros((len(marks), 1 << BITS), np.float32)
        for j, s in enumerate(marks):
            rows[j] = _dense([sample.words[i] for i in s]).sum(0) / np.sqrt(len(s))
        value, vector = np.linalg.eigh((rows @ rows.T).astype(float))
        good = value > 1e-6 * value[-1]
        root = vector[:, good] / np.sqrt(value[good])
        all_ = own + against
        used, place = np.unique(np.concatenate([np.array(s) for s in all_]), return_inverse=True)
        kernel = _kernel_rows([sample.words[i] for i in used.tolist()], rows)
        sizes = np.array([len(s) for s in all_])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = (np.add.reduceat(kernel[place], starts, axis=0) / np.sqrt(sizes, dtype=np.float32)[:, None]) @ root.astype(np.float32)
        y = np.where(np.arange(len(all_)) < len(own), 1.0, -1.0)
        w, self.bias = fit_machine([(slice(None), row) for row in x], x.shape[1], y, 30, STRENGTH)
        self.weights = ((root @ w) @ rows).astype(np.float32)

    @staticmethod
    def _various(sentences: list[list[int]], strongest: Callable[[list[int]], int]) -> list[list[int]]:
        """Half of the landmarks: sentences whose strongest word differs, as far as there are so many."""
        first: dict[int, list[int]] = {}
        for s in sentences:
            first.setdefault(s[strongest(s)], s)
        return list(first.values())[: LANDMARKS // 2]

    def _fit_logit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Newton steps of a ridge-regularised logistic regression."""
        self.mean, self.spread = x.mean(0), np.maximum(x.std(0), 0.5)
        z = np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))])
        self.logit = np.zeros(z.shape[1])
        ridge = np.append(np.full(x.shape[1], 1.0), 1e-6)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.logit, -30, 30)))
            curve = z.T @ (z * (weight * p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge)
            self.logit += np.linalg.solve(curve, z.T @ (weight * (y - p)) - ridge * self.logit)

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds to a sentence's margin; words of nothing but punctuation add nothing."""
        return np.where([bool(w) for w in words], margins(words, self.weights), 0.0)

    def scores(self, texts: pa.Array, words: Words) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.logit is None:
            return out
        for base, names, index, before in words.bags(texts):
            margin, ahead = _windows(self.words(names)[index], before)
            x = _pooled(margin + self.bias, ahead)
            z = np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))])
            out[base : base + len(x)] = 1 / (1 + np.exp(-np.clip(z @ self.logit, -30, 30)))
        return out


def learn(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic).

    At most ``toxic`` and ``clean`` texts reach the driver: of ids that docs repeats, the text that sorts first.
    """
    labels = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.withColumn("h", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 40)))
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [labels.filter(F.col("toxic") == k).orderBy("h", "doc_id").limit(most) for k, most in ((0, clean), (1, toxic))]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").filter(f"length(text) <= {LONGEST}").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    table = rows.orderBy("h", "doc_id").select("text", "toxic").toArrow().combine_chunks()
    if not table.num_rows:
        return Model(pa.array([], pa.string()), np.zeros(0, np.int64), 0.0)
    rate = counts.get(1, 0) / sum(counts.values())
    return Model(table.column("text").combine_chunks(), table.column("toxic").to_numpy().astype(np.int64), rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and the score of its column text (named by fresh(), if docs has a score)."""
    sent = send(docs.sparkSession, model)
    (name,) = fresh(docs.columns, "score")

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(text, Words()), pa.float64())

    return docs.select(*[column(c) for c in docs.columns], scored(F.col("text").cast("string")).alias(name))


def held_out(doc_id: str) -> Column:
    """Rows whose labels nothing is learned from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
