"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Labelled rows give three things. Words and word stems that occur almost only in toxic texts extend a seed lexicon;
trees are fitted on feature vectors; the scores of held-out folds are calibrated by isotonic regression. The features
of a labelled text use a lexicon that was learned without its fold, so that the trees don't learn to trust words that
were picked because of that same text.

Cases. Null text is scored as empty text; empty text has all features at 0. A null ``doc_id`` is scored like any other
row and stays null. Labels that are null, contradict each other or match no document are ignored. With fewer than
``MIN_LABELS`` usable labels of either class the seed lexicon alone decides: the probability is the share of its words
over ``SEED_SHARE``, at most 1. Repeated rows are each scored and get equal
probabilities. An empty table gives an empty result. Other columns are not read; ``reject_toxic`` returns them untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.text import Tokens, slices
from corpusflow.llm.trees import BoostedTrees, Isotonic
from corpusflow.session import materialize

#: Labelled rows that training may use; the sample is the rows of least hash.
MAX_LABELS = 24_000
MIN_LABELS = 8
FOLDS = 5
THRESHOLD = 0.5
SEED_SHARE = 0.02
STEMS = (4, 5, 6)
NEAR = 6
LEAST_TOXIC = 3
TOXIC_SHARE = 0.85
#: Bytes of text handled at once, and entries that counts of terms may have before they are passed on.
SLICE = 1 << 20
TERMS = 200_000

#: English, German, French and Spanish. A word that is an ordinary one in another of these languages (``die``, ``rat``,
#: ``hell``, ``ass``, ``con``) is in no list: only the labels can tell what it means in a corpus.
SEED = {
    "insult": (
        "idiot idiots moron morons loser losers stupid dumb dumbass scum clowns pathetic worthless disgusting imbecile cretin jerk creep freak vermin parasite "
        "idioten dummkopf blödmann trottel versager vollidiot abschaum widerling missgeburt schwachkopf penner drecksack "
        "imbécile crétin abruti débile connard connasse minable ordure raclure salope enfoiré "
        "idiota idiotas imbécil estúpido estúpida tonto pendejo cabrón escoria gilipollas basura inútil asqueroso"
    ).split(),
    "hostile": "hate kill destroy choke strangle threaten hasse hassen umbringen verrecke verrecken töten vernichten tuer crève crever déteste odio matar muérete morirás".split(),
    "profane": "damn crap bastard bitch arse shit fuck fucking asshole scheiße scheiss verdammt arschloch fotze hure wichser merde putain bordel foutre mierda joder puta coño hijoputa".split(),
}
SECOND = set("you your yours yourself yourselves u ur tu toi vous votre vos te ti tus usted ustedes du dich dir dein deine ihr euch".split())
_leet = str.maketrans("013457@$!", "oieastasi")
_edge = re.compile(r"^\W+|\W+$")
_signs = re.compile(r"[^\w\s]")
_runs = re.compile(r"(.)\1{2,}")

NAMES = [*SEED, "word", "stem", "any", "hits", "near_second", "second", "capitals", "shout", "marks", "mark_runs", "obfuscated", "disguised", "stretched", "length"]


@dataclass
class Lexicon:
    words: set[str] = field(default_factory=set)
    stems: set[str] = field(default_factory=set)


class Words:
    """Values of words under one lexicon, kept from text to text, since most words of a text were met before.

    Values: seed groups, learned word, learned stem, second person, capitals, marks and the like.
    """

    MOST = 1 << 16
    WIDTH = 13

    def __init__(self, lexicon: Lexicon):
        self.stems = lexicon.stems
        self.every = set().union(*SEED.values()) | lexicon.words
        self.known: dict[str, list[int]] = {}
        for j, group in enumerate([*SEED.values(), lexicon.words, (), SECOND]):
            for word in group:
                self.known.setdefault(word, []).append(j)
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.WIDTH), dtype=np.float32)

    def values(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.MOST:
            self.at, new = {}, words
        while len(self.at) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for word in new:
            i = self.at[word] = len(self.at)
            self._fill(self.rows[i], word)
        return self.rows[np.fromiter((self.at[w] for w in words), dtype=np.int64, count=len(words))]

    def _fill(self, row: np.ndarray, raw: str) -> None:
        row[:] = 0
        plain = raw.isalpha()
        core = raw if plain else _edge.sub("", raw)
        low = core.lower()
        for j in self.known.get(low, ()):
            row[j] = 1
        for n in STEMS:
            if low[:n] in self.stems:
                row[4] = 1
        if len(core) > 1 and core.isupper():
            row[6] = 1
        if _runs.search(low) and (stretched := _runs.sub(r"\1", low)) in self.every and stretched != low:
            row[12] = 1
        if plain:
            return
        row[7] = "!" in raw
        marks = len(_signs.findall(raw))
        row[8] = marks / max(len(raw), 1)
        row[9] = marks > 2
        if not core.isalpha() and (_signs.search(core) or (any(map(str.isdigit, core)) and any(map(str.isalpha, core)))):
            row[10] = 1
            disguised = re.sub(r"\W", "", low.translate(_leet))
            row[11] = disguised != low and disguised in self.every


def features(texts: pa.Array, words: Words) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    tokens = Tokens(texts)
    n = len(tokens.ids)
    # one array for all per-token values: those of the words, then whether any is toxic and whether "you" is near
    values = np.zeros((n, Words.WIDTH + 2), dtype=np.float32)
    if n:
        distinct = words.values(tokens.words)
        toxic_word = distinct[:, [0, 1, 2, 3, 4, 11, 12]].max(axis=1)
        values[:, : Words.WIDTH] = distinct[tokens.ids]
        values[:, 13] = toxic_word[tokens.ids]
        hits, seconds = np.flatnonzero(values[:, 13]), np.flatnonzero(values[:, 5])
        if len(hits) and len(seconds):
            text_of = lambda at: np.searchsorted(tokens.offsets, at, side="right")
            after = np.searchsorted(seconds, hits)
            for side in (np.clip(after, 0, len(seconds) - 1), np.clip(after - 1, 0, len(seconds) - 1)):
                other = seconds[side]
                values[hits, 14] = np.maximum(values[hits, 14], (np.abs(other - hits) <= NEAR) & (text_of(other) == text_of(hits)))
    sums = tokens.sums(values)
    rates = sums / np.maximum(tokens.counts, 1)[:, None]
    return np.column_stack([
        rates[:, :5], rates[:, 13], np.log1p(sums[:, 13]), rates[:, 14], rates[:, 5], rates[:, 6], rates[:, 7],
        rates[:, 8], rates[:, 9], rates[:, 10], rates[:, 11], rates[:, 12], np.log1p(tokens.counts),
    ])


@dataclass
class Model:
    lexicon: Lexicon
    trees: BoostedTrees | None = None
    isotonic: Isotonic | None = None

    def probability(self, texts: pa.Array) -> np.ndarray:
        if not hasattr(self, "_words"):
            self._words = Words(self.lexicon)
        x = features(texts, self._words)
        if self.trees is None:
            return np.clip(x[:, NAMES.index("any")] / SEED_SHARE, 0, 1)
        return self.isotonic.probability(self.trees.score(x))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS, target: str = "toxic") -> DataFrame:
    """text, ``target``, fold: at most ``most`` documents labelled 0 or 1, each text once."""
    one = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("int").alias(target))
        .where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(target).alias(target), F.max(target).alias("_max"))
        .where(F.col(target) == F.col("_max"))
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # labels without a document must not use up the bound, so the numbers are joined before it
    one = one.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", target)
    # the sample is bounded by a parameter, so is what is broadcast
    return (
        texts.join(F.broadcast(one), "doc_id")
        .groupBy(F.xxhash64("text").alias("key"))
        .agg(F.first("text").alias("text"), F.min(target).alias(target), F.max(target).alias("_max"))
        .where(F.col(target) == F.col("_max"))
        .select("text", target, F.pmod("key", F.lit(FOLDS)).cast("int").alias("fold"))
    )


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of words and stems by fold and label, summed over the partition."""
    counts: dict[tuple[int, str], list[int]] = {}

    def passed_on() -> pa.RecordBatch:
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()),
            pa.array([counts[k][1] for k in keys], pa.int64()), pa.array([counts[k][0] for k in keys], pa.int64()),
        ], names=["fold", "term", "toxic", "clean"])
        counts.clear()
        return batch

    for batch in batches:
        for part in slices(batch, "text", SLICE):
            tokens = Tokens(part.column("text"))
            low = [_edge.sub("", w).lower() for w in tokens.words]
            for i, (toxic, fold) in enumerate(zip(part.column("toxic").to_pylist(), part.column("fold").to_pylist())):
                words = {low[j] for j in set(tokens.ids[tokens.offsets[i] : tokens.offsets[i + 1]].tolist())}
                terms = words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}
                for term in terms - {""}:
                    counts.setdefault((fold, term), [0, 0])[toxic] += 1
            if len(counts) > TERMS:
                yield passed_on()
    yield passed_on()


def _choose(rows: dict[str, tuple[int, int]]) -> Lexicon:
    """Terms seen in at least ``LEAST_TOXIC`` toxic texts (stems: one more) of which ``TOXIC_SHARE`` of their texts are."""
    lexicon = Lexicon()
    for term, (toxic, clean) in rows.items():
        stem = term.endswith("*")
        if toxic >= LEAST_TOXIC + stem and toxic / (toxic + clean + 0.5) > TOXIC_SHARE:
            (lexicon.stems if stem else lexicon.words).add(term.rstrip("*"))
    return lexicon


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> Model:
    sample = materialize(labelled(docs, labels, most), "toxic-sample")
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < MIN_LABELS:
        return Model(Lexicon())
    terms = (
        sample.mapInArrow(_terms, "fold int, term string, toxic bigint, clean bigint")
        .groupBy("term", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.collect_list(F.struct("fold", "toxic", "clean")).alias("by"))
        .where(f"t >= {LEAST_TOXIC} and t > 4 * c").collect()
    )
    everything = {r["term"]: (r["t"], r["c"]) for r in terms}
    without = [{r["term"]: (r["t"] - sum(b["toxic"] for b in r["by"] if b["fold"] == k), r["c"] - sum(b["clean"] for b in r["by"] if b["fold"] == k)) for r in terms} for k in range(FOLDS)]
    lexicons = [_choose(x) for x in without]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Words(x) for x in lexicons]
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                fold = part.column("fold").to_numpy()
                for k in np.unique(fold):
                    rows = part.filter(pa.array(fold == k))
                    x = features(rows.column("text"), known[k])
                    yield pa.RecordBatch.from_arrays([rows.column("fold"), rows.column("toxic"), pa.array([v.tobytes() for v in x], pa.binary())], names=["fold", "toxic", "x"])

    rows = sample.mapInArrow(vectors, "fold int, toxic int, x binary").collect()
    rows.sort(key=lambda r: (r["fold"], r["toxic"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"]) for r in rows])
    y, fold = np.array([r["toxic"] for r in rows], dtype=float), np.array([r["fold"] for r in rows])
    held = np.zeros(len(y))
    for k in np.unique(fold):
        out = fold == k
        held[out] = BoostedTrees().fit(x[~out], y[~out]).score(x[out]) if (~out).any() and 0 < y[~out].sum() < (~out).sum() else 0
    return Model(_choose(everything), BoostedTrees().fit(x, y), Isotonic().fit(held, y))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, toxicity (a calibrated probability), toxic (whether it reaches ``threshold``) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                p = model.probability(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "toxicity", "toxic"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, toxicity double, toxic boolean")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay below ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(pa.array(model.probability(part.column("text").cast(pa.string())) < threshold))

    return docs.mapInArrow(run, docs.schema)
