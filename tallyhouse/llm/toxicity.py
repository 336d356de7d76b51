"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Voters look at a text: fixed lexicons, lexicons mined from labelled training rows, and patterns. Each fires or not.
2. The label model has a class and, for each voter, how often it fires given the class (its accuracy in both classes).
   Expectation maximisation fits it to the counts of vote patterns, with the given labels of the training rows as one
   more, noisy voter. What pairs of voters have in common beyond the class (their correlation) lowers the weight of
   each, so that several forms of one observation do not count as several.
3. A logistic regression over word features and patterns is trained on the posterior labels.
4. Whole texts are scored in one pass; nothing is shuffled.

The models are fitted on at most ``TRAINING_ROWS`` labelled rows, drawn by a hash of the id; equal texts count once.
Rows whose id is held out are never among them. Ids, language and source are not looked at.

Defined cases: null and empty texts get the score of a text without any word; repeated rows get equal scores; null labels
are left out; a document with several labels has the larger one; without any labelled rows, or with one class only, the
fixed voters alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.shipping import ship
from tallyhouse.llm.words import alphanumeric_words, row_blocks, text_bytes
from tallyhouse.session import scratch_path

TRAINING_ROWS = 20_000
WORD_FEATURES = 512
MINED_WORDS, MINED_VOTERS = 48, 4
LEAST_SUPPORT = 8
REGULARISATION = 1e-6
THRESHOLD = 0.7

# Lexicons, a voter each.
LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons moronic imbecile stupid dumb dumbass fool retard idiota imbécile crétin dummkopf tonto estúpido",
    "worthlessness": "worthless loser losers pathetic useless failure nobody inútil wertlos versager fracasado minable",
    "filth": "trash garbage scum filth vermin filthy basura escoria abschaum müll ordure déchet",
    "disgust": "disgusting revolting gross vile repulsive sickening asqueroso widerlich dégoûtant ekelhaft",
    "ridicule": "clown clowns joke ridiculous payaso bouffon hampelmann laughable freak",
    "hostility": "hate kill die destroy shut odio hasse déteste muere stirb",
}

#: Patterns, as shares of a text's bytes or words: name -> threshold at which the voter fires.
PATTERNS = {"capitals": 0.3, "exclamation": 0.02, "repeats": 0.3}


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from: the CRC-32 of the id as text is 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return alphanumeric_words(data, np.array([0, len(data)])).hash


@dataclass
class Looked:
    """Per text of a block: patterns, and (text, place in ``wanted``, strength) of each wanted word that it holds."""

    patterns: np.ndarray
    row: np.ndarray
    place: np.ndarray
    strength: np.ndarray


def _look(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> Looked:
    """``wanted`` holds sorted word hashes."""
    n = len(offsets) - 1
    words = alphanumeric_words(data, offsets)
    rows = words.rows()
    if len(wanted):
        at = np.minimum(np.searchsorted(wanted, words.hash), len(wanted) - 1)
        hit = wanted[at] == words.hash
        pairs, times = np.unique(rows[hit] * len(wanted) + at[hit], return_counts=True)
    else:
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    size = np.maximum(np.diff(offsets), 1)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (rows[1:] == rows[:-1])
    repeats = np.bincount(rows[again], minlength=n) / np.maximum(np.diff(words.first), 1)
    capitals = sums((data >= 0x41) & (data <= 0x5A)) / size
    marks = sums(data == 0x21) / size
    patterns = np.stack([capitals, marks, repeats], axis=1)
    return Looked(patterns, pairs // max(len(wanted), 1), pairs % max(len(wanted), 1), np.minimum(1 + np.log(times), 3.0))


@dataclass
class Voters:
    """Word hashes in order, the voters that each fires, and the patterns' thresholds."""

    hashes: np.ndarray
    fires: np.ndarray
    names: list[str] = field(default_factory=list)

    @staticmethod
    def make(mined: list[int]) -> Voters:
        names, pairs = [], []
        for words in LEXICONS.values():
            pairs += [(int(h), len(names)) for h in _hash_words(words.split())]
            names.append("lexicon")
        for k in range(MINED_VOTERS):
            pairs += [(h, len(names)) for h in mined[k::MINED_VOTERS]]
            names.append("mined")
        hashes = np.unique(np.array([h for h, _ in pairs], np.uint64))
        fires = np.zeros((len(hashes), len(names)), bool)
        for h, voter in pairs:
            fires[np.searchsorted(hashes, np.uint64(h)), voter] = True
        return Voters(hashes, fires, [*names, *PATTERNS])

    def votes(self, looked: Looked) -> np.ndarray:
        n, n_words = len(looked.patterns), self.fires.shape[1]
        out = np.zeros((n, len(self.names)), bool)
        row, voter = np.nonzero(self.fires[looked.place]) if len(looked.place) else (np.zeros(0, int), np.zeros(0, int))
        out[looked.row[row], voter] = True
        out[:, n_words:] = looked.patterns > np.array(list(PATTERNS.values()))
        return out


class LabelModel:
    """Class-conditional firing rates of the voters and weights that allow for their correlations."""

    def __init__(self, votes: np.ndarray, given: np.ndarray, counts: np.ndarray, rounds: int = 50):
        """``votes``: patterns; ``given``: label 0, 1 or -1 of each pattern's rows; ``counts``: number of such rows."""
        self.prior, self.weights = 0.1, np.ones(votes.shape[1])
        words = votes[:, : -len(PATTERNS)]
        toxic = np.where(given >= 0, 0.1 + 0.8 * given, np.where(words.any(1), 0.8, 0.05))
        for _ in range(rounds):
            mass = np.stack([counts * (1 - toxic), counts * toxic])
            self.rates = (mass @ votes + np.array([[0.5], [0.5]])) / (mass.sum(1, keepdims=True) + 1)
            known = given >= 0
            right = (mass[1, known] @ given[known] + mass[0, known] @ (1 - given[known]) + 9) / (counts[known].sum() + 10)
            self.label_accuracy = float(np.clip(right, 0.6, 0.98))
            self.prior = float(np.clip(mass[1].sum() / max(counts.sum(), 1), 0.01, 0.5))
            toxic = self.posterior(votes, given)
        self.weights = self._weights(votes, counts, toxic)

    def _weights(self, votes: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """1 / (1 + correlations with the other voters within the classes)."""
        joint = np.zeros((votes.shape[1],) * 2)
        for mass in (counts * (1 - toxic), counts * toxic):
            total = max(mass.sum(), 1e-9)
            mean = mass @ votes / total
            centred = votes - mean
            cov = (centred * mass[:, None]).T @ centred / total
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            joint += np.abs(cov / np.outer(scale, scale)) * total / max(counts.sum(), 1)
        np.fill_diagonal(joint, 0)
        return 1 / (1 + np.where(joint > 0.05, joint, 0).sum(1))

    def posterior(self, votes: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        rates = np.clip(self.rates, 1e-4, 1 - 1e-4)
        fired, silent = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        odds = np.log(self.prior / (1 - self.prior)) + np.where(votes, fired, silent) @ self.weights
        if given is not None:
            step = np.log(self.label_accuracy / (1 - self.label_accuracy))
            odds = odds + np.where(given < 0, 0, np.where(given > 0, step, -step))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """text and label of at most about ``rows`` labelled rows that are not held out, equal texts once."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    each = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = each.count()
    drawn = each
    if n > rows:
        drawn = each.filter(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    return joined.groupBy(F.sha2("text", 256).alias("key")).agg(
        F.first("text").alias("text"), F.max("label").alias("label")
    )


def _word_counts(rows: DataFrame) -> DataFrame:
    """Of each distinct word hash: in how many texts of label 0 and 1 it stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            label = batch.column(1).to_numpy().astype(bool)
            for a, b in row_blocks(offsets):
                words = alphanumeric_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                by_row = np.lexsort((words.hash, words.rows()))
                h, r = words.hash[by_row], words.rows()[by_row]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                distinct, where = np.unique(h[new], return_inverse=True)
                toxic = np.bincount(where, weights=label[a:b][r[new]], minlength=len(distinct)).astype(np.int64)
                both = np.bincount(where, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct.view(np.int64)), pa.array(both - toxic), pa.array(toxic)], ["word", "n0", "n1"]
                )

    counted = rows.select("text", "label").mapInArrow(count, "word long, n0 long, n1 long")
    return counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


@dataclass
class Classifier:
    """Sorted word hashes with their weights, weights of the patterns, and a constant."""

    hashes: np.ndarray
    weights: np.ndarray
    patterns: np.ndarray
    constant: float

    def score(self, looked: Looked) -> np.ndarray:
        shape = (looked.patterns > np.array(list(PATTERNS.values()))) @ self.patterns
        each = self.weights[looked.place] * looked.strength if len(self.hashes) else np.zeros(0)
        words = np.bincount(looked.row, weights=each, minlength=len(shape))
        return 1 / (1 + np.exp(-np.clip(self.constant + shape + words, -30, 30)))


def _sparse(looked: Looked, n_words: int) -> pa.StructArray:
    """The logarithmic word counts and the patterns of each text, in the form that Spark stores sparse vectors in."""
    n = len(looked.patterns)
    row, pattern = np.nonzero(looked.patterns > np.array(list(PATTERNS.values())))
    rows, places = np.concatenate([looked.row, row]), np.concatenate([looked.place, n_words + pattern])
    order = np.lexsort((places, rows))
    values = np.concatenate([looked.strength, np.ones(len(row))])[order]
    offsets = pa.array(np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (places[order].astype(np.int32), values)]
    kind, size = np.zeros(n, np.int8), np.full(n, n_words + len(PATTERNS), np.int32)
    return pa.StructArray.from_arrays([pa.array(kind), pa.array(size), *lists], ["type", "size", "indices", "values"])


def _features(rows: DataFrame, voters: Voters, hashes: np.ndarray) -> DataFrame:
    """label, votes as a bit pattern, and features of each text.

    A text holds few of the words that are looked for; as arrays of all of them the rows filled the executors' heaps.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in row_blocks(offsets):
                part, where = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                votes = voters.votes(_look(part, where, voters.hashes))
                bits = votes @ (1 << np.arange(votes.shape[1]))
                features = _sparse(_look(part, where, hashes), len(hashes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a).cast(pa.int32()), pa.array(bits.astype(np.int64)), features],
                    ["label", "votes", "features"],
                )

    vector = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
    return rows.select("text", "label").mapInArrow(look, f"label int, votes long, features {vector}")


def _bits(patterns: np.ndarray, n: int) -> np.ndarray:
    return (patterns[:, None] >> np.arange(n)) & 1 > 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Classifier:
    """The classifier; only bounded tables come to the driver (word features, counts of vote patterns)."""
    # imported here, as workers import this module too and would hold pandas with it
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    spark = ship(docs.sparkSession)
    path = scratch_path(spark, "toxicity")
    training_rows(docs, labels, rows).select("text", "label").write.parquet(f"{path}/rows")
    training = spark.read.schema("text string, label int").parquet(f"{path}/rows")
    totals = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        hashes = np.unique(_hash_words([w for words in LEXICONS.values() for w in words.split()]))
        return Classifier(hashes, np.full(len(hashes), 4.0), np.zeros(len(PATTERNS)), -3.0)
    p0, p1 = F.col("n0") / n0, F.col("n1") / n1
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = (p1 - p0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    strong = (
        _word_counts(training)
        .filter(F.col("n0") + F.col("n1") >= LEAST_SUPPORT)
        .withColumn("z", z)
        .orderBy(F.desc("z"), "word")
        .limit(WORD_FEATURES)
        .collect()
    )
    strong = [r for r in strong if r["z"] > 3]
    as_hash = lambda w: int(np.int64(w).view(np.uint64))
    voters = Voters.make([as_hash(r["word"]) for r in strong[:MINED_WORDS]])
    hashes = np.unique(np.concatenate([np.array([as_hash(r["word"]) for r in strong], np.uint64), voters.hashes]))

    _features(training, voters, hashes).write.parquet(f"{path}/features")
    stored = T.StructType().add("label", T.IntegerType()).add("votes", T.LongType()).add("features", VectorUDT())
    table = spark.read.schema(stored).parquet(f"{path}/features")
    counted = table.groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([r["votes"] for r in counted], np.int64)
    given = np.array([r["label"] for r in counted], np.int64)
    votes = _bits(patterns, len(voters.names))
    model = LabelModel(votes, given, np.array([r["n"] for r in counted], float))
    posterior = {(int(v), int(g)): float(p) for v, g, p in zip(patterns, given, model.posterior(votes, given))}

    known = spark.createDataFrame([(v, g, p) for (v, g), p in posterior.items()], "votes long, label int, p double")
    joined = table.join(F.broadcast(known), ["votes", "label"])
    sides = [joined.select("features", F.lit(float(y)).alias("y"), w.alias("w")) for y, w in ((1, F.col("p")), (0, 1 - F.col("p")))]
    regression = LogisticRegression(
        featuresCol="features", labelCol="y", weightCol="w", regParam=REGULARISATION, maxIter=60, standardization=False
    )
    fitted = regression.fit(sides[0].unionAll(sides[1]))
    weights = fitted.coefficients.toArray()
    return Classifier(hashes, weights[: len(hashes)], weights[len(hashes) :], float(fitted.intercept))


def score(docs: DataFrame, classifier: Classifier, name: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 of the whole text as column ``name``, in place of one of that name."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != name]
    at = keep.index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            scores = [np.zeros(0)]
            for a, b in row_blocks(offsets):
                looked = _look(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], classifier.hashes)
                scores.append(classifier.score(looked))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, name]
            )

    kept = docs.select(*[f"`{c}`" for c in keep])
    out = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    return kept.mapInArrow(rate, out)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= threshold).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their columns as they are."""
    clean = score(docs, fit(docs, labels), "__toxicity").filter(F.col("__toxicity") < threshold)
    return clean.select(*[f"`{c}`" for c in docs.columns])
