"""Toxicity scores by weak supervision.

1. Voters. Each voter looks at one sign of a text and votes toxic, clean or
   abstains. Lexicon voters come from a small hand-written word list and from
   words and word beginnings that the labelled training rows show far more often
   in toxic texts; pattern voters look at shouting, exclamation runs and the
   absence of any lexicon hit; the annotators of the training labels are one
   more voter. Voters need not be right or independent.
2. Label model. A generative model with a hidden class explains the votes:
   expectation-maximisation estimates how often each voter votes what in each
   class, and the correlation of every pair of voters within the classes. A
   voter's evidence is divided by one plus its positive correlations, so ten
   voters that see the same word count about once.
3. Classifier. A logistic regression on the signs is trained on the label
   model's posterior probabilities and scores every document.

Learning uses a sample of at most ``per_class`` labelled training rows of each
class (a fixed order by id hash), weighted up to the class totals, which are
counted over all labelled training rows. Scoring reads every whole text.

Words are compared by 64-bit hashes of their lower-case bytes (A-Z and Latin-1
capitals are lowered), word beginnings by those of their first 4 to 7 bytes.

Defined results: null and empty texts have no signs and get the score of such
texts; a null ``doc_id`` is never held out and has no label; of several labels
of an id the highest counts; with no labelled training row the hand-written
voters alone are used; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

PREFIXES = (4, 5, 6, 7)
INSULTS = """idiot idiots moron morons stupid loser losers pathetic scum worthless trash clown disgusting dumb
fool filth filthy garbage vermin imbecile jerk creep freak coward liar retard bastard bitch asshole
pig ugly vile hateful despicable idiote connard salope ordure crétin idiotin arschloch dummkopf abschaum
versager idiota estúpido imbécil basura escoria""".split()


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """Lower-cases Latin-1 capitals in UTF-8 bytes (A-Z are lowered by the word table)."""
    out = buf.copy()
    if len(buf) > 1:
        second = buf[1:]
        at = np.flatnonzero((buf[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)) + 1
        out[at] += 0x20
    return out


def _signs(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the words and word beginnings of a batch, and the pattern
    measures of every row: share of capitals, share of exclamation marks."""
    raw, off = tk.text_buffer(part.column("text"))
    n = len(off) - 1
    h, rows, pre = tk.words_by_row(lower_latin(raw), off, tk.ALNUM, PREFIXES)
    row = np.repeat(np.arange(n), np.diff(rows))
    is_letter = ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))

    def count(mask):
        c = np.r_[0, np.cumsum(mask)]
        return c[off[1:]] - c[off[:-1]]

    caps = count((raw >= 65) & (raw <= 90)) / np.maximum(count(is_letter), 1)
    marks = count(raw == 33) / np.maximum(np.diff(rows), 1)
    return np.tile(row, 1 + len(PREFIXES)), np.concatenate([h, *pre]), np.stack([caps, marks], axis=1)


@dataclass
class Signs:
    """What the model looks at: lexicon hashes, of which the first ``hand`` are
    hand-written, then two patterns."""
    hashes: np.ndarray
    hand: int

    def matrix(self, part) -> np.ndarray:
        """Presence of every lexicon entry and pattern in the rows of a batch."""
        row, h, pattern = _signs(part)
        order = np.argsort(self.hashes)
        s = self.hashes[order]
        out = np.zeros((len(pattern), len(s) + 2), np.float32)
        if len(s) and len(h):
            at = np.searchsorted(s, h)
            at[at == len(s)] = 0
            hit = s[at] == h
            out[row[hit], order[at[hit]]] = 1
        out[:, -2] = pattern[:, 0] > 0.5
        out[:, -1] = pattern[:, 1] > 0.5
        return out

    def votes(self, x: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Votes (1 toxic, -1 clean, 0 abstains): one voter for each lexicon
        entry in ``best``, the hand-written list as a whole, the patterns, the
        mined list as a whole, and two that vote clean where nothing is found."""
        words = x[:, :-2]
        hand, mined = words[:, :self.hand].any(1), words[:, self.hand:].sum(1)
        return np.column_stack([words[:, best], hand, mined >= 1, mined >= 3, x[:, -2], x[:, -1],
                                -(mined == 0).astype(np.float32), -(~hand & (mined == 0)).astype(np.float32)]).astype(np.float64)


class LabelModel:
    """Hidden-class model of votes with class rates of every vote and pairwise
    correlations within the classes."""

    def __init__(self, prior: float, rounds: int = 40):
        self.prior, self.rounds = prior, rounds

    def fit(self, votes: np.ndarray, weight: np.ndarray, annotated: np.ndarray, trust: float = 0.95) -> np.ndarray:
        """Posterior probability of the toxic class for each row. ``annotated``:
        the annotators' votes (1, -1), taken to be right with probability
        ``trust`` beforehand and re-estimated with the others."""
        votes = np.column_stack([votes, annotated])
        one_hot = np.stack([votes == s for s in (-1, 0, 1)], axis=2).astype(np.float64)
        q = np.where(annotated > 0, trust, 1 - trust)
        for _ in range(self.rounds):
            rates, spread = [], np.zeros((votes.shape[1], votes.shape[1]))
            for r in (q, 1 - q):
                w = r * weight
                mass = max(w.sum(), 1e-9)
                rates.append((np.einsum("i,ijs->js", w, one_hot) + 0.1) / (mass + 0.3))
                centred = (votes - w @ votes / mass) * np.sqrt(w / mass)[:, None]
                cov = centred.T @ centred
                sd = np.sqrt(np.diag(cov))
                corr = cov / np.maximum(np.outer(sd, sd), 1e-9)
                corr[sd < 1e-6] = 0
                corr[:, sd < 1e-6] = 0
                spread += 0.5 * np.abs(corr)
            np.fill_diagonal(spread, 0)
            spread[spread < 0.1] = 0  # noise
            spread[-1, :] = spread[:, -1] = 0  # annotators read the text, not the voters
            self.correlations, self.rates = spread, rates
            self.discount = 1 / (1 + spread.sum(axis=1))
            evidence = np.einsum("ijs,js,j->i", one_hot, np.log(rates[0]) - np.log(rates[1]), self.discount)
            p = min(max(self.prior, 1e-4), 1 - 1e-4)
            new = 1 / (1 + np.exp(-np.clip(evidence + np.log(p / (1 - p)), -40, 40)))
            if np.abs(new - q).max() < 1e-6:
                return new
            q = new
        return q


def train_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps on soft labels."""
    a = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + penalty * w
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    signs: Signs
    weights: np.ndarray

    def score(self, part) -> np.ndarray:
        z = self.signs.matrix(part) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _labelled(docs: DataFrame, labels: DataFrame, train: Column, per_class: int):
    """(doc_id, text, toxic) of the sample, and the class totals."""
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where("doc_id is not null and toxic is not null").where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    own = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    own = tk.cut_lineage(own, "labels")
    totals = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for c in (0, 1):
        some = own.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    # At most 2 * per_class ids: a bounded broadcast.
    picked = tk.cut_lineage(picked, "picked")
    sample = docs.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    return tk.cut_lineage(sample.select("doc_id", "text", "toxic"), "toxic_sample"), totals


def _mine(sample: DataFrame, limit: int, least_share: float, least: int) -> np.ndarray:
    """Hashes of the words and word beginnings that mark the toxic class."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                row, h, _ = _signs(part)
                row, h = row[h != 0], h[h != 0]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.empty(0, bool)
                yield pa.RecordBatch.from_pydict({
                    "toxic": pa.array(np.asarray(part.column("toxic"))[row[new]], pa.int32()), "h": pa.array(tk.signed(h[new]))})

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos:
        return np.empty(0, np.uint64)
    seen = sample.select("text", "toxic").mapInArrow(run, "toxic int, h long").groupBy("h").agg(
        F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    lift = ((F.col("p") + 0.5) / (pos + 1)) / ((F.col("n") + 0.5) / (neg + 1))
    good = (seen.where(F.col("p") >= max(least, round(least_share * pos))).withColumn("lift", lift).where("lift >= 5")
            .withColumn("rank", F.col("p") * F.log("lift")).orderBy(F.desc("rank"), "h").limit(limit).collect())
    return np.array([r["h"] & (2**64 - 1) for r in good], np.uint64)


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 4_000, lexicon: int = 384, voters: int = 40
        ) -> ToxicityModel:
    """Learns from ``labels`` rows for which ``train`` (on doc_id) holds."""
    src = tk.documents(docs).where("doc_id is not null")
    sample, totals = _labelled(src, labels, train, per_class)
    hand = np.unique(np.array([tk.hash_word(w) for w in INSULTS], np.uint64))
    mined = _mine(sample, lexicon, 0.008, 4)
    mined = mined[~np.isin(mined, hand)]
    signs = Signs(np.r_[hand, mined], len(hand))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                x = signs.matrix(part)
                yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"),
                                                  "x": pa.array([np.packbits(r.astype(bool)).tobytes() for r in x], pa.binary())})

    got = sample.select("doc_id", "text", "toxic").orderBy("doc_id").mapInArrow(rows, "toxic int, x binary").collect()
    width = len(signs.hashes) + 2
    if not got:
        # Nothing to learn from: any hand-written word counts, patterns do not.
        return ToxicityModel(signs, np.r_[np.full(len(hand), 3.0), np.zeros(width - len(hand)), -2.0])
    x = np.stack([np.unpackbits(np.frombuffer(r["x"], np.uint8))[:width] for r in got]).astype(np.float32)
    y = np.array([r["toxic"] for r in got])
    weight = np.array([totals[c] / max((y == c).sum(), 1) for c in (0, 1)])[y]
    prior = totals.get(1, 0) / max(sum(totals.values()), 1)
    best = len(hand) + np.arange(min(voters, len(mined)))
    q = LabelModel(prior).fit(signs.votes(x, best), weight, np.where(y > 0, 1.0, -1.0))
    return ToxicityModel(signs, train_logistic(x, q, weight))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3,
                    per_class: int = 4_000) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``threshold``) of every
    document. ``held_out``: boolean Column on doc_id; those rows' labels are not read."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, ~held_out, per_class))
    src = tk.documents(docs).withColumn("held_out", held_out)
    return src.mapInArrow(_scorer(model, threshold, ["doc_id", "held_out"]),
                          "doc_id long, held_out boolean, score double, predicted int")


def _scorer(model, threshold: float, keep: list[str]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                s = model.value.score(part)
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {
                    "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, ~held_out))
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                yield part.filter(pa.array(model.value.score(part) < threshold))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, docs.schema)
