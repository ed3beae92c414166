"""Quality classifier by positive-unlabelled learning (operator 2).

Trusted positives and unlabelled web text are enough to train: the risk of the
negatives is what remains of the unlabelled risk after the positives' share, the
class prior, is taken off, and it is held at zero from below (the non-negative
unbiased risk). Labels of negatives are not used.

Unlabelled are all rows of the learning fold. Their means and deviations are sums
that Spark adds up. A round of the fit gives each partition the network of the round
before; it goes through all of its rows in small batches against the positives, and
the networks of all partitions are averaged by their rows. The positives, the only
labelled rows, are a documented sample of ``POSITIVES`` rows by a hash of their id.

The prior is estimated from positives and unlabelled rows: one half of the positives
is told apart from the unlabelled rows, and of the scores above any threshold the
least ratio of the share of unlabelled rows to the share of the other half of the
positives bounds the prior (the best bin). With the log loss a logit is that of a
probability; it is shifted until the mean over the unlabelled rows is the prior.

Cases: a null or empty text has zero features and still gets a score; rows with
equal ids are scored one by one, and a labelled id stands for one of its rows; without
positives, or without rows to tell them from, every score is 0.5; other columns are
not read.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .textbytes import slabs, sums, text_column

POSITIVES = 4000
HIDDEN, BATCH, RATE = 24, 256, 0.01
#: Rounds of the fit for the prior and of the one for the risk, and the least batches that a partition goes through in a round.
ROUNDS, STEPS = (4, 8), 60
#: Bins of scores for the prior, and the chance that its bound is wrong.
BINS, DOUBT = 200, 0.1
#: Byte classes: lower, upper, digit, space, newline, punctuation, other symbols, beyond ASCII.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 6
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
N_FEATURES = 8 + 64


def _of_words(text: bytes) -> tuple:
    w = text.split()
    n = len(w)
    if not n:
        return (0.0,) * 7
    lines = [x for x in text.split(b"\n") if x.strip()]
    two = len(set(zip(w, w[1:])))
    return (
        np.log1p(n),
        len(set(w)) / n,
        1 - two / max(1, n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines),
        sum(map(len, w)) / n / 10,
        n / len(lines) / 100,
        1 - len(set(zip(w, w[1:], w[2:]))) / (n - 2) if n > 2 else 0.0,
    )


def text_features(column) -> np.ndarray:
    """One row of N_FEATURES for each text."""
    column = text_column(column)
    out = np.zeros((len(column), N_FEATURES), np.float32)
    for i, j, data, at in slabs(column):
        kind = _CLASS[data]
        n = np.maximum(np.diff(at), 1)
        pair = kind[:-1].astype(np.int64) * 8 + kind[1:] if len(kind) > 1 else np.zeros(0, np.int64)
        text = np.repeat(np.arange(j - i), np.diff(at))
        inside = text[:-1] == text[1:] if len(text) > 1 else np.zeros(0, bool)
        grid = np.bincount(text[:-1][inside] * 64 + pair[inside], minlength=64 * (j - i)) if len(text) > 1 else np.zeros(64 * (j - i))
        out[i:j, 8:] = np.sqrt(grid.reshape(-1, 64) / n[:, None])
        out[i:j, 7] = sums(kind == 6, at) / n
        raw = data.tobytes()
        for k in range(j - i):
            out[i + k, :7] = _of_words(raw[at[k] : at[k + 1]])
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features array<float>) of each row of docs."""

    def run(batches):
        for b in batches:
            x = text_features(b.column(1))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=[id_col, "features"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, features array<float>")


def _loss(f: np.ndarray) -> np.ndarray:
    """Log loss of a positive; of a negative it is _loss(-f)."""
    return np.logaddexp(0.0, -f)


def _slope(f: np.ndarray) -> np.ndarray:
    return -1 / (1 + np.exp(np.clip(f, -500, 500)))


def risk(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * R+(positives), and R-(unlabelled) - prior * R-(positives), which the non-negative risk holds at 0 from below."""
    return prior * _loss(f_p).mean(), _loss(-f_u).mean() - prior * _loss(-f_p).mean()


class Model:
    """A network with one hidden layer on features of zero mean and deviation one."""

    def __init__(self, mean=0.0, scale=1.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.shift = mean, scale, 0.0
        self.w = [rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def _forward(self, x):
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        hidden = np.tanh(x @ self.w[0] + self.w[1])
        return x, hidden, hidden @ self.w[2] + self.w[3]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._forward(np.asarray(x, np.float64))[2] + self.shift

    def gradients(self, p: np.ndarray, u: np.ndarray, prior: float | None) -> list[np.ndarray]:
        """Of the non-negative risk of positives p and unlabelled rows u; prior None: of telling p from u, both weighing the same."""
        (x_p, h_p, f_p), (x_u, h_u, f_u) = self._forward(p), self._forward(u)
        n_p, n_u = len(p), len(u)
        if prior is None:
            d_p, d_u = 0.5 * _slope(f_p) / n_p, -0.5 * _slope(-f_u) / n_u
        else:
            # the derivative of a negative's loss by its logit is -slope(-f)
            d_u, d_p = -_slope(-f_u) / n_u, prior * _slope(-f_p) / n_p
            if risk(f_p, f_u, prior)[1] >= 0:
                d_p = d_p + prior * _slope(f_p) / n_p
            else:
                d_p, d_u = -d_p, -d_u
        out = [np.zeros_like(w) for w in self.w]
        for x, h, d in ((x_p, h_p, d_p), (x_u, h_u, d_u)):
            back = np.outer(d, self.w[2]) * (1 - h**2)
            for k, g in enumerate((x.T @ back, back.sum(0), h.T @ d, np.array([d.sum()]))):
                out[k] += g
        return out

    def learn(self, p: np.ndarray, u: np.ndarray, prior: float | None, rng, rate: float) -> None:
        """Goes through all rows of u in batches, again until there were STEPS of them."""
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        while step < STEPS:
            order = rng.permutation(len(u))
            for i in range(0, len(order), BATCH):
                g = self.gradients(p[rng.integers(0, len(p), min(BATCH, len(p)))], u[order[i : i + BATCH]], prior)
                step += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def _rows(batch) -> np.ndarray:
    """The features of a batch with the one column."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)


def _summed(feats: DataFrame, run) -> np.ndarray:
    """The sum over partitions of what run yields for their batches: one row for each place of the sums reaches the driver."""
    def each(batches):
        total = run(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    found = feats.select("features").mapInArrow(each, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    return np.array([r.v for r in found])


def _moments(feats: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and deviation of the features of all rows."""
    def run(batches):
        total = np.zeros(1 + 2 * N_FEATURES)
        for b in batches:
            x = _rows(b)
            total += np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])
        return total

    total = _summed(feats, run)
    n = max(total[0], 1.0)
    mean = total[1 : N_FEATURES + 1] / n
    return total[0], mean, np.sqrt(np.maximum(total[N_FEATURES + 1 :] / n - mean**2, 0)) + 1e-3


def _round(feats: DataFrame, model: Model, positive: np.ndarray, prior: float | None, number: int, rate: float) -> Model:
    """The networks that all partitions make of model, averaged by their rows."""
    def run(batches):
        # a partition of features is a small part of the texts it was made of
        parts = [x for x in map(_rows, batches) if len(x)]
        mine = Model(model.mean, model.scale)
        mine.w = model.w
        if not parts:
            return np.zeros(1 + sum(w.size for w in mine.w))
        u = np.concatenate(parts)
        mine.learn(positive, u, prior, np.random.default_rng((number, TaskContext.get().partitionId())), rate)
        return np.concatenate([[len(u)], *(len(u) * w.ravel() for w in mine.w)])

    total = _summed(feats, run)
    out, at = Model(model.mean, model.scale), 1
    for k, w in enumerate(model.w):
        out.w[k] = (total[at : at + w.size] / total[0]).reshape(w.shape)
        at += w.size
    return out


def _fitted(feats: DataFrame, positive: np.ndarray, prior: float | None, mean, scale, rounds: int) -> Model:
    model = Model(mean, scale)
    for k in range(rounds):
        model = _round(feats, model, positive, prior, k, RATE / (1 + k / 2))
    return model


def best_bin(of_positives: np.ndarray, of_unlabelled: np.ndarray) -> float:
    """The prior from counts of scores in rising bins: the least ratio of the unlabelled to the positive share above a threshold, bounds of both shares added where it is chosen."""
    n_p, n_u = of_positives.sum(), of_unlabelled.sum()
    above_p, above_u = (np.cumsum(c[::-1])[::-1] / c.sum() for c in (of_positives, of_unlabelled))
    doubt = np.sqrt(np.log(4 / DOUBT) / 2 / n_p) + np.sqrt(np.log(4 / DOUBT) / 2 / n_u)
    use = above_p > 0
    place = np.argmin((above_u[use] + doubt) / above_p[use])
    return float(np.clip(above_u[use][place] / above_p[use][place], 0.01, 0.99))


def _bins(f: np.ndarray) -> np.ndarray:
    """Counts of logits in BINS bins of equal width in probability."""
    return np.bincount(np.minimum((BINS / (1 + np.exp(-np.clip(f, -30, 30)))).astype(int), BINS - 1), minlength=BINS).astype(float)


def _scores(feats: DataFrame, model: Model, of) -> np.ndarray:
    """The sum over all rows of what `of` gives for the logits of a batch."""
    def run(batches):
        total = of(np.zeros(0))
        for b in batches:
            total = total + of(model.logit(_rows(b)))
        return total

    return _summed(feats, run)


def _shifted(feats: DataFrame, model: Model, prior: float) -> Model:
    """model with the shift at which its mean probability over all rows is the prior, by a histogram of logits."""
    edges = np.linspace(-40, 40, 4001)
    counts = _scores(feats, model, lambda f: np.histogram(np.clip(f, -39.99, 39.99), edges)[0].astype(float))
    middle, low, high = (edges[1:] + edges[:-1]) / 2, -60.0, 60.0
    for _ in range(60):
        at = (low + high) / 2
        low, high = (at, high) if (counts / (1 + np.exp(-(middle + at)))).sum() < prior * counts.sum() else (low, at)
    model.shift = (low + high) / 2
    return model


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def train(feats: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, label_col: str = "quality", id_col: str = "doc_id") -> tuple[Model, float] | None:
    """A model and the class prior from the positives outside the held-out fold and all rows outside it; None where there is nothing to learn from."""
    key = F.xxhash64(F.col(id_col))
    known = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold)).select(id_col).distinct()
    chosen = known.orderBy(key, id_col).limit(POSITIVES)
    # of rows that share an id one is taken, so that what reaches the driver is bounded too
    found = feats.join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min("features").alias("features")).orderBy(key, id_col).select("features").toArrow()
    free = feats.where(F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    n, mean, scale = _moments(free)
    if len(found) < 2 or n < 2:
        return None
    positive = np.concatenate([_rows(b) for b in found.to_batches() if b.num_rows])
    # the first half in the order of a hash shows what positives look like, the other half how many of the rows do
    half = len(positive) // 2
    teller = _fitted(free, positive[:half], None, mean, scale, ROUNDS[0])
    prior = best_bin(_bins(teller.logit(positive[half:])), _scores(free, teller, _bins))
    return _shifted(free, _fitted(free, positive, prior, mean, scale, ROUNDS[1]), prior), prior


def score(feats: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of each row of feats; without a model 0.5."""

    def run(batches):
        for b in batches:
            if model is None:
                s = np.full(b.num_rows, 0.5)
            else:
                s = 1 / (1 + np.exp(-np.clip(model.logit(_rows(b.select([1]))), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=[id_col, "score"])

    return feats.select(id_col, "features").mapInArrow(run, f"`{id_col}` {feats.schema[id_col].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 0, label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of each row of docs."""
    feats = written(features(docs, id_col, text_col))
    trained = train(feats, labels, folds, fold, label_col, id_col)
    scored = score(feats, trained and trained[0], id_col)
    return scored.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
