"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly (operator 5).

A word is the mean of the vectors of its character n-grams (hashed into a fixed
number of rows), a passage of ``WINDOW`` words is the mean of its words, and a
softmax over two classes reads the passage. Both layers are trained together in
numpy. A misspelling never seen shares most n-grams, and so its vector, with the
word it stands for. Only documents carry labels, so training alternates: first
every passage has its document's label, then only the passages that score highest
(all toxic documents hold one, no clean document does). A document scores as its
highest passage and as all of its words (log of the mean of exponentials, which rises
with the share of toxic words) under the mean of several models; a curve that allows
for wrong labels puts both on the scale of the labels. The number of rounds and the curve come from
scores of documents by models that were not trained on them (parts of the learning
fold). Passages of toxic documents weigh by the ratio of the classes, and a small
table is read several times a round.

The fit uses at most ``TOXIC`` and ``CLEAN`` labelled documents (the first by a
hash of the id) of up to ``TEXT_BYTES``, so the driver holds under 150 MB of text;
every whole text is scored.

Cases: a null or empty text, or one without a word, scores as a document without
any evidence; rows with equal ids are scored one by one, and in the fit they count
once, with one text and as toxic if any of their labels is; without labels of both
kinds the score is the rate of toxic labels (0.5 without labels); other columns
are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_model import held_out
from .textbytes import LOWER, WHITE, slabs, sums, text_column

#: Labelled documents of the fit, and bytes of the longest one.
TOXIC, CLEAN, TEXT_BYTES = 1500, 3000, 1 << 15
ROWS, SIZE, WINDOW = 1 << 16, 12, 2
#: Scale of the values of a model: words far above the others decide the value of all words.
SPREAD = 3.0
LENGTHS = (3, 4, 5)
_GAP = WHITE.copy()
_GAP[[ord(c) for c in ".,;:!?\"()|[]{}<>/"]] = True
_CLEANED = LOWER.copy()
_CLEANED[_GAP] = 32


def fit_line(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes (none negative) and shift of a logistic fit of y (0 to 1) by the columns of f, softened towards the middle."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = y * (n1 + 1) / (n1 + 2) + (1 - y) / (n0 + 2)
    scale = f.std(0) + 1e-9
    n = f.shape[1]
    g, c, soft = np.column_stack([f / scale, np.ones(len(f))]), np.append(np.full(n, 1 / n), 0.0), np.append(np.full(n, 1e-2), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(g @ c, -30, 30)))
        w, before = p * (1 - p) + 1e-6, c
        step = np.linalg.solve((g * w[:, None]).T @ g + np.diag(soft), g.T @ (target - p) - soft * (c - np.append(np.full(n, 1 / n), 0.0)))
        c = c + np.clip(step, -2, 2)
        c[:n] = np.maximum(c[:n], 0)
        if np.abs(c - before).sum() < 1e-6:
            break
    return c[:n] / scale, c[n]


def curve(line, f: np.ndarray) -> np.ndarray:
    """Probability of label 1 at values f: slopes, shift, and the shares of label 1 far below and far above."""
    a, b, low, high = line
    return low + (high - low) / (1 + np.exp(-np.clip(f @ a + b, -30, 30)))


def fit_curve(f: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float, float, float]:
    """The curve of labels of which some are wrong, by expectation and maximisation of what a document truly is."""
    low, high = 0.02, 0.98
    a, b = fit_line(f, y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ a + b, -30, 30)))
        yes = p * np.where(y > 0, high, 1 - high)
        true = yes / (yes + (1 - p) * np.where(y > 0, low, 1 - low))
        high = (true @ y + 9) / (true.sum() + 10)
        low = ((1 - true) @ y + 1) / ((1 - true).sum() + 50)
        low = min(low, high / 2)
        a, b = fit_line(f, true)
    return a, b, low, high


def _spaced(data: np.ndarray, at: np.ndarray):
    """Lower-case bytes with a space before and after each text, and the offsets of the texts between them."""
    n = len(at) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    text = np.repeat(np.arange(n), np.diff(at))
    out[np.arange(len(data)) + 1 + text] = _CLEANED[data]
    return out, at + np.arange(n + 1) + 1


def grams(data: np.ndarray):
    """Words of spaced bytes: their starts, ends, and for each n-gram length the row of the gram at each byte and whether it lies in a word and its two edges."""
    solid = data != 32
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    ends = np.flatnonzero(~solid[1:] & solid[:-1]) + 1
    word = np.cumsum(np.concatenate([solid[1:] & ~solid[:-1], [False]])) - 1
    edge = np.concatenate([ends + 1, [0]])[word] - np.arange(len(data))
    h = data.astype(np.uint32)
    base, found = np.concatenate([h, np.zeros(max(LENGTHS), np.uint32)]), []
    n = len(data)
    h = np.zeros(n, np.uint32)
    for k in range(max(LENGTHS)):
        h = h * np.uint32(0x01000193) + base[k : k + n] + np.uint32(1)
        if k + 1 in LENGTHS:
            m = h ^ (h >> np.uint32(15))
            m = m * np.uint32(0x2C1B3C6D)
            found.append(((m >> np.uint32(16)).astype(np.int64), edge >= k + 1))
    return starts, ends, word, found


class Bag:
    """Documents as words, and words as rows of n-grams, for training."""

    def __init__(self, texts: list):
        lists = [bytes(_CLEANED[np.frombuffer((t or "").encode(), np.uint8)]).split() for t in texts]
        index: dict = {}
        self.docs = [np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int64, len(ws)) for ws in lists]
        data = np.frombuffer(b" " + b" ".join(index) + b" ", np.uint8)
        _, _, word, found = grams(data)
        rows = np.concatenate([r[ok] for r, ok in found])
        owner = np.concatenate([word[ok] for _, ok in found])
        order = np.argsort(owner, kind="stable")
        self.rows = rows[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=max(1, len(index))))])
        self.windows = [np.arange(max(1, len(d) - WINDOW + 1)) for d in self.docs]

    def values(self, scalar: np.ndarray) -> np.ndarray:
        """Mean over each word's n-grams of a number per row."""
        return sums(scalar[self.rows].astype(np.float64), self.at) / np.maximum(np.diff(self.at), 1)

    def highest(self, scalar: np.ndarray):
        """Of each document: the start of its highest window, and its values: those of this window and of all words (log of the mean of exponentials)."""
        z, out = self.values(scalar), []
        power = np.exp(np.minimum(z, 30))
        for d in self.docs:
            if not len(d):
                out.append((0, (0.0, 0.0)))
                continue
            total = np.concatenate([[0], np.cumsum(z[d])])
            size = min(WINDOW, len(d))
            value = (total[size:] - total[:-size]) / size
            k = int(value.argmax())
            out.append((k, (float(value[k]), float(np.log(power[d].mean())))))
        return out


class Model:
    def __init__(self, scalar: np.ndarray, line: tuple[np.ndarray, float, float, float]):
        #: The softmax's difference of the two classes for each row: embeddings and linear layer folded together.
        self.scalar, self.line = scalar.astype(np.float32), line

    def values(self, column) -> np.ndarray:
        """Of each text: the value of its highest window and that of all words."""
        column = text_column(column)
        out = np.zeros((len(column), 2))
        for i, j, data, at in slabs(column):
            spaced, where = _spaced(data, at)
            starts, ends, _, found = grams(spaced)
            total = np.zeros(len(spaced), np.float32)
            for rows, ok in found:
                total += np.where(ok, self.scalar[rows], 0)
            running = np.concatenate([[0], np.cumsum(total, dtype=np.float64)])
            size = ends - starts
            count = sum(np.maximum(0, size + 3 - n) for n in LENGTHS)
            each = (running[ends] - running[starts - 1]) / np.maximum(count, 1)
            z, power = np.concatenate([[0], np.cumsum(each)]), np.exp(np.minimum(each, 30))
            first = np.searchsorted(starts, where)
            for k in range(j - i):
                a, b = first[k], first[k + 1]
                if b > a:
                    w = min(WINDOW, b - a)
                    out[i + k] = (z[a + w : b + 1] - z[a : b + 1 - w]).max() / w, np.log(power[a:b].mean())
        return out

    def scores(self, column) -> np.ndarray:
        return curve(self.line, self.values(column))


def _rounds(bag: Bag, y: np.ndarray, learn: np.ndarray, seed: int, rounds: int, batch: int = 256):
    """Trains on the documents `learn` and yields, after each round, the softmax's difference of the two classes for each row."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (ROWS, SIZE)).astype(np.float32)
    u = rng.normal(0, 0.1, (SIZE, 2)).astype(np.float32)
    ge, gu = np.full(ROWS, 1e-3, np.float32), np.full((SIZE, 2), 1e-3, np.float32)
    full = learn[[len(bag.docs[i]) > 0 for i in learn]]
    toxic, clean = full[y[full] > 0], full[y[full] == 0]
    # passages of each toxic document, so that both classes weigh alike and a round has some batches
    more = max(1, -(-3 * batch // (len(toxic) + len(clean))))
    heavy = min(8, max(1, round(len(clean) / max(1, len(toxic)))))
    for r in range(rounds):
        top = bag.highest(e @ (u[:, 1] - u[:, 0])) if r else None
        doc, start, share = [], [], []
        for i in toxic:
            pick = rng.choice(bag.windows[i], 3 * more).tolist() if not r else [top[i][0]] * (3 * more)
            doc += [i] * len(pick)
            start += pick
            share += [heavy if r else 1.0] * len(pick)
        for i in clean:
            pick = rng.choice(bag.windows[i], 3 * more).tolist() + ([top[i][0]] * more if r else [])
            doc += [i] * len(pick)
            start += pick
            share += [1.0] * len(pick)
        doc, start, share = np.array(doc), np.array(start), np.array(share)
        order = rng.permutation(len(doc))
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            words = [bag.docs[d][s : s + WINDOW] for d, s in zip(doc[at], start[at])]
            w = np.concatenate(words)
            window = np.repeat(np.arange(len(words)), [len(x) for x in words])
            size = bag.at[w + 1] - bag.at[w]
            ends = np.cumsum(size)
            rows = bag.rows[np.arange(ends[-1]) + np.repeat(bag.at[w] - (ends - size), size)]
            weight = np.repeat(1 / np.maximum(size, 1), size) / np.repeat(np.bincount(window)[window], size)
            owner = np.repeat(window, size)
            mean = np.zeros((len(words), SIZE), np.float32)
            some, edges = np.unique(owner, return_index=True)
            mean[some] = np.add.reduceat(e[rows] * weight[:, None].astype(np.float32), edges)
            s = mean @ u
            p = 1 / (1 + np.exp(np.clip(s[:, 0] - s[:, 1], -30, 30)))
            d = np.stack([y[doc[at]] - p, p - y[doc[at]]], 1).astype(np.float32) * share[at][:, None].astype(np.float32)
            back = (d @ u.T)[owner] * weight[:, None].astype(np.float32)
            g = mean.T @ d / len(words)
            gu += g**2
            u -= 0.3 * g / np.sqrt(gu)
            uniq, inverse = np.unique(rows, return_inverse=True)
            by = np.argsort(inverse, kind="stable")
            ge_rows = np.add.reduceat(back[by], np.searchsorted(inverse[by], np.arange(len(uniq))))
            ge[uniq] += (ge_rows**2).mean(1)
            e[uniq] -= 0.3 * ge_rows / np.sqrt(ge[uniq])[:, None]
        yield e @ (u[:, 1] - u[:, 0])


def _loss(f: np.ndarray, y: np.ndarray) -> float:
    """Log loss of the labels under the curve that is fitted to these values."""
    p = np.clip(curve(fit_curve(f, y), f), 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(texts: list, y: np.ndarray, seed: int = 11, rounds: int = 6, parts: int = 3, splits: int = 3) -> Model:
    """The mean of some models of all texts. As many models that have not seen a text score it, for as many
    splits into parts; these scores choose the number of rounds and the curve.
    """
    y = y.astype(float)
    bag, rng = Bag(texts), np.random.default_rng(seed)
    unseen = np.zeros((rounds, len(y), 2))

    def scaled(scalar: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """The scalar at the scale that spreads the highest passages of what it learnt from by SPREAD."""
        top = np.array([t[1][0] for t in bag.highest(scalar)])
        return scalar * (SPREAD / (top[learn].std() + 1e-9))

    for split in range(splits):
        part = np.empty(len(y), np.int64)
        for c in (0.0, 1.0):
            at = rng.permutation(np.flatnonzero(y == c))
            part[at] = np.arange(len(at)) % parts
        for k in range(parts):
            learn = np.flatnonzero(part != k)
            if len(set(y[learn])) < 2:
                learn = np.arange(len(y))
            for r, scalar in enumerate(_rounds(bag, y, learn, seed + parts * split + k, rounds)):
                value = np.array([t[1] for t in bag.highest(scaled(scalar, learn))])
                unseen[r, part == k] += value[part == k] / splits
    best = int(np.argmin([_loss(f, y) for f in unseen]))
    every, total = np.arange(len(y)), np.zeros(ROWS)
    for split in range(splits):
        *_, scalar = _rounds(bag, y, every, seed - 1 - split, best + 1)
        total += scaled(scalar, every) / splits
    return Model(total, fit_curve(unseen[best], y))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model | float:
    """A model from the labels outside the held-out fold, or the rate of toxic labels where there is nothing to tell apart."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold)).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    rate = known.agg(F.avg("y")).first()[0]
    if rate is None or rate in (0.0, 1.0):
        return 0.5 if rate is None else rate
    take = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = take(1, TOXIC).unionByName(take(0, CLEAN))
    short = docs.where(F.octet_length(text_col) <= TEXT_BYTES).select(id_col, F.col(text_col).alias("t"))
    rows = short.join(F.broadcast(chosen), id_col).groupBy(id_col, "y").agg(F.min("t").alias("t")).toPandas().sort_values(id_col)
    y = rows["y"].to_numpy()
    return fit(rows["t"].tolist(), y) if len(set(y)) == 2 else rate


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of docs."""

    def run(batches):
        for b in batches:
            s = model.scores(b.column(1)) if isinstance(model, Model) else np.full(b.num_rows, float(model))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1, label_col: str = "toxic", cut: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of each row of docs."""
    scored = score(docs, train(docs, labels, folds, fold, label_col, id_col, text_col), id_col, text_col)
    return scored.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
