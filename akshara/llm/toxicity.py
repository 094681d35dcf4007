"""Toxicity by a string-kernel support vector machine with Nystrom landmarks.

The kernel compares stretches of text by their common subsequences of `LENGTH`
characters: gaps are allowed up to `REACH` characters in all and each skipped
character costs a factor, so an insult with inserted or missing characters still
shares most of its subsequences. Landmarks are stretches of labelled texts; the
Nystrom map sends a stretch to its kernel values with them, whitened, and a
linear machine with squared hinge loss separates the mapped stretches. A text is
as toxic as its most toxic stretch: training alternates between choosing that
stretch in each toxic text and fitting the machine against the worst stretches
of clean texts. As the kernel has finitely many features (hashed), landmarks,
whitening and machine fold into one table, and a whole text is scored by table
look-ups at every position. Toxic stretches are also learnt with a character put
in. Outputs are calibrated to a probability on the
training texts.

Letters A-Z are lower-cased. Null and empty texts have no stretch and get the
score of the least toxic training text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.llm._bytes import SPACE, blocks, released, utf8
from akshara.llm._frames import field, rowed, unrowed

LENGTH, REACH, DECAY, SLOTS = 4, 6, 0.6, 1 << 18
#: Positions of a stretch, and the landmarks.
STRETCH, LANDMARKS = 10, 96
#: Labelled texts of the training sample, at most, of either label; those with the smallest hashes of their ids.
SAMPLE = {1: 1500, 0: 3000}
ROUNDS = 3
SHAPES = [(0, *c) for c in combinations(range(1, REACH), LENGTH - 1)]
WEIGHTS = np.array([DECAY ** (s[-1] - LENGTH + 1) for s in SHAPES], np.float32)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[SPACE] = 32
PAD = STRETCH + REACH


def laid_out(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' folded bytes with spaces between rows, and where each row starts."""
    n = len(offsets) - 1
    start = offsets[:-1] + PAD * np.arange(1, n + 1)
    out = np.full(len(buf) + PAD * (n + 1), 32, np.uint8)
    at = np.arange(len(buf)) + np.repeat(PAD * np.arange(1, n + 1), np.diff(offsets))
    out[at] = FOLD[buf]
    return out, start


def slot_of(text: np.ndarray, shape: tuple[int, ...], n: int) -> np.ndarray:
    """The slots of one shape's subsequences that start at the first n positions."""
    x = text.astype(np.uint32)
    h = x[:n].copy()
    for k in shape[1:]:
        h *= np.uint32(0x01000193)
        h += x[k : k + n]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - SLOTS.bit_length() + 1)


def stretch_values(text: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each position: the machine's output for the stretch that starts there."""
    n = len(text) - REACH
    f = np.zeros(max(n, 0), np.float32)
    for shape, w in zip(SHAPES, WEIGHTS, strict=True):
        f += w * table[slot_of(text, shape, n)]
    total = np.concatenate([np.zeros(1), np.cumsum(f, dtype=np.float64)])
    return total[STRETCH:] - total[:-STRETCH]


def worst(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Largest output of each row, its position in the laid-out text, and that text; rows without text get minus infinity."""
    text, start = laid_out(buf, offsets)
    value = stretch_values(text, table)
    size = np.diff(offsets)
    best, at = np.full(len(size), -np.inf), np.zeros(len(size), np.int64)
    full = np.flatnonzero(size > 0)
    if len(full):
        lo = start[full] - 2
        hi = start[full] + size[full]
        cut = np.stack([lo, hi], 1).ravel()
        best[full] = np.maximum.reduceat(value, cut)[::2]
        for r, a, b in zip(full.tolist(), lo.tolist(), hi.tolist(), strict=True):
            at[r] = a + int(np.argmax(value[a:b]))
    return best, at, text, start


class Machine:
    def __init__(self, table: np.ndarray, slope: float, bias: float, floor: float):
        self.table, self.slope, self.bias, self.floor = table, slope, bias, floor

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for i, j in blocks(offsets, 1 << 20):
            part = offsets[i : j + 1] - offsets[i]
            text, start = laid_out(buf[offsets[i] : offsets[j]], part)
            value = stretch_values(text, self.table)
            size = np.diff(part)
            full = np.flatnonzero(size > 0)
            best = np.full(len(size), self.floor)
            if len(full):
                best[full] = np.maximum.reduceat(value, np.stack([start[full] - 2, start[full] + size[full]], 1).ravel())[::2]
            out[i:j] = best
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.bias, -30, 30)))


def mapped(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of the features of the stretches at the given positions, a row each."""
    slots, weights = [], []
    for shape, w in zip(SHAPES, WEIGHTS, strict=True):
        every = slot_of(text, shape, len(text) - REACH)
        slots.append(every[at[:, None] + np.arange(STRETCH)])
        weights.append(np.full((len(at), STRETCH), w, np.float32))
    return np.concatenate(slots, 1), np.concatenate(weights, 1)


def broken(text: np.ndarray, at: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """The stretches that start at the given positions, each with a hyphen put in, and where they start now."""
    long = STRETCH + 2 * REACH
    cut = text[np.minimum(at[:, None] + np.arange(long - 1), len(text) - 1)]
    place = rng.integers(3, STRETCH, len(at))[:, None]
    k = np.arange(long)
    out = np.take_along_axis(np.pad(cut, ((0, 0), (0, 1))), k - (k > place), axis=1)
    out[np.arange(len(at)), place[:, 0]] = 45
    return np.append(out.ravel(), np.full(PAD, 32, np.uint8)), np.arange(len(at)) * long


def kernel(slots: np.ndarray, weights: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of stretches with the landmarks (places of slots x landmarks)."""
    out = np.zeros((len(slots), landmarks.shape[1]), np.float32)
    for j in range(slots.shape[1]):
        out += landmarks[slots[:, j]] * weights[:, j : j + 1]
    return out


def fit_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2, rounds: int = 20) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton steps."""
    z = np.concatenate([z, np.ones((len(z), 1))], 1).astype(np.float64)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        on = y * (z @ w) < 1
        a = z[on] * cost[on, None]
        new = np.linalg.solve(a.T @ z[on] + ridge * len(z) * np.eye(z.shape[1]) * 1e-1, a.T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def train_machine(texts: list[bytes], toxic: np.ndarray, seed: int = 11) -> Machine:
    """A machine from labelled texts; without texts of both labels, one that calls nothing toxic."""
    if not (toxic == 1).any() or not (toxic == 0).any():
        return Machine(np.zeros(SLOTS, np.float32), 0.0, -5.0, 0.0)
    rng = np.random.default_rng(seed)
    # the first table: how much more often a feature is in toxic texts
    seen = np.zeros((2, SLOTS), np.int32)
    for t, y in zip(texts, toxic, strict=True):
        text, _ = laid_out(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        mark = np.zeros(SLOTS, bool)
        for shape in SHAPES[:4]:
            mark[slot_of(text, shape, len(text) - REACH)] = True
        seen[int(y)] += mark
    n = np.bincount(toxic.astype(int), minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    table = np.where(seen[1] >= max(3, 0.004 * n[1]), np.clip(odds, 0, 6), 0).astype(np.float32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    bank: list[tuple[np.ndarray, np.ndarray]] = []
    for turn in range(ROUNDS):
        pos, neg, odd = [], [], []
        for i, j in blocks(offsets, 1 << 20):
            part = offsets[i : j + 1] - offsets[i]
            _, at, text, start = worst(buf[offsets[i] : offsets[j]], part, table)
            full = np.diff(part) > 0
            for kind, out in ((1, pos), (0, neg)):
                rows = full & (toxic[i:j] == kind)
                out.append(mapped(text, at[rows]))
                if kind == 1 and rows.any():
                    odd.append(mapped(*broken(text, at[rows], rng)))
                if kind == 0 and turn == 0:
                    size = np.diff(part)[rows]
                    for _ in range(2):
                        out.append(mapped(text, start[rows] + (rng.random(len(size)) * size).astype(np.int64)))
        bank += neg
        if odd:
            pos += odd
        ps, pw = (np.concatenate([x[k] for x in pos]) for k in (0, 1))
        ns, nw = (np.concatenate([x[k] for x in bank]) for k in (0, 1))
        slots, weights = np.concatenate([ps, ns]), np.concatenate([pw, nw])
        y = np.concatenate([np.ones(len(ps)), -np.ones(len(ns))])
        # landmarks: stretches of toxic texts far from one another, and some clean ones
        chosen = [*spread(ps, pw, LANDMARKS * 3 // 4, rng), *(len(ps) + rng.choice(len(ns), min(len(ns), LANDMARKS // 4), replace=False))]
        # only slots that some landmark has are kept; all others share one row of zeros
        used = np.unique(slots[chosen])
        place = np.full(SLOTS, len(used), np.int32)
        place[used] = np.arange(len(used))
        landmarks = np.zeros((len(used) + 1, len(chosen)), np.float32)
        for k, c in enumerate(chosen):
            np.add.at(landmarks[:, k], place[slots[c]], weights[c])
        values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
        good = values > 1e-3 * values.max()
        white = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
        z = kernel(place[slots], weights, landmarks) @ white
        cost = np.where(y > 0, 1.0, max(1.0, len(ps)) / max(1, len(ns)) * 2)
        w = fit_svm(z, y, cost)
        table = np.zeros(SLOTS, np.float32)
        table[used] = (landmarks @ (white @ w[:-1].astype(np.float32)))[:-1]
    out = np.concatenate([worst(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)[0] for i, j in blocks(offsets, 1 << 20)])
    floor = float(out[np.isfinite(out)].min())
    slope, bias = calibrated(np.where(np.isfinite(out), out, floor), toxic)
    return Machine(table, slope, bias, floor)


def spread(slots: np.ndarray, weights: np.ndarray, n: int, rng) -> list[int]:
    """Farthest-first choice of n stretches by the kernel's distance."""
    of = rng.permutation(len(slots))[:1500]
    near = np.full(len(of), -np.inf)
    chosen: list[int] = []
    own = np.zeros(SLOTS, np.float32)
    k = int(of[0])
    for _ in range(min(n, len(of))):
        chosen.append(k)
        own[:] = 0
        np.add.at(own, slots[k], weights[k])
        near = np.maximum(near, (own[slots[of]] * weights[of]).sum(1))
        k = int(of[np.argmin(near)])
    return chosen


def calibrated(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias of a logistic fit, with targets that are not quite 0 and 1."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([x, np.ones(len(x))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2), a.T @ (target - p))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None) -> Machine:
    """A machine trained on a bounded sample of the labelled rows; labels has id_col and label_col, the largest label of an id counts, and of rows with one id the smallest text."""
    marks = labels.where(field(id_col).isNotNull() & field(label_col).isNotNull()).groupBy(field(id_col).alias("id")).agg(F.max(field(label_col).cast("int")).alias("label"))
    parts = [marks.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in (sample or SAMPLE).items()]
    few = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select(field(id_col).alias("__id"), field(text_col).alias("__text")).where("__text is not null").join(few, F.col("__id") == few["id"])
    rows = rows.groupBy("id", "label").agg(F.min("__text").alias("text"))
    # the bounded sample meets in one task; the driver gets the machine alone
    made = rows.repartition(1).sortWithinPartitions("id", "text").select("label", "text").mapInArrow(released(_train), "table binary, slope double, bias double, floor double").collect()
    if not made:
        return train_machine([], np.zeros(0, np.int64))
    return Machine(np.frombuffer(bytes(made[0].table), np.float32), made[0].slope, made[0].bias, made[0].floor)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("text").cast(pa.binary()).to_pylist()
        labels += batch.column("label").to_pylist()
    machine = train_machine(texts, np.array(labels, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([machine.table.tobytes()], pa.binary()), pa.array([machine.slope]), pa.array([machine.bias]), pa.array([machine.floor])], ["table", "slope", "bias", "floor"])


def _score(machine: Machine, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            buf, offsets = utf8(pc.struct_field(row, text_col))
            yield pa.RecordBatch.from_arrays([row, pa.array(machine.scores(buf, offsets))], ["row", "score"])

    return run


def score_toxicity(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """All columns of docs and score (0 to 1) and predicted (1 from a score of 0.5); new columns replace old ones of their names."""
    rows = rowed(docs)
    out = rows.mapInArrow(released(_score(machine, text_col)), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return unrowed(out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), docs.columns, ["score", "predicted"])


def nontoxic(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs whose score is below 0.5, with their columns as they were."""
    rows = rowed(docs)
    out = rows.mapInArrow(released(_score(machine, text_col)), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return unrowed(out.where("score < 0.5"), docs.columns, [])
