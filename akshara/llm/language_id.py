"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads chunks of a text's UTF-8 bytes in both directions, labels
every byte position, and pools the positions' log-probabilities over the whole
text (their mean is that of the outputs, so one product with the mean state
gives it). It is trained in numpy by backpropagation through time on chunks of
a bounded sample of labelled texts. Gates and candidates use x / (1 + |x|),
scaled to (0, 1) for gates: as smooth steps as the usual ones and a tenth of
their time.

A null text, or one without a letter, gets `und` and score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.llm._bytes import blocks, utf8
from akshara.llm._frames import field, rowed, unrowed

#: Labelled texts of the training sample, at most; those with the smallest hashes of their ids.
SAMPLE = 1500
HIDDEN, CHUNK, STEPS, BATCH, RATE = 8, 128, 300, 256, 0.02
#: Chunks that go through the network at a time.
WIDE = 4096
UNKNOWN = "und"


def step(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Two recurrent layers with update and reset gates, one for each direction, and a linear output over both."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden, k = labels, hidden, len(labels)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.w = {f"{name}{d}": draw(*shape) for d in "fb" for name, shape in (("E", (3 * hidden, 256)), ("U", (2 * hidden, hidden)), ("C", (hidden, hidden)))}
        self.w |= {"V": draw(k, 2 * hidden), "b": np.zeros(k, np.float32), "heat": np.ones(1, np.float32)}

    def run(self, x: np.ndarray, d: str, keep: list | None = None) -> Iterator[np.ndarray]:
        """States at each step over bytes x (steps, chunks); keep gets what backpropagation needs."""
        e, u, c, n = self.w[f"E{d}"], self.w[f"U{d}"], self.w[f"C{d}"], self.hidden
        h = np.zeros((n, x.shape[1]), np.float32)
        for row in x:
            a = np.take(e, row, axis=1)
            g = step(a[: 2 * n] + u @ h) * np.float32(0.5) + np.float32(0.5)
            z, r = g[:n], g[n:]
            new = step(a[2 * n :] + c @ (r * h))
            after = new + z * (h - new)
            if keep is not None:
                keep.append((row, h, g, new))
            h = after
            yield h

    def pooled(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Outputs summed over the positions of each chunk; x: bytes (steps, chunks), size: bytes in each chunk."""
        total = np.zeros((2 * self.hidden, x.shape[1]), np.float32)
        at = np.arange(x.shape[0])[:, None]
        back = np.take_along_axis(x, np.maximum(size - 1 - at, 0), axis=0)
        whole = bool((size == x.shape[0]).all())
        for i, (d, y) in enumerate((("f", x), ("b", back))):
            part = total[i * self.hidden : (i + 1) * self.hidden]
            for t, h in enumerate(self.run(y, d)):
                part += h if whole else h * (t < size)
        return self.w["V"] @ total + self.w["b"][:, None] * size

    def positions(self, text: bytes) -> np.ndarray:
        """The label number of every byte of a text."""
        out = []
        for i in range(0, len(text), CHUNK):
            x = np.frombuffer(text[i : i + CHUNK], np.uint8)[:, None]
            f, b = list(self.run(x, "f")), list(self.run(x[::-1], "b"))[::-1]
            out += [int(np.argmax(self.w["V"] @ np.concatenate([p, q])[:, 0] + self.w["b"])) for p, q in zip(f, b, strict=True)]
        return np.array(out, np.int64)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradients, by backpropagation through time."""
        steps, m, n = x.shape[0], x.shape[1], self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        states = {"f": np.array(list(self.run(x, "f", kept["f"]))), "b": np.array(list(self.run(x[::-1], "b", kept["b"])))[::-1]}
        h = np.concatenate([states["f"], states["b"]], axis=1)
        o = np.einsum("kn,tnm->tkm", self.w["V"], h) + self.w["b"][:, None]
        o -= o.max(axis=1, keepdims=True)
        p = np.exp(o)
        p /= p.sum(axis=1, keepdims=True)
        right = p[:, y, np.arange(m)]
        loss = float(-np.log(right + 1e-9).mean())
        p[:, y, np.arange(m)] -= 1
        p /= steps * m
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["V"], grad["b"] = np.einsum("tkm,tnm->kn", p, h), p.sum(axis=(0, 2))
        dh = np.einsum("kn,tkm->tnm", self.w["V"], p)
        for i, d in enumerate("fb"):
            own = dh[:, i * n : (i + 1) * n]
            own = own if d == "f" else own[::-1]
            u, c = self.w[f"U{d}"], self.w[f"C{d}"]
            flow = np.zeros((n, m), np.float32)
            da, rows = np.empty((steps, 3 * n, m), np.float32), np.empty((steps, m), np.int64)
            for t in range(steps - 1, -1, -1):
                row, h0, g, new = kept[d][t]
                z, r = g[:n], g[n:]
                flow = flow + own[t]
                dnew = flow * (1 - z) * (1 - np.abs(new)) ** 2
                dz = flow * (h0 - new)
                back = c.T @ dnew
                dg = np.concatenate([dz, back * h0]) * (0.5 * (1 - np.abs(2 * g - 1)) ** 2)
                grad[f"C{d}"] += dnew @ (r * h0).T
                grad[f"U{d}"] += dg @ h0.T
                da[t, : 2 * n], da[t, 2 * n :], rows[t] = dg, dnew, row
                flow = flow * z + back * r + u.T @ dg
            flat, r = da.transpose(1, 0, 2).reshape(3 * n, -1), rows.ravel()
            for j in range(3 * n):
                grad[f"E{d}"][j] = np.bincount(r, flat[j], 256)
        return loss, grad

    def train(self, texts: list[bytes], labels: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> None:
        """Adam over random chunks, as many of each label; then the heat that fits the pooled outputs of the texts best."""
        rng, number = np.random.default_rng(seed), {x: i for i, x in enumerate(self.labels)}
        groups = [[t for t, y in zip(texts, labels, strict=True) if number[y] == k and len(t)] for k in range(len(self.labels))]
        full = [k for k, g in enumerate(groups) if g]
        if not full:
            return
        long = CHUNK // 2
        mean, square = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for s in range(1, steps + 1):
            y = np.array(full)[rng.integers(len(full), size=batch)]
            x = np.full((long, batch), 32, np.uint8)
            for j, k in enumerate(y):
                t = groups[k][rng.integers(len(groups[k]))]
                at = rng.integers(max(1, len(t) - long + 1))
                piece = t[at : at + long]
                x[: len(piece), j] = np.frombuffer(piece, np.uint8)
            _, grad = self.gradients(x, y)
            lr = rate * min(1, 2 * (1 - s / (steps + 1)))
            for k, g in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - lr * (mean[k] / (1 - 0.9**s)) / (np.sqrt(square[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
        few = [(t, number[y]) for t, y in zip(texts, labels, strict=True) if len(t)][:200]
        out = mean_outputs(self, [t for t, _ in few])
        y = np.array([k for _, k in few])

        def loss(heat: float) -> float:
            o = out * heat
            o = o - o.max(axis=1, keepdims=True)
            return float((np.log(np.exp(o).sum(axis=1)) - o[np.arange(len(y)), y]).mean())

        self.w["heat"] = np.array([min((0.5, 1, 2, 4, 8), key=loss)], np.float32)


def mean_outputs(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean output over all positions of each text, a row each; zeros for an empty text."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return pooled_outputs(net, np.frombuffer(b"".join(texts), np.uint8), offsets)


def pooled_outputs(net: Network, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)
    count = -(-size // CHUNK)
    row = np.repeat(np.arange(len(size)), count)
    start = offsets[row] + CHUNK * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    n = np.minimum(CHUNK, offsets[row + 1] - start)
    order = np.argsort(-n, kind="stable")
    out = np.zeros((len(size), len(net.labels)))
    for i in range(0, len(order), WIDE):
        part = order[i : i + WIDE]
        at = start[part][None, :] + np.arange(int(n[part].max()))[:, None]
        x = buf[np.minimum(at, len(buf) - 1)]
        o = net.pooled(x, n[part])
        for k in range(len(net.labels)):
            out[:, k] += np.bincount(row[part], o[k], len(size))
    return out / np.maximum(size, 1)[:, None]


def _predict(net: Network, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            buf, offsets = utf8(pc.struct_field(row, text_col))
            out = [np.zeros((0, len(net.labels)))]
            for i, j in blocks(offsets, 2 << 20):
                out.append(pooled_outputs(net, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            o = np.concatenate(out) * float(net.w["heat"][0])
            p = np.exp(o - o.max(axis=1, keepdims=True)) if len(o) else o
            p = p / p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([row, batch.column("letters"), pa.array([net.labels[k] for k in best], pa.string()), pa.array(p[np.arange(len(p)), best])], ["row", "letters", "label", "p"])

    return run


def train_network(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, **options) -> Network:
    """A network trained on a bounded sample of the labelled rows (null labels and texts left out)."""
    rows = labelled.where(field(label_col).isNotNull() & field(text_col).isNotNull())
    rows = rows.select(field(text_col).alias("text"), field(label_col).alias("label"), F.xxhash64(field(id_col)).alias("h"))
    # choose by hashes, so that no task sends texts that are not taken
    rows = rows.withColumn("t", F.xxhash64("text", "label"))
    last = rows.select("h", "t").orderBy("h", "t").limit(sample).agg(F.max(F.struct("h", "t")).alias("m")).first().m
    if last is not None:
        rows = rows.where((F.col("h") < last.h) | (F.col("h") == last.h) & (F.col("t") <= last.t))
    rows = rows.orderBy("h", "t", "text").limit(sample).collect()
    net = Network(sorted({r.label for r in rows}) or [UNKNOWN])
    if rows:
        net.train([r.text.encode() for r in rows], [r.label for r in rows], **options)
    return net


def predict_language(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """All columns of docs and lang_pred and score, the probability of that language; new columns replace old ones of their names."""
    rows = rowed(docs, letters=F.coalesce(field(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([rows.schema["row"], rows.schema["letters"], T.StructField("label", T.StringType()), T.StructField("p", T.DoubleType())])
    out = rows.mapInArrow(_predict(net, text_col), schema)
    out = out.withColumn("lang_pred", F.when(F.col("letters"), F.col("label")).otherwise(F.lit(UNKNOWN))).withColumn("score", F.when(F.col("letters"), F.col("p")).otherwise(F.lit(0.0)))
    return unrowed(out, docs.columns, ["lang_pred", "score"])


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))
