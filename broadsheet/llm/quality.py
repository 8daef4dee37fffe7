"""A quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated probabilities.

Tokens are runs of letters, digits or other signs, hashed into SLOTS. Every slot has a sparse random index vector; its
context vector sums the index vectors of its neighbours over all documents: whole numbers, so the sums of the tasks add up to
the same whatever their order. A document's features are the mean of its
tokens' vectors over its whole text, the shares of the three kinds of runs and of
immediate repeats, and the log of their number. A network of one hidden layer is fitted on
a bounded sample of labelled rows (at most SAMPLE_PER_CLASS of each label, by hash of the id; the only bound there is), and
a temperature is fitted on a fifth of it that the network has not seen. All documents are scored over their whole texts.
Only the table of context vectors (SLOTS x DIM numbers) and the sample's features reach the driver.

Defined results: null and empty texts have the features of no words and get the network's score for that; very long texts are
pooled whole, a stretch at a time; with labels of one class or none, every score is that class's share, or 0.5; labels that
disagree on an id count as their mean, halves up; rows are scored one by one, so repeated rows and null ids get scores too;
an empty table gives no rows; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, inside, lean, mix, spans, table

SLOTS, DIM, NONZERO, WINDOW = 1 << 15, 64, 6, 2
SAMPLE_PER_CLASS = 2000
EXTRA, PRIOR = 5, 4
#: Slots of a piece of the context table, and tasks whose pieces are added up in one step.
PIECE, TASKS = 1 << 10, 64
HIDDEN, EPOCHS, RATE = 24, 60, 0.01
_STEP = 1 << 20
_U = np.uint64
#: 0 white space, 1 letters (all bytes from 0x80), 2 digits, 3 other signs.
_KIND = np.full(256, 3, np.uint8)
_KIND[0:33] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the tokens of the rows in data, their kinds, and n+1 places."""
    kind = _KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[at[1:-1][at[1:-1] < len(data)]] = True
    first = np.flatnonzero(edge)
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    place = np.minimum(np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data)))), 63)
    value = mix(_FOLD[data].astype(_U) + _U(256) * place.astype(_U) + _U(1))
    hashes = mix(np.add.reduceat(value, first))
    kept = kind[first] > 0
    return (hashes[kept] % _U(SLOTS)).astype(np.int32), kind[first][kept], np.searchsorted(first[kept], at)


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each slot's NONZERO entries, the same in every process."""
    slot = np.arange(SLOTS, dtype=_U)[:, None] * _U(NONZERO) + np.arange(1, NONZERO + 1, dtype=_U)
    h = mix(slot)
    return (h % _U(DIM)).astype(np.int64), np.where(h >> _U(40) & _U(1), 1, -1).astype(np.int64)


def index_vectors() -> np.ndarray:
    """Sparse random vectors of +1 and -1."""
    place, sign = index_entries()
    out = np.zeros((SLOTS, DIM), np.float32)
    for j in range(NONZERO):
        out[np.arange(SLOTS), place[:, j]] += sign[:, j]
    return out


def _neighbours(slots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often slot a stands within WINDOW tokens of slot b in a row, as (a * SLOTS + b, counts)."""
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    both = []
    for s in range(1, WINDOW + 1):
        same = row[s:] == row[:-s]
        a, b = slots[:-s][same].astype(np.int64), slots[s:][same].astype(np.int64)
        both += [a * SLOTS + b, b * SLOTS + a]
    return np.unique(np.concatenate(both), return_counts=True)


def context_table(docs: DataFrame) -> np.ndarray:
    """Sums of the index vectors of all neighbours of each slot, over all rows of docs(text)."""

    def count(batches):
        from pyspark import TaskContext

        total, index = np.zeros((SLOTS, DIM), np.float64), index_vectors()
        for b in batches:
            data, at = flat(b.column("text"))
            for i, j in spans(at, _STEP):
                slots, _, places = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                if len(slots) > 1:
                    pair, n = _neighbours(slots, places)
                    a = pair // SLOTS
                    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                    for k in range(0, len(head), 256):  # a few slots at a time, so that the products stay small
                        lo, hi = head[k], head[k + 256] if k + 256 < len(head) else len(pair)
                        total[a[head[k : k + 256]]] += np.add.reduceat(index[pair[lo:hi] % SLOTS] * n[lo:hi, None], head[k : k + 256] - lo, axis=0)
        part = TaskContext.get().partitionId() // TASKS
        for p in range(0, SLOTS, PIECE):
            if total[p : p + PIECE].any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([p // PIECE], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([total[p : p + PIECE].astype(np.int32 if np.abs(total).max() < 1 << 31 else np.int64).tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(PIECE * DIM, np.int64)
        for x in t["sums"]:
            raw = x.as_buffer()
            total += np.frombuffer(raw, np.int32 if raw.size == 4 * PIECE * DIM else np.int64)
        return pa.table({"piece": t["piece"].slice(0, 1), "part": t["part"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    kinds = "piece int, part int, sums binary"
    parts = docs.select("text").mapInArrow(lean(count), kinds).groupBy("piece", "part").applyInArrow(add, kinds)
    out = np.zeros((SLOTS, DIM))
    for r in parts.groupBy("piece").applyInArrow(lambda t: add(t), kinds).toLocalIterator():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["sums"], np.int64).reshape(PIECE, DIM)
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Index vector plus unit context vector of each slot."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (index_vectors() / np.sqrt(NONZERO) + context / np.maximum(norm, 1e-9)).astype(np.float32)


def pool(slots: np.ndarray, kinds: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of each row: mean vector, shares of kinds and of tokens that repeat the one before, and size. PRIOR tokens of nothing steady the means of short rows."""
    n = np.diff(at)
    out = np.zeros((len(n), DIM + EXTRA), np.float64)
    full = np.flatnonzero(n)
    if len(full):
        heads = at[:-1][full]
        out[full, :DIM] = np.add.reduceat(vectors[slots], heads, axis=0)
        for k in (1, 2, 3):
            out[full, DIM + k - 1] = np.add.reduceat((kinds == k).astype(np.float64), heads)
        again = np.zeros(len(slots))
        again[1:] = slots[1:] == slots[:-1]
        again[heads] = 0
        out[full, DIM + 3] = np.add.reduceat(again, heads)
        out[full] /= n[full, None] + PRIOR
        out[full, DIM + 4] = np.log1p(n[full]) / 10
    return out


class Network:
    """One hidden layer of tanh units; probabilities at a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.constant = None if len(np.unique(y)) == 2 else float(y.mean()) if len(y) else 0.5
        if self.constant is not None:
            return
        held = np.arange(len(y)) % 5 == 4
        self.mean, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-3
        a, b = (x[~held] - self.mean) / self.scale, y[~held].astype(float)
        self.p = [rng.normal(0, a.shape[1] ** -0.5, (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        weight = np.where(b == 1, 0.5 / max(b.mean(), 1e-9), 0.5 / max(1 - b.mean(), 1e-9))
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(b)), max(1, len(b) // 64)):
                h = np.tanh(a[rows] @ self.p[0] + self.p[1])
                err = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - b[rows]) * weight[rows] / len(rows)
                back = np.outer(err, self.p[2]) * (1 - h * h)
                t += 1
                for i, g in enumerate([a[rows].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ err + 1e-4 * self.p[2], err.sum(keepdims=True)]):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        z, target = self.logit(x[held]), y[held].astype(float)
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, z / c) - target * z / c) for c in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors of all docs, and the network of the rows of labels(doc_id, quality) that are not held out."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.floor(F.avg("quality") + 0.5).cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    chosen = [rows.where(F.col("quality") == q).orderBy(order, "doc_id").limit(SAMPLE_PER_CLASS) for q in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * SAMPLE_PER_CLASS rows of two numbers
    vectors = word_vectors(context_table(docs))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches):
        for b in batches:
            out = [x.tobytes() for x in _pooled(b, shared.value)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(out, pa.binary())], ["doc_id", "quality", "x"])

    got = docs.select("doc_id", "text").join(sample, "doc_id").mapInArrow(lean(pooled), "doc_id long, quality int, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float64).reshape(got.num_rows, DIM + EXTRA)
    # rows in an order that has nothing to do with how they came
    order = np.lexsort([*x.T[:4], mix(got["doc_id"].to_numpy().astype(np.int64).view(_U))]) if got.num_rows else np.zeros(0, int)
    return vectors, Network(x[order], got["quality"].to_numpy()[order] if got.num_rows else np.zeros(0, int))


def _pooled(b: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """Features of a batch's rows."""
    data, at = flat(b.column("text"))
    out = np.zeros((b.num_rows, DIM + EXTRA))
    for i, j in spans(at, _STEP):
        out[i:j] = pool(*tokens(data[at[i] : at[j]], at[i : j + 1] - at[i]), vectors)
    return out


def score(docs: DataFrame, vectors: np.ndarray, network: Network, name: str = "score") -> DataFrame:
    """docs with a score under the name given. Vectors and network are of a fixed size and go to the executors as one broadcast variable."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def scores(batches):
        words, net = shared.value
        for b in batches:
            found = net.probability(_pooled(b.rename_columns(["text" if c == text else c for c in names]), words))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*names, "score"])

    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, docs.schema))
    return docs.toDF(*names).mapInArrow(lean(scores), f"{kinds}, score double").toDF(*docs.columns, name)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    own = inside(docs, "doc_id", "text")
    return score(own, *fit(own, labels)).where(F.col("score") >= least).drop("score").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, *fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
