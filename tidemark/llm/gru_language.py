"""Language ID: a bidirectional gated recurrent network over bytes labels every position; a document pools its positions.

The network is trained here, in numpy, by backpropagation through time on a bounded sample of labelled windows.  A text is read
whole, in windows of ``WINDOW`` bytes that share one batch per step, so a long text costs no more per byte than a short one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.store import stage

#: Bytes that the network reads in one go; the last window of a text may be shorter.
WINDOW = 128
HIDDEN = 8
#: Bounds of the fit: documents per language, bytes of each.
FIT_DOCS = 500
FIT_BYTES = 512
STEPS = 350
BATCH = 96
RATE = 0.015
#: Windows read side by side; bounds a task's memory whatever the texts are.
SIDE = 2_048
PAD = 256
UNKNOWN = "und"


def held_out(doc_id) -> F.Column:
    """Rows that no fit sees: crc32 of doc_id as text divisible by 5; a null id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_sample(docs: DataFrame, most: int = FIT_DOCS, size: int = FIT_BYTES) -> DataFrame:
    """(lang, doc_id, piece): ``size`` bytes at a hashed place of at most ``most`` documents of each language, those of least hash.

    Held-out rows and rows with a null or empty text, lang or id are left out.  Only ids below a bound of their hash are ranked, several
    times as many as are wanted, so a language of a third of all rows is no hot task; an id that repeats gives one piece, its least.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out("doc_id"))
    rows = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    bound = F.create_map(*[F.lit(x) for k, n in rows.items() for x in (k, min(2**63 - 1, int(-2**63 + (4 * most + 100) / n * 2**64)))]) if rows else F.create_map()
    ids = usable.select("lang", "doc_id", F.xxhash64("doc_id", F.lit("language")).alias("draw"))
    low = ids.where(F.col("draw") <= F.coalesce(F.element_at(bound.cast("map<string,bigint>"), F.col("lang")), F.lit(0))).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    picked = low.select("lang", "doc_id", rank.alias("__rank")).where(F.col("__rank") <= most).select("lang", "doc_id")
    raw = F.encode(F.col("text"), "utf-8")
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length(raw) - size, F.lit(0)) + 1) + 1
    pieces = usable.select("lang", "doc_id", F.substring(raw, place.cast("int"), F.lit(size)).alias("piece"))
    return pieces.join(picked, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("piece").alias("piece"))


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the stretches [start, end) of ``data``: (stretch, first byte, length) of each, in order."""
    count = -(-(ends - starts) // WINDOW)
    owner = np.repeat(np.arange(len(starts)), count)
    first = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    return owner, first, np.minimum(WINDOW, ends[owner] - first)


def padded(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of the windows, one column each, filled up with PAD below."""
    place = np.arange(WINDOW)[:, None]
    return np.where(place < length, data[np.minimum(first + place, len(data) - 1)].astype(np.intp), PAD)


def starting_weights(classes: int, hidden: int = HIDDEN, seed: int = 13) -> dict[str, np.ndarray]:
    """x: input rows per direction and byte; u: recurrent weights; v, c: output.  Columns: update gate, reset gate, candidate."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (2, PAD + 1, 3 * hidden))
    # Padding never changes the state: its update gate is shut.
    x[:, PAD] = 0
    x[:, PAD, :hidden] = 30
    return {"x": x, "u": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)),
            "v": rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, classes)), "c": np.zeros(classes)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def loss_and_gradient(w: dict[str, np.ndarray], text: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all positions of the windows (text: WINDOW x B) and its gradient, back through time."""
    steps, b = text.shape
    hidden = w["u"].shape[1]
    both = np.stack([text, text[::-1]], 1)  # step, direction, window
    h = np.zeros((steps + 1, 2, b, hidden))
    z, r, n, g = (np.empty((steps, 2, b, hidden)) for _ in range(4))
    for t in range(steps):
        a = np.stack([w["x"][0][both[t, 0]], w["x"][1][both[t, 1]]])
        m = h[t] @ w["u"]
        gates = _sigmoid(a[..., :2 * hidden] + m[..., :2 * hidden])
        z[t], r[t], g[t] = gates[..., :hidden], gates[..., hidden:], m[..., 2 * hidden:]
        n[t] = np.tanh(a[..., 2 * hidden:] + r[t] * g[t])
        h[t + 1] = n[t] + z[t] * (h[t] - n[t])
    state = np.concatenate([h[1:, 0], h[1:, 1][::-1]], -1)
    logit = state @ w["v"] + w["c"]
    logit -= logit.max(-1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(-1, keepdims=True)
    real = text != PAD
    count = real.sum()
    at = np.take_along_axis(p, np.broadcast_to(truth, text.shape)[..., None], -1)[..., 0]
    loss = -np.log(np.maximum(at, 1e-30))[real].sum() / count
    d = p
    np.put_along_axis(d, np.broadcast_to(truth, text.shape)[..., None], at[..., None] - 1, -1)
    d *= real[..., None] / count
    grad = {"v": np.tensordot(state, d, ((0, 1), (0, 1))), "c": d.sum((0, 1))}
    back = d @ w["v"].T
    out = np.stack([back[..., :hidden], back[::-1, :, hidden:]], 1)
    da, dm = (np.empty((steps, 2, b, 3 * hidden)) for _ in range(2))
    dh = np.zeros((2, b, hidden))
    turned = w["u"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        dh = dh + out[t]
        dn = dh * (1 - z[t]) * (1 - n[t] ** 2)
        da[t, ..., :hidden] = dm[t, ..., :hidden] = dh * (h[t] - n[t]) * z[t] * (1 - z[t])
        da[t, ..., hidden:2 * hidden] = dm[t, ..., hidden:2 * hidden] = dn * g[t] * r[t] * (1 - r[t])
        da[t, ..., 2 * hidden:] = dn
        dm[t, ..., 2 * hidden:] = dn * r[t]
        dh = dh * z[t] + dm[t] @ turned
    grad["u"] = np.stack([np.tensordot(h[:-1, i], dm[:, i], ((0, 1), (0, 1))) for i in (0, 1)])
    grad["x"] = np.zeros_like(w["x"])
    for i in (0, 1):
        flat = both[:, i].ravel()
        order = np.argsort(flat, kind="stable")
        values, at = np.unique(flat[order], return_index=True)
        grad["x"][i, values] = np.add.reduceat(da[:, i].reshape(-1, 3 * hidden)[order], at)
    grad["x"][:, PAD] = 0
    return float(loss), grad


def train(pieces: list[bytes], truth: np.ndarray, classes: int, steps: int = STEPS, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Adam with a falling rate over shuffled windows of the pieces; the same pieces give the same weights."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    owner, first, length = cut(data, ends - [len(p) for p in pieces], ends)
    rng = np.random.default_rng(7)
    w = starting_weights(classes, hidden)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order = np.empty(0, int)
    for step in range(1, steps + 1):
        while len(order) < min(BATCH, len(owner)):
            order = np.append(order, rng.permutation(len(owner)))
        now, order = order[:BATCH], order[BATCH:]
        _, grad = loss_and_gradient(w, padded(data, first[now], length[now]), truth[owner[now]])
        rate = RATE * (1 - (step - 1) / steps)
        for k, g in grad.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            w[k] -= rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
    return w


def reader(w: dict[str, np.ndarray]):
    """A function (WINDOW x B bytes) -> (sums of position probabilities, numbers of positions by label), each classes x B."""
    hidden, classes = w["u"].shape[1], len(w["c"])
    # Gates are sigmoids: half of the tanh of half their argument.
    half = np.r_[np.full(2 * hidden, 0.5), np.ones(hidden)]
    x = [np.ascontiguousarray((w["x"][i] * half).T, np.float32) for i in (0, 1)]
    u = [np.ascontiguousarray((w["u"][i] * half).T, np.float32) for i in (0, 1)]
    v = [np.ascontiguousarray(w["v"][i * hidden:(i + 1) * hidden].T, np.float32) for i in (0, 1)]
    c = w["c"].astype(np.float32)[:, None]

    def read(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps, b = text.shape
        a, m = (np.empty((3 * hidden, b), np.float32) for _ in range(2))
        kept = np.empty((steps, hidden, b), np.float32)

        def step(way: int, t: int, h: np.ndarray, new: np.ndarray) -> None:
            np.take(x[way], text[t], axis=1, out=a, mode="clip")
            np.matmul(u[way], h, out=m)
            gates = a[:2 * hidden]
            gates += m[:2 * hidden]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            n = m[2 * hidden:]
            n *= gates[hidden:]
            n += a[2 * hidden:]
            np.tanh(n, out=n)
            np.subtract(h, n, out=new)
            new *= gates[:hidden]
            new += n

        h = np.zeros((hidden, b), np.float32)
        for t in range(steps):
            step(0, t, h, kept[t])
            h = kept[t]
        total, labelled = np.zeros((classes, b)), np.zeros((classes, b), np.int64)
        h, new = np.zeros((hidden, b), np.float32), np.empty((hidden, b), np.float32)
        for t in range(steps - 1, -1, -1):
            step(1, t, h, new)
            h, new = new, h
            p = v[0] @ kept[t]
            p += v[1] @ h
            p += c
            top = p.max(0)
            real = text[t] != PAD
            labelled += (p == top) & real
            p -= top
            np.exp(p, out=p)
            p *= real / p.sum(0)
            total += p
        return total, labelled

    return read


def label_texts(w: dict[str, np.ndarray], columns: int):
    """(..., text bytes last) -> the columns before the text, mean probabilities and numbers of positions by label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, classes = reader(w), len(w["c"])
        for batch in batches:
            texts = batch.column(columns).cast(pa.large_binary())
            texts = pa.array(texts.to_pylist(), pa.large_binary()) if texts.offset else texts
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[:len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.empty(0, np.uint8)
            owner, first, length = cut(data, bounds[:-1], bounds[1:])
            total, labelled = np.zeros((len(texts), classes)), np.zeros((len(texts), classes), np.int64)
            # Windows of like length side by side, and only as many steps as the longest takes.
            order = np.argsort(-length, kind="stable")
            for at in range(0, len(order), SIDE):
                now = order[at:at + SIDE]
                t, n = read(padded(data, first[now], length[now])[:length[now[0]]])
                np.add.at(total, owner[now], t.T)
                np.add.at(labelled, owner[now], n.T)
            mean = total / np.maximum(bounds[1:] - bounds[:-1], 1)[:, None]
            lists = pa.array(np.arange(len(texts) + 1) * classes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(columns)), pa.ListArray.from_arrays(lists, pa.array(mean.ravel())),
                 pa.ListArray.from_arrays(lists, pa.array(labelled.ravel()))], names=[*batch.schema.names[:columns], "__means", "__positions"])

    return run


def fit_languages(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """(languages in order, weights); no weights without labelled text."""
    rows = stage(fit_sample(docs), "language").orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect()
    names = sorted({r["lang"] for r in rows})
    if not names:
        return names, None
    return names, train([bytes(r["piece"]) for r in rows], np.array([names.index(r["lang"]) for r in rows]), len(names))


def predict_languages(docs: DataFrame) -> DataFrame:
    """All columns of docs, __lang (a learned lang or ``und``), __score (the pooled probability of __lang) and __shares.

    ``docs`` needs doc_id, text and lang; lang, source and doc_id are never inputs of a prediction, lang and doc_id only choose what is
    learned from.  __shares maps each learned language to the share of the text's bytes labelled with it.  A text that is null or holds no
    letter is ``und`` with score 0, so is every text when nothing can be learned.  Ties go to the language first in alphabetical order.
    Rows are kept as they are, repeated rows and extra columns with them.
    """
    names, weights = fit_languages(docs)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if weights is None:
        return docs.select("*", F.lit(UNKNOWN).alias("__lang"), F.lit(0.0).alias("__score"), F.create_map().cast("map<string,double>").alias("__shares"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*fields, "__lettered boolean", "__means array<double>", "__positions array<bigint>"])
    labelled = docs.select("*", lettered.alias("__lettered"), F.encode(F.col("text"), "utf-8").alias("__bytes")).mapInArrow(
        label_texts(weights, len(fields) + 1), schema)
    best = F.array_max("__means")
    lang = F.element_at(F.array(*map(F.lit, names)), F.array_position("__means", best).cast("int"))
    n = F.aggregate("__positions", F.lit(0).cast("bigint"), lambda s, x: s + x)
    shares = F.map_from_arrays(F.array(*map(F.lit, names)), F.transform("__positions", lambda k: k / F.greatest(n, F.lit(1))))
    return labelled.select(
        *(F.col(f"`{c}`") for c in docs.columns), F.when(F.col("__lettered"), lang).otherwise(UNKNOWN).alias("__lang"),
        F.when(F.col("__lettered"), F.least(best, F.lit(1.0))).otherwise(0.0).alias("__score"), shares.alias("__shares"))
