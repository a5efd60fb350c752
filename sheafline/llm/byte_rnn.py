"""Language identification with a bidirectional gated recurrent network over bytes.

Each direction has a minimal gated unit: a gate z and a candidate n with clipped linear activations,
``z = clip(Wz[byte] + Uz h, 0, 1)``, ``n = clip(Wn[byte] + z * (Un h), -1, 1)``, ``h += z * (n - h)``. The two states at
a byte give a distribution over the languages there; a document's is the mean over all its bytes. The network is trained
here, in numpy, by backpropagation through time (Adam, cross entropy at every position).

It is fitted on a bounded sample of labelled rows: ``per_language`` documents of each language, ``windows`` windows of each
document. Whole texts are labelled, in windows of ``SPAN`` bytes; windows of many texts run side by side.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without labelled rows all are; an
unlabelled row is labelled like others; ties go to the smallest label; language, source and id are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .frames import bounded_draw, crc_fold

UNITS = 8
SPAN = 128
LANES = 4096
PER_LANGUAGE = 400
WINDOWS = 6
STEPS = 240
BATCH = 256
NO_LANGUAGE = "und"
_f = np.float32


@dataclass
class Network:
    """``w*``: (256, 2 * units) gate and candidate input of each byte; ``u*``: (2 * units, units); ``out``: (labels, 2 * units)."""

    wf: np.ndarray
    uf: np.ndarray
    wb: np.ndarray
    ub: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _start(n_labels: int, units: int, rng) -> Network:
    def w():
        base = rng.normal(0, 0.3, (256, 2 * units)).astype(_f)
        base[:, :units] = 0.4 + 0.2 * base[:, :units]
        return base

    def u():
        return rng.normal(0, 0.3 / np.sqrt(units), (2 * units, units)).astype(_f)

    return Network(w(), u(), w(), u(), rng.normal(0, 0.3, (n_labels, 2 * units)).astype(_f), np.zeros(n_labels, _f))


def _step(w: np.ndarray, u: np.ndarray, codes: np.ndarray, h: np.ndarray):
    """One step of a direction on columns; returns what its backward pass needs as well."""
    units = u.shape[1]
    x = w.take(codes, axis=0).T
    g = u @ h
    az = x[:units] + g[:units]
    z = np.clip(az, 0, 1)
    an = x[units:] + z * g[units:]
    n = np.clip(an, -1, 1)
    return h + z * (n - h), (az, z, an, n, g[units:])


def _loss_and_slopes(net: Network, codes: np.ndarray, label: np.ndarray, valid: np.ndarray):
    """Cross entropy at all valid positions of (span, lanes) windows, and the slopes of every parameter."""
    span, lanes = codes.shape
    units = net.uf.shape[1]
    states, saved = [], []
    for w, u, times in ((net.wf, net.uf, range(span)), (net.wb, net.ub, range(span - 1, -1, -1))):
        h = np.zeros((units, lanes), _f)
        hs, kept = np.zeros((span, units, lanes), _f), [None] * span
        for t in times:
            old = h
            new, parts = _step(w, u, codes[t], h)
            h = np.where(valid[t], new, h)
            hs[t], kept[t] = h, (old, *parts)
        states.append(hs)
        saved.append(kept)
    both = np.concatenate(states, axis=1)
    logits = np.einsum("cu,tul->tcl", net.out, both) + net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    count = valid.sum()
    own = p[np.arange(span)[:, None], label[None, :], np.arange(lanes)[None, :]]
    loss = float(-(np.log(own + 1e-9) * valid).sum() / count)
    d = p
    d[np.arange(span)[:, None], label[None, :], np.arange(lanes)[None, :]] -= 1
    d *= (valid / count).astype(_f)[:, None, :]
    slope_out = np.einsum("tcl,tul->cu", d, both)
    slope_bias = d.sum(axis=(0, 2))
    d_both = np.einsum("cu,tcl->tul", net.out, d)
    slopes = []
    for k, (u, times) in enumerate(((net.uf, range(span - 1, -1, -1)), (net.ub, range(span)))):
        dw = np.zeros((256, 2 * units), _f)
        du = np.zeros_like(u)
        carried = np.zeros((units, lanes), _f)
        for t in times:
            old, az, z, an, n, gn = saved[k][t]
            dh = carried + d_both[t, k * units : (k + 1) * units]
            live = np.where(valid[t], dh, 0)
            d_n = live * z * ((an > -1) & (an < 1))
            d_z = live * (n - old) + d_n * gn
            d_z = d_z * ((az > 0) & (az < 1))
            d_g = np.concatenate((d_z, d_n * z))
            d_x = np.concatenate((d_z, d_n))
            du += d_g @ old.T
            np.add.at(dw, codes[t], d_x.T)
            carried = np.where(valid[t], dh * (1 - z) + u.T @ d_g, dh)
        slopes += [dw, du]
    return loss, [*slopes, slope_out.astype(_f), slope_bias.astype(_f)]


def train(windows: np.ndarray, sizes: np.ndarray, label: np.ndarray, n_labels: int, units=UNITS, steps=STEPS, batch=BATCH, seed=7) -> Network:
    """Fit on (windows, span) bytes with their lengths and labels."""
    rng = np.random.default_rng(seed)
    net = _start(n_labels, units, rng)
    first = [np.zeros_like(v) for v in vars(net).values()]
    second = [np.zeros_like(v) for v in vars(net).values()]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        codes, size = windows[pick].T.astype(np.int64), sizes[pick]
        valid = np.arange(codes.shape[0])[:, None] < size[None, :]
        _, slopes = _loss_and_slopes(net, codes, label[pick], valid)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((s * s).sum()) for s in slopes))
        for k, (value, slope) in enumerate(zip(vars(net).values(), slopes)):
            slope = slope * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope * slope
            scale = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
            value -= (rate * first[k] / (1 - 0.9**step) / scale).astype(_f)
    return net


def _direction(w, u, data, at, size, live, times) -> np.ndarray:
    """States (span, units, lanes) of one direction; lanes stand longest first, ``live[t]`` of them have a byte at t."""
    units, lanes = u.shape[1], len(at)
    h = np.zeros((units, lanes), _f)
    hs = np.empty((len(live), units, lanes), _f)
    wt = np.ascontiguousarray(w.T)
    g = np.empty((2 * units, lanes), _f)
    for t in times:
        n = int(live[t])
        x = wt.take(data[at[:n] + t], axis=1)
        own = h[:, :n]
        got = g[:, :n] if n == lanes else np.empty((2 * units, n), _f)
        np.dot(u, own, out=got)
        z = x[:units]
        z += got[:units]
        np.clip(z, 0, 1, out=z)
        c = x[units:]
        c += got[units:] * z
        np.clip(c, -1, 1, out=c)
        c -= own
        c *= z
        own += c
        hs[t, :, :n] = own
    return hs


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, labels): mean over all bytes of a row of the distribution at the byte; rows without bytes are zero."""
    lengths = np.diff(offsets)
    parts = -(-lengths // SPAN)
    row = np.repeat(np.arange(len(lengths)), parts)
    within = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * SPAN
    at, size = offsets[row] + within, np.minimum(SPAN, lengths[row] - within)
    order = np.argsort(-size, kind="stable")
    sums = np.zeros((len(lengths), len(net.bias)))
    half = net.uf.shape[1]
    for lo in range(0, len(order), LANES):
        own = order[lo : lo + LANES]
        a, s = at[own], size[own]
        live = np.searchsorted(-s, -np.arange(1, int(s[0]) + 1), side="right")
        forth = _direction(net.wf, net.uf, data, a, s, live, range(len(live)))
        back = _direction(net.wb, net.ub, data, a, s, live, range(len(live) - 1, -1, -1))
        total = np.zeros((len(net.bias), len(own)), _f)
        for t in range(len(live)):
            n = int(live[t])
            p = net.out[:, :half] @ forth[t, :, :n]
            p += net.out[:, half:] @ back[t, :, :n]
            p += net.bias[:, None]
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            total[:, :n] += p
        for c in range(len(net.bias)):
            sums[:, c] += np.bincount(row[own], total[c], len(lengths))
    return sums / np.maximum(lengths, 1)[:, None]


def _training_windows(rows: list, labels: list[str], windows: int, seed: int):
    rng = np.random.default_rng(seed)
    held, sizes, own = [], [], []
    for text, lang in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.arange(0, len(data), SPAN)
        for a in rng.permutation(starts)[:windows].tolist():
            part = data[a : a + SPAN]
            sizes.append(len(part))
            held.append(np.pad(part, (0, SPAN - len(part))))
            own.append(labels.index(lang))
    return np.array(held), np.array(sizes), np.array(own)


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, windows: int = WINDOWS, seed: int = 7):
    """(labels, network or None) learnt from rows of ``docs`` (text, lang) where ``learn`` holds; bounded by the parameters."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # as many rows as languages
    labels = sorted(counts)
    if not labels:
        return [], None
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**31))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(2**31 * min(1.0, per_language / n))).otherwise(share)
    drawn = known.filter(draw < share).select(F.lower("text").alias("text"), "lang", "doc_id")
    picked = bounded_draw(drawn, "lang", dict.fromkeys(counts, per_language), "doc_id", "text").collect()
    picked.sort(key=lambda r: (str(r["doc_id"]), r["text"]))
    parts = _training_windows([(r["text"], r["lang"]) for r in picked], labels, windows, seed)
    if not len(parts[0]):
        return [], None
    return labels, train(*parts, len(labels), seed=seed)


def identify(docs: DataFrame, labels: list[str], net: Network | None, id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.select(F.col(id_col), F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"))
    plain = docs.sparkSession.sparkContext.broadcast(vars(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(**plain.value)
        for batch in batches:
            texts = tb.text_column(batch)
            for lo, hi in tb.row_slices(texts):
                p = probabilities(own, *tb.raw_bytes(texts.slice(lo, hi - lo)))
                best = p.argmax(axis=1)
                some = np.asarray(batch.column(2).slice(lo, hi - lo))
                names = [labels[k] if ok else NO_LANGUAGE for k, ok in zip(best.tolist(), some.tolist())]
                score = np.where(some, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score.astype(float))],
                    names=["id", "lang_pred", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.lower("text").alias("text"), lettered.alias("lettered"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identified_documents(docs: DataFrame, fold: int = 3, held_out: int = 1) -> DataFrame:
    """Learn from the rows outside the held-out fold, label all."""
    outside = crc_fold(fold) != held_out
    labels, net = fit(docs, outside)
    return identify(docs, labels, net).withColumn("held_out", ~outside)
