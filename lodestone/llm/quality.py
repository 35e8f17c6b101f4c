"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_hash, give_back, importable, text_or_empty, trimmed
from .words import Words, mix, pieces, slices

#: Hashed words have 2^BITS slots; each structure statistic has BINS more, one of which is on.
BITS, BINS, RANK = 15, 12, 8

STATS = (
    "chars", "words", "word_length", "upper", "digits", "marks", "symbols", "beyond_ascii", "distinct", "distinct_runs",
    "commonest", "repeats", "line_length", "stop_marks", "ends", "declared",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[list(chars)] = 1
    return t


_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT, _MARK, _END = _table(b"0123456789"), _table(b".,;:!?'\"()-"), _table(b".!?")
_SYMBOL = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"))
_BEYOND, _LINE = _table(bytes(range(192, 256))), _table(b"\n")


def features(texts: list[bytes], declared: list[int | None]):
    """For runs of texts: (rows of the words, slots, weights), then the statistics of each text.

    A word weighs 1 + log of its count; a text's word weights have length 1.
    """
    for lo, hi in pieces(texts):
        part = texts[lo:hi]
        w, n = Words(part), hi - lo
        size = np.array([len(t) for t in part], np.int64)
        starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
        total = lambda t: np.add.reduceat(t[w.raw], starts)  # noqa: E731  each text's own newline is in the joined bytes
        count = w.per_doc.astype(np.float64)
        some = np.maximum(count, 1)
        pair, times = np.unique(w.doc.astype(np.uint64) << np.uint64(40) | w.hash >> np.uint64(24), return_counts=True)
        row = (pair >> np.uint64(40)).astype(np.int64)
        slot = (pair & np.uint64((1 << 40) - 1)) >> np.uint64(40 - BITS)
        weight = 1 + np.log(times)
        weight /= np.sqrt(np.bincount(row, weight**2, n))[row]
        runs = mix(w.hash[:-2] * np.uint64(31) + w.hash[1:-1] * np.uint64(37) + w.hash[2:]) if len(w.hash) > 2 else np.zeros(0, np.uint64)
        same = w.doc[:-2] == w.doc[2:] if len(w.hash) > 2 else np.zeros(0, bool)
        runs_of = w.doc[:-2][same] if len(w.hash) > 2 else np.zeros(0, np.int64)
        distinct_runs = np.bincount((np.unique(runs_of.astype(np.uint64) << np.uint64(40) | runs[same] >> np.uint64(24)) >> np.uint64(40)).astype(np.int64), minlength=n)
        again = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, row, times)
        letters, chars = np.maximum(total(_LETTER), 1), np.maximum(size, 1)
        ends = total(_END)
        x = np.stack([
            np.log1p(size), np.log1p(count), np.bincount(w.doc, (w.end - w.start), n) / some, total(_UPPER) / letters, total(_DIGIT) / chars,
            total(_MARK) / chars, total(_SYMBOL) / some, total(_BEYOND) / chars, np.bincount(row, minlength=n) / some,
            np.where(count > 2, distinct_runs / np.maximum(count - 2, 1), 1.0), top / some, again / some, np.log1p(size / np.maximum(total(_LINE), 1)),
            total(_MARK) / some, ends / some, np.log1p([len(t) if d is None or d < 0 else d for t, d in zip(part, declared[lo:hi])]),
        ], axis=1)
        yield row, slot.astype(np.int64), weight.astype(np.float32), x


class Machine:
    """w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, the pairs by the sum-of-squares identity in linear time."""

    def __init__(self, edges: np.ndarray, seed: int = 7):
        self.edges, size = edges, (1 << BITS) + len(STATS) * BINS
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bias, self.w, self.v = 0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32)

    def joined(self, row, slot, weight, x):
        """Adds each text's bins to its words; entries come sorted by row."""
        n = len(x)
        bins = np.stack([np.searchsorted(self.edges[j], x[:, j]) for j in range(len(STATS))], axis=1)
        more = ((1 << BITS) + np.arange(len(STATS)) * BINS + bins).astype(slot.dtype)
        rows = np.concatenate([row, np.repeat(np.arange(n, dtype=row.dtype), len(STATS))])
        order = np.argsort(rows, kind="stable")
        return rows[order], np.concatenate([slot, more.ravel()])[order], np.concatenate([weight, np.full(more.size, 0.5, np.float32)])[order]

    def logits(self, row, slot, weight, n: int):
        """Every row has entries, as every text has its bins."""
        first = np.searchsorted(row, np.arange(n))
        vx = self.v[slot] * weight[:, None]
        s = np.add.reduceat(vx, first)
        squares = np.add.reduceat((vx**2).sum(1), first)
        return self.bias + np.add.reduceat(self.w[slot] * weight, first) + 0.5 * ((s**2).sum(1) - squares), s, vx

    def fit(self, row, slot, weight, y, epochs: int = 10, batch: int = 128, rate: float = 0.05, decay: float = 1e-5):
        """Adagrad on the logistic loss, in a fixed order."""
        n = len(y)
        rng = np.random.Generator(np.random.PCG64(11))
        first = np.searchsorted(row, np.arange(n + 1))
        gw, gv, gb = np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                docs = order[lo : lo + batch]
                at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                r = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
                sl, wt = slot[at], weight[at]
                z, s, vx = self.logits(r, sl, wt, len(docs))
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) / len(docs)).astype(np.float32)
                e = g[r] * wt
                by = np.argsort(sl, kind="stable")
                own, head = np.unique(sl[by], return_index=True)
                dw = np.add.reduceat(e[by], head) + decay * self.w[own]
                dv = np.add.reduceat((e[:, None] * (s[r] - vx))[by], head) + decay * self.v[own]
                gw[own] += dw**2
                gv[own] += dv**2
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] -= rate * dv / np.sqrt(gv[own])
                gb += g.sum() ** 2
                self.bias -= rate * float(g.sum()) / gb**0.5
        return self

    def score(self, texts: list[bytes], declared: list[int | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for row, slot, weight, x in features(texts, declared):
            z, _, _ = self.logits(*self.joined(row, slot, weight, x), len(x))
            out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
        return np.concatenate(out)


def _raw(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _declared(docs: DataFrame) -> Column:
    """n_chars, or null where there is no such column."""
    return (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("declared_")


def held_out(doc_id: Column) -> Column:
    """A third of the ids, by checksum; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _first_bytes(docs: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """The labelled rows (doc_id, y_) whose texts come to ``most`` bytes, in the order of the ids' hashes; the first one
    stays in any case. Their sizes alone reach the driver."""
    order = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "y_"), F.lit(1 << 31)).alias("h_")
    sizes = docs.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y_", order).agg(F.sum(F.octet_length("text_")).alias("bytes_")).toArrow()
    sizes = sizes.sort_by([(c, "ascending") for c in ("h_", "doc_id", "y_")])
    fit = int((np.cumsum(sizes["bytes_"].to_numpy()) <= most).sum())
    if fit == sizes.num_rows:
        return rows
    kept = sizes.slice(0, max(1, fit)).select(["doc_id", "y_"])
    return docs.sparkSession.createDataFrame(list(zip(kept["doc_id"].to_pylist(), kept["y_"].to_pylist())), "doc_id long, y_ int")


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, label_col: str = "quality", most: int = 64_000_000) -> Machine:
    """Fits a machine to at most ``sample`` labelled rows that aren't held out, whose texts come to ``most`` bytes at most:
    those with the smallest hashes of their id.

    These bounds are on what reaches the driver: the slots and weights of all words of these rows and statistics, no text. Rows with a null label
    or id are left out. A table without n_chars is taken as one where it is null. Without labelled rows, or with one class alone, the machine gives the share of label 1 (0.5 without rows).
    """
    importable(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y_")).where("doc_id is not null and y_ is not null")
    rows = by_hash(rows.where(~held_out(F.col("doc_id"))), sample, "doc_id", "y_")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text_"), _declared(docs))
    rows = _first_bytes(base, rows, most)
    picked = base.join(F.broadcast(rows), "doc_id")

    def run(batches):
        for b in slices(batches, column=1):
            y = b.column(3).to_pylist()
            done = 0
            for row, slot, weight, x in features(_raw(b.column(1)), b.column(2).to_pylist()):
                n = len(x)
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(done, n), pa.array(y[done : done + n], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(weight)), pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * len(STATS)).astype(np.int32)), pa.array(x.astype(np.float64).ravel())),
                ], names=["doc_id", "y", "slot", "weight", "x"])
                done += n

    found = picked.select("doc_id", "text_", "declared_", "y_").mapInArrow(trimmed(run), "doc_id long, y int, slot array<int>, weight array<float>, x array<double>").toArrow().sort_by("doc_id")
    y = found["y"].to_numpy().astype(np.float64)
    if not len(y):
        return Machine(np.zeros((len(STATS), BINS - 1)))
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    slots, weights = found["slot"].combine_chunks(), found["weight"].combine_chunks()
    length = slots.value_lengths().to_numpy(zero_copy_only=False)
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    m = Machine(edges)
    m.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    if 0 < y.mean() < 1:
        # 32-bit numbers and no copy that outlives its use: the driver holds the sample twice at most
        entries = m.joined(np.repeat(np.arange(len(y), dtype=np.int32), length), slots.flatten().to_numpy(), weights.flatten().to_numpy(), x)
        del found, slots, weights
        m.fit(*entries, y)
        del entries
    give_back()
    return m


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher for better) and predicted.

    Only the text and n_chars are read; a null n_chars, or a table without it, takes it from the text. Null and empty texts score as texts
    without words. Null and repeated ids stay as they are; extra columns are ignored; an empty table gives an empty
    one. Nothing is shuffled; the machine (1.3 MB, whatever the input) is broadcast.
    """
    importable(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty("text").alias("text_"), _declared(docs))

    def run(batches):
        for b in slices(batches, column=2):
            s = held.value.score(_raw(b.column(2)), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return base.mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that the machine predicts to be good, with all their columns; scored as in ``score``."""
    importable(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns

    def run(batches):
        for b in slices(batches, column=names.index("text")):
            declared = b.column(names.index("n_chars")).cast(pa.int64()).to_pylist() if "n_chars" in names else [None] * b.num_rows
            s = held.value.score(_raw(b.column(names.index("text"))), declared)
            yield b.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(trimmed(run), docs.schema)
