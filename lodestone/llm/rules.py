"""Quality rules: decision lists of threshold conjunctions, learned from labelled statistics by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, by_hash, give_back, importable, text_or_empty, trimmed
from .quality import held_out
from .words import Words, mix, pieces, slices

#: Fixed by the contract: the symbols that count, and the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

#: The counts of the contract, then shares that rules are made of (0 where there is nothing to divide by).
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (
    "word_length", "symbols_a_word", "dup_line_share", "repeat_share", "distinct_share", "commonest_share", "again_share", "upper_share",
    "digit_share", "marks_a_word", "stops_a_word", "words_a_line",
)
STATS = ("n_words", *SHARES)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[list(chars)] = 1
    return t


_SYMBOL, _UPPER, _DIGIT, _STOP = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b".!?")
_MARK = _table(b".,;:!?'\"()-")
#: Bytes that start a code point outside the ASCII white space.
_CHAR = _table(bytes(c for c in range(256) if c & 0xC0 != 0x80 and chr(c) not in WS_CHARS))
_SPACE = WS_CHARS.encode()


def measured(texts: list[bytes]):
    """For runs of texts: their counts (rows x COUNTS, whole numbers) and shares (rows x SHARES)."""
    for lo, hi in pieces(texts):
        part = texts[lo:hi]
        w, n = Words(part, lower=False), hi - lo
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])[:-1]]).astype(np.int64)
        total = lambda t: np.add.reduceat(t[w.raw], starts).astype(np.int64)  # noqa: E731  each text's own newline is in the joined bytes
        # keys of a text's words, and of its windows of three: 64 bits that the text's number goes into
        of = w.doc.astype(np.uint64)
        word, times = np.unique(mix(w.hash * np.uint64(31) + of), return_index=True, return_counts=True)[1:]
        distinct, top = np.bincount(w.doc[word], minlength=n), np.zeros(n, np.int64)
        np.maximum.at(top, w.doc[word], times)
        covered = np.zeros(len(w.hash), bool)
        if len(w.hash) > 2:
            same = np.flatnonzero(w.doc[:-2] == w.doc[2:])
            window = mix(mix(w.hash[same] * np.uint64(31) + w.hash[same + 1]) * np.uint64(37) + w.hash[same + 2]) + of[same]
            _, inverse, found = np.unique(mix(window), return_inverse=True, return_counts=True)
            twice = same[found[inverse] > 1]
            for k in range(3):
                covered[twice + k] = True
        again = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n)
        full, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, t in enumerate(part):
            lines = [x for x in t.split(b"\n") if x.strip(_SPACE)]
            full[i], dup[i] = len(lines), len(lines) - len(set(lines))
        words, symbols, chars = w.per_doc.astype(np.int64), total(_SYMBOL), total(_CHAR)
        repeat = np.bincount(w.doc, covered, n).astype(np.int64)
        share = lambda a, b: a / np.maximum(b, 1)
        shares = [
            share(chars, words), share(symbols, words), share(dup, full), share(repeat, words), share(distinct, words), share(top, words), share(again, words),
            share(total(_UPPER), chars), share(total(_DIGIT), chars), share(total(_MARK), words), share(total(_STOP), words), share(words, full),
        ]
        yield np.stack([words, chars, symbols, dup, repeat], axis=1), np.stack(shares, axis=1)


def statistics(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns ``more`` (longs), COUNTS and SHARES of the whole text. Null and
    empty texts have no words. Words and windows are told apart by 64-bit hashes."""
    importable(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("long").alias(c) for c in more), text_or_empty(text_col).alias("text_"))
    names = ["doc_id", *more, *COUNTS, *SHARES]

    def run(batches):
        for b in slices(batches, column=b_text):
            own, done = b.columns[:b_text], 0
            for counts, shares in measured(b.column(b_text).cast(pa.binary()).to_pylist()):
                n = len(counts)
                yield pa.RecordBatch.from_arrays([*(c.slice(done, n) for c in own), *map(pa.array, counts.T), *map(pa.array, shares.T)], names=names)
                done += n

    b_text = 1 + len(more)
    kinds = ["long"] * (1 + len(more) + len(COUNTS)) + ["double"] * len(SHARES)
    return base.mapInArrow(trimmed(run), ", ".join(f"{c} {k}" for c, k in zip(names, kinds)))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, "<=" or ">", threshold) that makes a text bad."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for stat, op, t in self.conditions:
            out &= x[stat] <= t if op == "<=" else x[stat] > t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for stat, op, t in self.conditions:
            out = out & (F.col(stat) <= t if op == "<=" else F.col(stat) > t)
        return out

    def with_one(self, stat: str, op: str, t: float) -> Rule:
        """One more condition, which takes the place of a weaker one on the same side of the same statistic."""
        kept = tuple(c for c in self.conditions if c[:2] != (stat, op))
        return Rule((*kept, (stat, op, t)))

    def __str__(self) -> str:
        return " and ".join(f"{stat} {op} {t:g}" for stat, op, t in self.conditions)


def _thresholds(v: np.ndarray, most: int = 64) -> np.ndarray:
    """Quantiles of a statistic, of three digits, so rules read well."""
    cuts = np.unique(np.quantile(v, np.linspace(0, 1, most + 1)))
    return np.unique([float(f"{c:.3g}") for c in (cuts[:-1] + cuts[1:]) / 2]) if len(cuts) > 1 else cuts[:0]


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Rule]:
    """Adds the condition of the greatest information gain until the rule holds for bad rows alone; all the rules on the
    way, from the first condition on."""
    rules, there = [Rule(())], np.ones(len(bad), bool)
    while len(rules) <= longest:
        p, n = (there & bad).sum(), (there & ~bad).sum()
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for stat, v in x.items():
            cuts = _thresholds(v[there])
            # counts of bad and of other rows up to each threshold
            upto_p, upto_n = (np.searchsorted(np.sort(v[there & who]), cuts, side="right") for who in (bad, ~bad))
            for op, ps, ns in (("<=", upto_p, upto_n), (">", p - upto_p, n - upto_n)):
                gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - before), 0)
                if len(gain) and gain.max() > best[0]:
                    best = gain.max(), (stat, op, float(cuts[gain.argmax()]))
        if best[1] is None:
            break
        rules.append(rules[-1].with_one(*best[1]))
        there &= rules[-1].holds(x)
    return rules[1:]


def _precision(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, float, int]:
    """Of the rows that the rule holds for: the share of bad ones after one of either kind is added, as few rows say
    little; the share itself; the number."""
    held = rule.holds(x)
    n, p = int(held.sum()), int((held & bad).sum())
    return (p + 1) / (n + 2), p / n if n else 0.0, n


def cover(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 16, longest: int = 4, precision: float = 0.9) -> list[Rule]:
    """Learns an ordered list of rules for the bad rows, one after another, each from what those before it leave.

    Two thirds of the rows grow a rule, the rest prunes it: of the rule and its beginnings, the one of greatest precision
    there stays, where few rows count for less. A rule counts if at least ``precision`` of the rows that it holds for are bad, among the rows that prune
    and among all, and five of them at least; the first that doesn't ends the list.
    """
    rules, left = [], np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    pick = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
    while len(rules) < most and (left & bad).sum() >= 5:
        grow, prune = pick(left & ~third), pick(left & third)
        stems = _grown(*grow, longest)
        if not stems:
            break
        best = max(stems, key=lambda r: (_precision(r, *prune)[0], -len(r.conditions)))
        (_, pruned, _), (_, whole, n) = _precision(best, *prune), _precision(best, *pick(left))
        if min(pruned, whole) < precision or n < 5:
            break
        rules.append(best)
        left &= ~best.holds(x)
    return rules


def base_failed() -> Column:
    """The contract's own rules over COUNTS."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000, label_col: str = "quality", **settings) -> list[Rule]:
    """Learns a decision list from at most ``sample`` labelled rows that aren't held out, those with the smallest hashes
    of their id; ``settings`` go to ``cover``.

    The bound is what reaches the driver: the statistics of that many rows, 18 numbers each, no text. Texts that the base
    rules reject teach nothing, as they are rejected before. Rows with a null label or id are left out. Where a label is
    the same for all, or there is none, the list is empty.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("y_")).where("doc_id is not null and y_ is not null")
    rows = by_hash(rows.where(~held_out(F.col("doc_id"))), sample, "doc_id", "y_")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = statistics(base.join(F.broadcast(rows), "doc_id"), "y_").where(~base_failed()).select("doc_id", "y_", *STATS).toArrow()
    found = found.sort_by([(c, "ascending") for c in ("doc_id", "y_", *STATS)])
    bad = found["y_"].to_numpy() != 1
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(bad))
    x = {c: found[c].to_numpy().astype(np.float64)[order] for c in STATS}
    give_back()
    return cover(x, bad[order], **settings)


def decision(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression over STATS: the number of the first rule that holds, from 1, or 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), k).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of ``docs``: doc_id, COUNTS, base_failed, kept, and the rule that decided (text; null where none
    held, "base" where the base rules did).

    Null and empty texts fail the base rules. Null and repeated ids stay as they are; extra columns are ignored; an empty
    table gives an empty one. Texts are read once, nothing is shuffled, and the rules are part of the plan.
    """
    names = F.array(*(F.lit(str(r)) for r in rules)) if rules else F.array().cast("array<string>")
    x = statistics(docs).withColumn("base_failed", base_failed()).withColumn("number_", decision(rules))
    why = F.when(F.col("base_failed"), "base").when(F.col("number_") > 0, F.try_element_at(names, F.col("number_")))
    return x.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("number_") == 0)).alias("kept"), why.alias("rule"))
