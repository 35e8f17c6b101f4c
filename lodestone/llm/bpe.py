"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The vocabulary file is a public tokenizer's JSON with word ends. Frequent words are compiled with their ids into one
automaton that shares suffixes; its arrays lie in one block, broadcast to one file an executor, which all its workers
memory-map. All distinct words of a slice of texts walk it at once. Words that it doesn't hold are merged by the file's
ranks, exactly.
"""

from __future__ import annotations

import json
import mmap
import pickle
import struct
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, importable, text_or_empty, trimmed
from .words import slices

#: Words compiled at most, and the least number of times that a word must occur to be compiled.
LEXICON, OFTEN = 200_000, 20


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


#: Stands for the rank of a pair that doesn't join.
_NONE = (1 << 31) - 1

_CONTROL = regex.compile("[\x1c-\x1f]")


class Merger:
    """The file's own rules: splits a text into words and merges a word's characters by rank."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(m): i for i, m in enumerate(pairs)}
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: whether the rule takes a run of letters whole, as the file's does
        self.letters = self.word.findall("abcdefghijklmnopqrstuvwxyz") == ["abcdefghijklmnopqrstuvwxyz"] and "\\p{L}]+" in split["pattern"]["Regex"]
        self.chars = [c for _, c in sorted(_byte_chars().items())]
        self._tables()

    def _tables(self) -> None:
        """The merges as sorted arrays of pairs of ids, and the ranks of all pairs of single bytes in one matrix."""
        known = [(self.vocab[a], self.vocab[b], r, self.vocab[a + b]) for (a, b), r in self.ranks.items() if a in self.vocab and b in self.vocab and a + b in self.vocab]
        self.whole = len(known) == len(self.ranks) and all(c in self.vocab and c + self.end in self.vocab for c in self.chars)
        if not self.whole:
            return
        x = np.array(known, np.int64).reshape(-1, 4)
        key = x[:, 0] << 32 | x[:, 1]
        order = np.argsort(key)
        self.pairs, self.pair_rank, self.pair_into = np.append(key[order], 1 << 62), np.append(x[order, 2], _NONE).astype(np.int32), np.append(x[order, 3], 0).astype(np.int32)
        inner, last = (np.array([self.vocab[c + e] for c in self.chars], np.int32) for e in ("", self.end))
        self.first = np.concatenate([inner, last])  # by byte, and by byte + 256 at a word's end
        a, b = np.repeat(np.arange(256), 512), np.tile(np.arange(512), 256)
        self.first_rank = self._rank(self.first[a], self.first[b])[0].reshape(256, 512)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pairs, key)
        hit = self.pairs[at] == key
        return np.where(hit, self.pair_rank[at], _NONE), self.pair_into[at]

    def packed(self, word: str) -> bytes:
        return np.array(self.merge(word), "<u4").tobytes()

    def merge_all(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of many words at once: in each round every word joins its leftmost pair of the lowest rank."""
        out: dict[str, bytes] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            if self.whole and 1 < len(raw) <= 32:
                by_size.setdefault((len(raw) + 3) // 4, []).append((w, raw))
            else:
                out[w] = self.packed(w)
        for size, group in by_size.items():
            for lo in range(0, len(group), 20_000):
                part = group[lo : lo + 20_000]
                if len(part) < 16:
                    out |= {w: self.packed(w) for w, _ in part}
                else:
                    self._merge_block(part, 4 * size, out)
        return out

    def _merge_block(self, part: list[tuple[str, bytes]], width: int, out: dict) -> None:
        n = np.array([len(raw) for _, raw in part])
        byte = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in part), np.uint8).reshape(-1, width).astype(np.int32)
        rows, columns = np.arange(len(part)), np.arange(width - 1)
        byte[rows, n - 1] += 256
        sym = self.first[byte]
        rank = np.where(columns < n[:, None] - 1, self.first_rank[byte[:, :-1] & 255, byte[:, 1:]], _NONE)
        live = rows
        while len(live):
            r = rank[live]
            at = r.argmin(1)
            more = r[np.arange(len(live)), at] < _NONE
            live, at, r = live[more], at[more], r[more]
            if not len(live):
                break
            s, i = sym[live], np.arange(len(live))
            into = self._rank(s[i, at], s[i, at + 1])[1]
            # what is right of the pair moves one place to the left
            s[:, :-1] = np.where(columns > at[:, None], s[:, 1:], s[:, :-1])
            s[i, at] = into
            r[:, :-1] = np.where(columns[:-1] >= at[:, None], r[:, 1:], r[:, :-1])
            r[:, -1] = _NONE
            n[live] -= 1
            left, right = at > 0, at < n[live] - 1
            r[i[left], at[left] - 1] = self._rank(s[i[left], at[left] - 1], into[left])[0]
            r[i[right], at[right]] = self._rank(into[right], s[i[right], at[right] + 1])[0]
            r[i[~right], np.minimum(at[~right], width - 2)] = _NONE
            sym[live], rank[live] = s, r
        whole = sym.astype("<u4").tobytes()
        for (w, _), at, k in zip(part, range(0, len(whole), 4 * width), n.tolist()):
            out[w] = whole[at : at + 4 * k]

    def chunks(self, text: str) -> list:
        """The pieces of a text between white space, after normalisation; specials come as their ids.

        No word holds white space, so a piece's words depend on nothing else. Python splits at four control characters
        that the file's rule takes for marks; texts with one are split by the rule.
        """
        out: list = []
        for i, part in enumerate(self.cut.split(text)) if self.cut and "<" in text else [(0, text)]:
            if i % 2:
                out.append(self.special[part])
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                # lower() knows a final sigma, the rule doesn't
                part = "".join(map(str.lower, part)) if "\u03a3" in part else part.lower()
                if _CONTROL.search(part):
                    out += self.word.findall(part)
                else:
                    out += part.split()
        return out

    def words(self, chunk: str) -> list[str]:
        """A run of ASCII letters is one word by the rule, and most pieces are."""
        return [chunk] if self.letters and chunk.isascii() and chunk.isalpha() else self.word.findall(chunk)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: joins the leftmost pair of the lowest rank until none is left; long words use a heap."""
        parts = [self.chars[b] for b in word.encode()]
        if not parts:
            return []
        parts[-1] += self.end
        if len(parts) > 64:
            return self._merge_long(parts)
        get, none = self.ranks.get, 1 << 60
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_long(self, parts: list[str]) -> list[int]:
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (parts[k], parts[after[k]])) in ranks:
                    heapq.heappush(heap, (ranks[p], k, p))
        return [self.vocab[p] for p in parts if p is not None and p in self.vocab]


class Lexicon:
    """A minimal acyclic transducer from words (UTF-8) to id sequences.

    Each edge carries how many words pass it by (the words of smaller edges of its node and a word that ends there);
    the sum along a word's path is its number among the sorted words, and that number points to its ids. Edges of a
    node lie together. One 64-bit key, node * 256 + byte, finds an edge by binary search, so a whole array of words
    takes one search per byte position.
    """

    FIELDS = ("keys", "target", "passed", "final", "starts", "ids")
    MARK = b"\x00lexicon"

    @staticmethod
    def compile(entries: dict[str, list[int]]) -> bytes:
        words = sorted(w.encode() for w in entries)
        ids = [entries[w.decode()] for w in words]
        register: dict = {}
        nodes: list[tuple] = []  # (final, ((byte, node), ...)), children before parents

        def close(state) -> int:
            key = (state[0], tuple(state[1]))
            if key not in register:
                register[key] = len(nodes)
                nodes.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # the states of the last word, not yet closed
        last = b""
        for w in [*words, b""]:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            while len(path) - 1 > same:
                done = path.pop()
                path[-1][1].append((last[len(path) - 1], close(done)))
            for _ in w[same:]:
                path.append([False, []])
            if w:
                path[-1][0] = True
            last = w
        root = close(path[0])
        count = np.zeros(len(nodes), np.int64)
        keys, target, passed = [], [], []
        for at, (final, edges) in enumerate(nodes):
            total = int(final)
            for byte, to in edges:
                keys.append(at << 8 | byte)
                target.append(to)
                passed.append(total)
                total += int(count[to])
            count[at] = total
        parts = [
            np.array(keys, np.int64), np.array(target, np.int64), np.array(passed, np.int64), np.array([n[0] for n in nodes], np.int64),
            np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), np.array([y for x in ids for y in x], np.int64),
        ]
        head = np.array([root, *map(len, parts)], np.int64)
        body = b"".join(x.tobytes() for x in (head, *parts))
        # so many bytes more that the arrays of the pickled block start at a multiple of 8 in its file
        pad = -(pickle.dumps(Lexicon.MARK + bytes(len(body)), 5).index(Lexicon.MARK) + len(Lexicon.MARK) + 1) % 8
        return Lexicon.MARK + bytes([pad]) + bytes(pad) + body

    @classmethod
    def of_broadcast(cls, block) -> Lexicon:
        """Maps the file that holds the broadcast block on this executor, so its workers share one copy; where there is
        no such file (encrypted broadcasts), reads the block."""
        try:
            with open(block._path, "rb") as f:
                return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        except (AttributeError, OSError, TypeError, ValueError):
            return cls(block.value)

    def __init__(self, block):
        self.block = block
        at = block[:256].index(self.MARK) + len(self.MARK)
        at += 1 + block[at]
        raw = np.frombuffer(block, np.uint8, offset=at)
        raw = raw[: len(raw) // 8 * 8]
        body = (raw if raw.ctypes.data % 8 == 0 else raw.copy()).view(np.int64)
        self.root, at = int(body[0]), 1 + len(self.FIELDS)
        for name, n in zip(self.FIELDS, body[1:at].tolist()):
            setattr(self, name, body[at : at + n])
            at += n

    def find(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for a word that isn't held."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        joined = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        first = np.cumsum(size) - size
        state, number = np.full(len(raw), self.root, np.int64), np.zeros(len(raw), np.int64)
        live = np.flatnonzero(size > 0) if len(self.keys) else np.zeros(0, np.int64)
        lost = np.ones(len(raw), bool)
        step = 0
        while len(live):
            key = state[live] << 8 | joined[first[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.target[at]
            number[live] += self.passed[at]
            step += 1
            ended = size[live] == step
            lost[live[ended]] = self.final[state[live[ended]]] == 0
            live = live[~ended]
        number[lost] = -1
        return number

    def of(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()

    def packed(self, numbers: np.ndarray) -> list[bytes]:
        """The ids of many words, each word's as little-endian 32-bit integers."""
        first, last = self.starts[numbers], self.starts[numbers + 1]
        size = last - first
        end = np.cumsum(size)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(first - end + size, size)
        whole = self.ids[at].astype("<u4").tobytes()
        ends = (4 * end).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]


class Coder:
    """Encodes and decodes in one worker. Pieces seen are cached with their ids in two generations of at most about MOST
    bytes each, by what strings, ids and entries take: a full young one becomes the old one, whose pieces come back when
    they are seen again. Decoded text is built from the tokens' strings."""

    MOST, ENTRY = 32 << 20, 190

    def __init__(self, merger: Merger, lexicon: Lexicon):
        self.merger, self.lexicon = merger, lexicon
        self.ids: dict = {}
        self.old: dict = {}
        self.held = 0
        self.token = [merger.token.get(i, "") for i in range(max(merger.token, default=-1) + 1)]

    def learn(self, chunks: set) -> None:
        if self.held > self.MOST:
            self.old, self.ids, self.held = self.ids, {}, 0
        new = [c for c in chunks if c not in self.ids]
        if self.old:
            old = self.old
            back = {c: old[c] for c in new if c in old}
            new = [c for c in new if c not in back]
            self._keep(back)
        special = {c: struct.pack("<I", c) for c in new if c.__class__ is not str}
        texts = [c for c in new if c.__class__ is str] if special else new
        split = list(map(self.merger.words, texts))
        words = list(set().union(*split))
        numbers = self.lexicon.find(words)
        held = np.flatnonzero(numbers >= 0)
        found = dict(zip([words[i] for i in held.tolist()], self.lexicon.packed(numbers[held])))
        found |= self.merger.merge_all([words[i] for i in np.flatnonzero(numbers < 0).tolist()])
        self._keep({c: found[ws[0]] if len(ws) == 1 else b"".join([found[w] for w in ws]) for c, ws in zip(texts, split)})
        self._keep(special)

    def _keep(self, more: dict) -> None:
        self.ids.update(more)
        self.held += sum(len(c) for c in more if c.__class__ is str) + sum(map(len, more.values())) + self.ENTRY * len(more)

    def encode(self, texts: list[str]):
        """For each text the ids as little-endian 32-bit integers and the decoded text.

        The file names no decoder: tokens are joined by blanks.
        """
        split = [self.merger.chunks(t) for t in texts]
        self.learn(set().union(*split))
        ids, token = self.ids.__getitem__, self.token.__getitem__
        for chunks in split:
            packed = b"".join(map(ids, chunks))
            yield packed, " ".join(map(token, np.frombuffer(packed, "<u4").tolist()))


def word_counts(docs: DataFrame, spec: str, most: int = 150_000) -> DataFrame:
    """(word, n) over all documents. A worker counts up to about ``most`` different pieces before it passes them on."""

    def run(batches):
        merger = Merger(json.loads(spec))
        pieces: Counter = Counter()

        def flush():
            seen: Counter = Counter()
            for c, n in pieces.items():
                if isinstance(c, str):
                    for w in merger.words(c):
                        seen[w] += n
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in slices(batches, 500, 0, 1_000_000):
            for t in b.column(0).to_pylist():
                pieces.update(merger.chunks(t))
            if len(pieces) > most:
                yield flush()
        if pieces:
            yield flush()

    return docs.select("text_").mapInArrow(trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> list[str]:
    """The words (word, n) of the highest counts, at most ``most``: counts fall into bins of a 64th of an octave, and the
    bins from the top that fit whole are taken, so that no more than the result reaches the driver."""
    b = F.floor(F.log2("n") * 64)
    bins = sorted(((r.b, r["count"]) for r in counts.groupBy(b.alias("b")).count().collect()), reverse=True)
    least, total = None, 0
    for at, n in bins:
        if (total := total + n) > most:
            break
        least = at
    return [] if least is None else [r.word for r in counts.where(b >= least).select("word").collect()]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lexicon: int = LEXICON, often: int = OFTEN) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary, little-endian unsigned 32-bit) and the text that they decode to.

    The lexicon holds at most ``lexicon`` of the most frequent words of all documents, with at least ``often``
    occurrences: a bounded list, compiled on the driver and broadcast. It changes speed alone, as other words are merged by
    the same rules. Null and empty texts have no ids and decode to the empty text. Null and repeated ids stay as they
    are; extra columns are ignored; an empty table gives an empty one.
    """
    importable(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text_"))
    merger = Merger(json.loads(spec))
    top = commonest(Scratch(docs.sparkSession).keep(word_counts(base, spec).where(F.col("n") >= often), "words"), lexicon)
    block = docs.sparkSession.sparkContext.broadcast(Lexicon.compile({w: merger.merge(w) for w in top}))

    def run(batches):
        coder = Coder(Merger(json.loads(spec)), Lexicon.of_broadcast(block))
        for part in slices(batches, 500, 1, 1_000_000):
            out = list(coder.encode(part.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["doc_id", "ids", "decoded"])

    return base.mapInArrow(trimmed(run), "doc_id long, ids binary, decoded string")


def digest_columns(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
