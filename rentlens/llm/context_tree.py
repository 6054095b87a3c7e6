"""Language-model scoring by context-tree weighting over byte contexts, with a unigram base line."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.shared import summed, text_of
from rentlens.session import cut_lineage

#: Longest context in bytes. Every context of the training rows is a node of the tree.
DEPTH = 5
#: Contexts of this depth or less are weighted on the driver (a fixed number), the trees of longer ones in tasks.
TOP = 1
END = 10
#: Bytes worked on at a time, distinct grams a task holds before it passes them on, and words that are broadcast.
CHUNK, HELD, HEAD_WORDS = 1 << 20, 1_500_000, 40_000
HEAD_SHARE = 16
#: Grams whose probability is broadcast; any others are joined to the texts by a shuffle. Grams weighted at a time.
HEAD_GRAMS, WEIGHED = 1 << 21, 1 << 16
#: A place without a gram: no gram of a text consists of such bytes.
NO_GRAM = np.uint64((1 << 64) - 1)
#: Decision nodes of a byte that are weighted together.
NODES_AT_ONCE = 16


def plain(text: str) -> bytes:
    """ASCII-lower-cased words joined by one space, and an end mark. ``bytes`` methods know ASCII white space only."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) + bytes([END])


def segments(texts: list[str], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Buffers of about ``CHUNK`` bytes with the places ``(row, start, stop)`` of what they hold of each text.

    In front of each place stand the ``depth`` bytes before it, end marks at the start of a text, so contexts never
    reach into another text, and a long text is cut without loss.
    """
    parts, places, size = [], [], 0
    for row, text in enumerate(texts):
        body = plain(text)
        for at in range(0, len(body), CHUNK):
            part, before = body[at:at + CHUNK], body[max(0, at - depth):at].rjust(depth, bytes([END]))
            parts += [before, part]
            places.append((row, size + depth, size + depth + len(part)))
            size += depth + len(part)
            if size >= CHUNK:
                yield np.frombuffer(b"".join(parts), np.uint8), places
                parts, places, size = [], [], 0
    if places:
        yield np.frombuffer(b"".join(parts), np.uint8), places


def gram_codes(buffer: np.ndarray, places: list[tuple[int, int, int]], depth: int = DEPTH) -> np.ndarray:
    """The last ``depth`` bytes and the byte itself at every place as one number, the byte lowest."""
    codes = np.zeros(len(buffer), np.uint64)
    wide = buffer.astype(np.uint64)
    for back in range(depth + 1):
        codes[back:] |= wide[:len(wide) - back] << np.uint64(8 * back)
    real = np.zeros(len(buffer) + 1, np.int8)
    starts, stops = np.array([p[1] for p in places]), np.array([p[2] for p in places])
    real[starts] += 1
    np.subtract.at(real, stops, 1)
    return codes[np.cumsum(real[:-1]) > 0]


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def count_grams(docs: DataFrame, head: frozenset[bytes], depth: int = DEPTH, text_col: str = "text", train: Column | None = None) -> DataFrame:
    """``code, word, n, others``: byte grams (``word`` null) and the head words (``code`` null) with their counts, ``n`` in
    the rows where ``train`` holds (all, if not given) and ``others`` in the rest, where only grams are counted.

    Tasks pass on each distinct gram they hold with its count; the sums are made by Spark.
    """
    def batch(codes, counts, train, words=()):
        n, zeros = len(codes), np.zeros(len(codes), np.int64)
        counts = np.asarray(counts, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(np.asarray(codes).astype(np.int64)), pa.nulls(len(words), pa.int64())]),
             pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([w for w, _ in words], pa.binary())]),
             pa.concat_arrays([pa.array(counts if train else zeros), pa.array([c for _, c in words], pa.int64())]),
             pa.concat_arrays([pa.array(zeros if train else counts), pa.array([0] * len(words), pa.int64())])], names=["code", "word", "n", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = {True: [], False: []}, Counter()
        for b in batches:
            mine = b.column(1).to_numpy(zero_copy_only=False)
            for kind, own in held.items():
                texts = b.column(0).filter(pa.array(mine == kind)).to_pylist()
                for buffer, places in segments(texts, depth):
                    own.append(np.unique(gram_codes(buffer, places, depth), return_counts=True))
                    if sum(len(h[0]) for h in own) > HELD // 2:
                        own[:] = [_merge(own)]
                        if len(own[0][0]) > HELD // 4:
                            yield batch(*own.pop(), kind)
                for t in texts if kind else ():
                    words.update(head.intersection(w := plain(t)[:-1].split(b" ")) and filter(head.__contains__, w))
        for kind, own in held.items():
            if own or kind and words:
                yield batch(*(_merge(own) if own else ([], [])), kind, list(words.items()) if kind else ())

    rows = docs.select(text_of(text_col).alias("t"), (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("train"))
    return rows.mapInArrow(run, "code long, word binary, n long, others long").groupBy("code", "word").agg(F.sum("n").alias("n"), F.sum("others").alias("others"))


@dataclass(frozen=True)
class Tree:
    """An automaton over bytes whose states are the kept contexts, and the log10 probability of each next byte."""
    step: np.ndarray
    log10: np.ndarray
    depth: int

    def states(self, buffer: np.ndarray) -> np.ndarray:
        """The state before each byte. A state depends on ``depth`` bytes only, so the buffer is cut into lanes that
        are read side by side, each after a run-up."""
        n, d = len(buffer), self.depth
        m = max(64, -(-n // 4096))
        lanes = -(-n // m)
        padded = np.full(d + lanes * m, END, np.uint8)
        padded[d:d + n] = buffer
        columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, m + d)[::m].T)
        state, out = np.zeros(lanes, np.int32), np.empty((m, lanes), np.int32)
        for t in range(m + d):
            if t >= d:
                out[t - d] = state
            state = self.step.take((state << 8) + columns[t])
        return out.T.ravel()[:n]

    def score(self, texts: list[str]) -> np.ndarray:
        """log10 probability of each text."""
        out = np.zeros(len(texts))
        for buffer, places in segments(texts, self.depth):
            p = self.log10.take((self.states(buffer).astype(np.int64) << 8) + buffer)
            edges = np.array([e for _, a, b in places for e in (a, b)])
            sums = np.add.reduceat(np.append(p, np.float32(0)), edges, dtype=np.float64)[::2]
            np.add.at(out, [r for r, _, _ in places], sums)
        return out


def _bits(sums: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen at decision nodes of a byte (highest bit first, node 1 the root), from the running sums of
    the counts of bytes."""
    low, middle, high = _spans(nodes)
    return sums[:, middle] - sums[:, low], sums[:, high] - sums[:, middle]


def _spans(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte below each node, first one below its one-branch, and the end."""
    width = 256 >> np.floor(np.log2(nodes)).astype(int)
    low = (nodes * width) & 255
    return low, low + width // 2, low + width


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2 (Stirling's series after four steps up)."""
    y = x + 4
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3))


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1)


def _next_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def _mix(sums: list[np.ndarray], parents: list[np.ndarray | None], nodes: np.ndarray) -> Iterator[np.ndarray]:
    """For the contexts of each depth, the probability of a one at the given decision nodes."""
    top = len(sums) - 1
    bits = [_bits(s, nodes) for s in sums]
    rest, weight, has_child, below = [None] * (top + 1), [None] * (top + 1), [None] * (top + 1), None
    for d in range(top, -1, -1):
        zeros, ones = bits[d]
        pe = _kt(zeros, ones)
        child = np.zeros(len(zeros), bool)
        inner = np.zeros_like(pe)
        r0, r1 = zeros.copy(), ones.copy()
        if d < top:
            at = parents[d + 1]
            child[at] = True
            np.add.at(inner, at, below)
            np.subtract.at(r0, at, bits[d + 1][0])
            np.subtract.at(r1, at, bits[d + 1][1])
        # the rest either has an estimate of its own or follows that of its context
        own, p = _kt(r0, r1), _next_one(zeros, ones)
        follow = r0 * np.log(1 - p) + r1 * np.log(p)
        either = np.logaddexp(own, follow)
        alone = np.exp(own - either)
        rest[d] = alone * _next_one(r0, r1) + (1 - alone) * p
        inner += either - math.log(2)
        pw = np.where(child[:, None], np.logaddexp(pe, inner) - math.log(2), pe)
        weight[d] = np.where(child[:, None], np.exp(pe - math.log(2) - pw), 1.0)
        has_child[d], below = child, pw
    mixed = left = None
    for d in range(top + 1):
        own = _next_one(*bits[d])
        above, share = (mixed[parents[d]], left[parents[d]]) if d else (np.zeros_like(own), np.ones_like(own))
        mixed, left = above + share * weight[d] * own, share * (1 - weight[d])
        yield np.where(has_child[d][:, None], mixed + left * rest[d], mixed)


def build_tree(levels: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """The weighted tree from, per depth, the sorted context codes and their counts of next bytes (n x 256).

    Each decision node of a byte has a context tree of its own over the same contexts. From the leaves up,
    Pw = (Pe + product of the children's Pw) / 2, with Pe the KT probability of what followed the context; what
    followed it in contexts that are not kept forms one more child, which has a KT estimate of its own or follows the
    context's, half and half. A context then stops the search with the weight Pe / (2 Pw), and the prediction mixes
    the KT estimates of all depths with these weights. Codes hold the latest byte lowest, so the parent of a context
    is the code without its highest byte. Decision nodes are worked on a few at a time to save memory.
    """
    top = len(levels) - 1
    sums = [np.concatenate([np.zeros((len(c), 1)), np.cumsum(c, axis=1, dtype=float)], axis=1) for _, c in levels]
    parents = [None] + [np.searchsorted(levels[d - 1][0], levels[d][0] & np.uint64((1 << 8 * (d - 1)) - 1)) for d in range(1, top + 1)]
    first = np.concatenate([[0], np.cumsum([len(c) for c, _ in levels])])
    logs = np.zeros((first[-1], 256))
    for start in range(1, 256, NODES_AT_ONCE):
        nodes = np.arange(start, min(256, start + NODES_AT_ONCE))
        for d, one in enumerate(_mix(sums, parents, nodes)):
            for k, (low, middle, high) in enumerate(zip(*_spans(nodes))):
                logs[first[d]:first[d + 1], low:middle] += np.log10(1 - one[:, k])[:, None]
                logs[first[d]:first[d + 1], middle:high] += np.log10(one[:, k])[:, None]
    step = np.zeros((first[-1], 256), np.int32)
    for d in range(top + 1):
        # the state after a byte is the longest kept context: that of the parent, unless this context and the byte are kept
        if d:
            step[first[d]:first[d + 1]] = step[first[d - 1] + parents[d]]
        if d < top:
            codes = levels[d + 1][0]
            at = np.searchsorted(levels[d][0], codes >> np.uint64(8))
            step[first[d] + at, (codes & np.uint64(255)).astype(int)] = first[d + 1] + np.arange(len(codes))
    return Tree(step.ravel(), logs.astype(np.float32).ravel(), top)


def _ordered(codes: np.ndarray, depth: int) -> np.ndarray:
    """Codes with the latest byte of the context highest, so contexts that end alike stand together; the next byte stays lowest."""
    out = codes & np.uint64(255)
    for back in range(depth):
        out |= (codes >> np.uint64(8 * (back + 1)) & np.uint64(255)) << np.uint64(8 * (depth - back))
    return out


class _Part:
    """The context trees of all grams whose contexts end with the same bytes, in all depths below ``TOP``.

    A row of a level is a context of that depth and a next byte. The decisions of a byte are taken one after the
    other; for each, a run of rows with the same context and the same bits before it is one node of the tree.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.depth, self.keys, self.n = depth, keys, n
        self.levels, self.up = [(keys, n)], []
        for _ in range(depth, TOP + 1, -1):
            keys, at = np.unique(keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255), return_inverse=True)
            n = np.bincount(at, n, len(keys))
            self.levels.insert(0, (keys, n))
            self.up.insert(0, at)
        if depth <= TOP:
            self.levels = []
        self.seen = []
        for keys, n in self.levels:
            first, run = self._runs(keys >> np.uint64(8))
            self.seen.append((np.add.reduceat(n, first) > 0)[run])

    @staticmethod
    def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row of each run of equal keys, and the run of each row."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        return np.flatnonzero(new), np.cumsum(new) - 1

    def above(self, keys: np.ndarray, depth: int, k: int) -> np.ndarray:
        """Places in the tables of the top: the context of depth ``TOP`` and the node of the ``k``-th decision."""
        context = keys >> np.uint64(8 * depth) if depth >= TOP else keys & np.uint64(0)
        return (context * np.uint64(256) + (np.uint64(1 << k) | (keys & np.uint64(255)) >> np.uint64(8 - k))).astype(int)

    def weigh(self, k: int) -> list[tuple[np.ndarray, ...]]:
        """Per level, for the nodes of the ``k``-th decision: first row, node of each row, share of its own estimate, that
        estimate, log of the weighted probability."""
        out, below = [], None
        for i in range(len(self.levels) - 1, -1, -1):
            keys, n = self.levels[i]
            first, run = self._runs(keys >> np.uint64(8 - k))
            ones = np.add.reduceat(n * (keys >> np.uint64(7 - k) & np.uint64(1)), first)
            zeros = np.add.reduceat(n, first) - ones
            pw = pe = _kt(zeros, ones)
            share = np.ones(len(first))
            if below is not None:
                pw = np.logaddexp(pe, np.bincount(run[self.up[i][out[0][0]]], below, len(first))) - math.log(2)
                share = np.exp(pe - math.log(2) - pw)
            below = pw
            out.insert(0, (first, run, share, _next_one(zeros, ones), pw))
        return out

    def sums(self) -> np.ndarray:
        """Counts of next bytes of the contexts of depth ``TOP`` (256 x 256), and by context and node the sum of the logs of
        the weighted probabilities of the contexts one longer (256 x 256), flat."""
        below = np.zeros(1 << 16)
        if self.levels:
            keys, n = self.levels[0]
            for k in range(8):
                first, _, _, _, pw = self.weigh(k)[0]
                below += np.bincount(self.above(keys[first], TOP + 1, k), pw, 1 << 16)
            context = keys >> np.uint64(8 * (TOP + 1))
        else:
            keys, n = self.keys, self.n
            context = keys >> np.uint64(8 * self.depth) if self.depth else keys & np.uint64(0)
        counts = np.bincount((context << np.uint64(8) | keys & np.uint64(255)).astype(int), n, 1 << 16)
        return np.concatenate([counts, below])

    def log10(self, top: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each gram, from the tables of ``_top``."""
        out = np.zeros(len(self.keys))
        for k in range(8):
            keys, depth = (self.levels[0][0], TOP + 1) if self.levels else (self.keys, self.depth)
            nodes, run = self.weigh(k), slice(None)
            mixed, left, rest = top[:, self.above(keys[nodes[0][0]] if nodes else keys, depth, k)]
            for i, (first, run, share, own, _) in enumerate(nodes):
                if i:
                    up = nodes[i - 1][1][self.up[i - 1][first]]
                    mixed, left, rest = mixed[up], left[up], rest[up]
                # a context that no training row holds ends the search: what is left goes by the rest of the one before
                seen = self.seen[i][first]
                mixed, left = mixed + left * np.where(seen, share * own, rest), np.where(seen, left * (1 - share), 0.0)
                rest = _rest(own)
            one = mixed[run]
            out += np.log10(np.where(self.keys >> np.uint64(7 - k) & np.uint64(1), one, 1 - one))
        return out


def _rest(own: np.ndarray) -> np.ndarray:
    """Probability of a one in a context that was never seen, below one with the estimate ``own``: with no counts of its own
    it has one half, or follows that context, half and half."""
    return (0.5 + own) / 2


def _top(sums: np.ndarray, depth: int) -> np.ndarray:
    """For contexts of depth ``TOP`` and decision nodes (3 x 65,536, flat): what the contexts so far say of a one, the weight
    left for longer ones, and the probability where no longer one was seen."""
    counts, below = sums.reshape(2, 256, 256) if len(sums) else np.zeros((2, 256, 256))
    nodes, half = np.arange(1, 256), math.log(2)
    bits = lambda c: _bits(np.concatenate([np.zeros((len(c), 1)), np.cumsum(c, axis=1)], axis=1), nodes)
    root, some = bits(counts.sum(0)[None]), counts.sum() > 0
    pe0, own0 = _kt(*root), _next_one(*root)
    own = bits(counts)
    pe, own = _kt(*own), _next_one(*own)
    pw = pe if depth <= TOP else np.logaddexp(pe, below[:, 1:]) - half
    share0 = np.exp(pe0 - half - (np.logaddexp(pe0, pw.sum(0)[None]) - half)) if depth and some else np.ones_like(pe0)
    share = np.exp(pe - half - pw) if depth > TOP else np.ones_like(pe)
    seen = counts.sum(1)[:, None] > 0
    mixed, left = share0 * own0, 1 - share0
    out = np.zeros((3, 256, 256))
    out[0, :, 1:] = mixed + left * np.where(seen, share * own, _rest(own0))
    out[1, :, 1:] = np.where(seen, left * (1 - share), 0.0)
    out[2, :, 1:] = _rest(own)
    return out.reshape(3, -1)


def gram_logs(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The rows of ``grams`` (``code, n`` and others, codes distinct) with ``log10``, the log10 probability of a gram's byte
    after its context in the tree of every context that is followed by something in the counts ``n``.

    Grams with ``n`` = 0 are not in the tree and only get a probability. All contexts with the same last ``TOP`` + 1
    bytes are weighted by one task, which holds them at a time; what lies above is a table of fixed size on the
    driver. So neither the driver nor a broadcast grows with the number of contexts.
    """
    ending, columns = min(depth, TOP + 1), grams.columns
    parts = grams.withColumn("ending", F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * ending) - 1)))
    parts = parts.repartition("ending").sortWithinPartitions("ending").select(*columns)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, _Part]]:
        """Parts of the input with all grams of their endings, the order that sorts them, and their trees."""
        held, size, limit = [], 0, WEIGHED

        def tree(rows: pa.Table) -> tuple[pa.Table, np.ndarray, _Part]:
            keys = _ordered(rows.column("code").to_numpy().astype(np.uint64), depth)
            order = np.argsort(keys)
            return rows, order, _Part(keys[order], rows.column("n").to_numpy().astype(float)[order], depth)
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= limit:
                rows = pa.Table.from_batches(held)
                ends = rows.column("code").to_numpy() >> 8 & (1 << 8 * ending) - 1
                cut = int(np.searchsorted(ends, ends[-1]))
                if cut:
                    yield tree(rows.slice(0, cut))
                held, size = rows.slice(cut).to_batches(), size - cut
                limit = max(WEIGHED, 2 * size)
        if size:
            yield tree(pa.Table.from_batches(held))

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, part in whole(batches):
            yield part.sums()

    top = grams.sparkSession.sparkContext.broadcast(_top(summed(parts, weighted, float), depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, order, part in whole(batches):
            log10 = np.empty(len(order), np.float32)
            log10[order] = part.log10(top.value)
            yield from rows.append_column("log10", pa.array(log10)).combine_chunks().to_batches(max_chunksize=1 << 16)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.schema.fields)
    return parts.mapInArrow(run, f"{fields}, log10 float")


@dataclass(frozen=True)
class Head:
    """Codes of common grams and the log10 probabilities of their bytes, in a table with a free place for each code at
    least. A code stands at the place its hash names, or after it behind others."""
    codes: np.ndarray
    log10: np.ndarray
    depth: int

    @classmethod
    def of(cls, codes: np.ndarray, log10: np.ndarray, depth: int) -> Head:
        size = 1 << max(1, 2 * len(codes) - 1).bit_length()
        out = cls(np.full(size, NO_GRAM), np.zeros(size, np.float32), depth)
        left = np.arange(len(codes))
        place = out._places(codes)
        while len(left):
            free = left[out.codes[place[left]] == NO_GRAM]
            out.codes[place[free]] = codes[free]
            # of several that met, one stands there now
            stands = out.codes[place[left]] == codes[left]
            out.log10[place[left[stands]]] = log10[left[stands]]
            left = left[~stands]
            place[left] = (place[left] + 1) & (size - 1)
        return out

    def _places(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - len(self.codes).bit_length())).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log10 probability of each code, zero if it is not here, and which are not."""
        place = self._places(codes)
        at, p = self.codes[place], self.log10[place]
        left = np.flatnonzero(at != codes)
        p[left] = 0
        missing = [left[at[left] == NO_GRAM]]
        left = left[at[left] != NO_GRAM]
        while len(left):
            place[left] = (place[left] + 1) & (len(self.codes) - 1)
            at = self.codes[place[left]]
            here = at == codes[left]
            p[left[here]] = self.log10[place[left[here]]]
            missing.append(left[at == NO_GRAM])
            left = left[~here & (at != NO_GRAM)]
        return p, np.concatenate(missing)

    def score(self, texts: list[str]) -> np.ndarray:
        """log10 probability of what each text has of these grams."""
        out = np.zeros(len(texts))
        for buffer, places in segments(texts, self.depth):
            p, _ = self.find(gram_codes(buffer, places, self.depth))
            edges = np.cumsum([0] + [b - a for _, a, b in places])
            np.add.at(out, [r for r, _, _ in places], np.add.reduceat(p, edges[:-1], dtype=np.float64))
        return out

    def others(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, codes and counts of all other grams of the texts, each row and code once for a buffer."""
        for buffer, places in segments(texts, self.depth):
            found = gram_codes(buffer, places, self.depth)
            missing = np.sort(self.find(found)[1])
            codes, at = np.unique(found[missing], return_inverse=True)
            rows = np.repeat([r for r, _, _ in places], [b - a for _, a, b in places])[missing]
            pairs, n = np.unique(rows.astype(np.int64) * max(1, len(codes)) + at, return_counts=True)
            yield pairs // max(1, len(codes)), codes[pairs % max(1, len(codes))], n


def split_grams(logs: DataFrame, depth: int = DEPTH, most: int | None = None) -> tuple[Head, DataFrame | None]:
    """At most ``most`` of the commonest grams of ``logs`` (``code, n, others, log10``), and a frame of the others if there are any.

    Grams are taken by classes of their count in all rows. Which are in the head decides only how a probability travels.
    """
    most = HEAD_GRAMS if most is None else most
    ranked = logs.withColumn("rank", F.floor(F.log2(F.col("n") + F.col("others")) * 8))
    last, taken = math.inf, 0
    classes = sorted(ranked.groupBy("rank").count().collect(), reverse=True)
    for rank, size in classes:
        if taken + size > most:
            break
        last, taken = rank, taken + size
    if taken:
        got = ranked.where(F.col("rank") >= last).select("code", "log10").toArrow()
        head = Head.of(got.column("code").to_numpy().astype(np.uint64), got.column("log10").to_numpy(), depth)
    else:
        head = Head.of(np.zeros(0, np.uint64), np.zeros(0, np.float32), depth)
    rest = ranked.where(F.col("rank") < last) if taken else ranked
    return head, rest.select("code", "log10") if taken < sum(size for _, size in classes) else None


def other_grams(docs: DataFrame, head: Broadcast) -> DataFrame:
    """``k1, k2, code, n`` for the grams of each row (``k1, k2, t``) that are not in the head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, codes, n in head.value.others(b.column("t").to_pylist()):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("k1", "k2")), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["k1", "k2", "code", "n"])
    return docs.select("k1", "k2", "t").mapInArrow(run, "k1 long, k2 long, code long, n long")


@dataclass(frozen=True)
class Whole:
    """The tree of all contexts by its grams: the common ones, and ``code, log10`` of the others if there are any."""
    head: Head
    rest: DataFrame | None


def tree_of(grams: DataFrame, depth: int = DEPTH, nodes: int | None = None) -> Tree | Whole:
    """The tree from summed grams (``code, n``; for the whole tree also ``others``, their counts in rows that are only scored).

    It holds every context, unless a number of ``nodes`` is given: then contexts that make up less than one part in
    ``nodes`` of the training bytes stay in the grams' sums and count for their parents, and what reaches the driver
    are the counts of kept contexts, at most ``nodes`` contexts of each depth with at most 256 bytes each.
    """
    if nodes is None:
        return Whole(*split_grams(cut_lineage(gram_logs(grams, depth)), depth))
    total = grams.agg(F.sum("n").alias("n")).first()["n"] or 0
    limit = max(1, -(-total // nodes))
    levels = [(np.zeros(1, np.uint64), np.zeros((1, 256)))]
    for d in range(depth + 1):
        pairs = grams.select(F.col("code").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
        pairs = pairs.withColumn("context", F.shiftright("pair", 8))
        if d:
            kept = pairs.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= limit).select("context")
            pairs = pairs.join(kept, "context")
        got = pairs.select("context", F.col("pair").bitwiseAND(F.lit(255)).alias("byte"), "n").toPandas()
        codes, at = np.unique(got["context"].to_numpy(np.uint64), return_inverse=True)
        counts = np.zeros((len(codes), 256))
        counts[at, got["byte"].to_numpy(int)] = got["n"].to_numpy()
        if d == 0:
            levels[0] = (np.zeros(1, np.uint64), counts if len(counts) else np.zeros((1, 256)))
        elif len(codes):
            levels.append((codes, counts))
        else:
            break
    return build_tree(levels)


def frequent_words(docs: DataFrame, id_col: str, text_col: str, words: int = HEAD_WORDS) -> frozenset[bytes]:
    """Common words, found in every ``HEAD_SHARE``-th document by hash. Their counts are taken from all documents;
    which words are in the set decides only how a word's count travels, never its value."""
    some = docs.where(F.pmod(F.xxhash64(id_col), F.lit(HEAD_SHARE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter()
            for t in b.column(0).to_pylist():
                seen.update(plain(t)[:-1].split(b" "))
            seen.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = some.select(text_of(text_col).alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return frozenset(bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(words).collect())


def tail_words(docs: DataFrame, head: frozenset[bytes]) -> DataFrame:
    """``word, k1, k2, n, train`` for the words of each row (``k1, k2, train, t``) that are not head words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, rows, counts = [], [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                seen = Counter([w for w in plain(t)[:-1].split(b" ") if w not in head])
                seen.pop(b"", None)
                words += seen.keys()
                counts += seen.values()
                rows += [i] * len(seen)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(b.column(c).take(at) for c in ("k1", "k2")), pa.array(counts, pa.int64()), b.column("train").take(at)],
                                             names=["word", "k1", "k2", "n", "train"])
    return docs.mapInArrow(run, "word binary, k1 long, k2 long, n long, train boolean")


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", *, depth: int = DEPTH, nodes: int | None = None) -> DataFrame:
    """One row per input row: ``id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``.

    Learns from the rows where ``train`` holds and scores all rows. ``score`` is the tree's log10 probability of the
    text's words joined by one space and an end mark; the tree holds every context of the training rows, unless ``nodes``
    bounds it (``tree_of``). ``base_score`` is the unigram score with one added to each count.

    The probability of a byte depends on it and the ``depth`` bytes before it alone, so it is found once for each
    distinct gram of all rows. Common grams (a bounded set) are looked up while scoring; if there are others, they are
    joined to their probabilities by a shuffle on the gram.

    Counts cover all training rows. Common words (a bounded set) are counted by the gram pass and looked up while
    scoring; all other words are joined to their counts by a shuffle on the word. Null texts count as empty and hold
    the end only. Rows repeated with the same id and text get the same scores. Without training rows the tree
    predicts every bit with one half and nothing is known. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    rows = rows.select("*", F.xxhash64("id").alias("k1"), F.xxhash64("t", F.col("id").isNull()).alias("k2"))
    learn = rows.where("train")
    head = frequent_words(learn, "id", "t")
    counted = cut_lineage(count_grams(rows, head, depth, "t", F.col("train")))
    words = {bytes(r["word"]): r["n"] for r in counted.where("word is not null").collect()}
    model = tree_of(counted.where("code is not null").drop("word"), depth, nodes)
    head_tree, rare = (model.head, model.rest) if isinstance(model, Whole) else (model, None)
    tree = spark.sparkContext.broadcast(head_tree)
    # head words that no training row holds do not exist: the set was found there
    head_logs = spark.sparkContext.broadcast({w: math.log10(n + 1) for w, n in words.items()})

    of_word = Window.partitionBy("word")
    tail = tail_words(rows.select("k1", "k2", "train", "t"), head).withColumn("pair", F.monotonically_increasing_id())
    tail = tail.select("k1", "k2", "n", F.sum(F.when(F.col("train"), F.col("n")).otherwise(0)).over(of_word).alias("c"), (F.col("pair") == F.min("pair").over(of_word)).alias("first"))
    tail = cut_lineage(tail.groupBy("k1", "k2").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.when(F.col("first") & (F.col("c") > 0), 1).otherwise(0)).alias("new_words")))
    new_words = tail.agg(F.sum("new_words").alias("v")).first()["v"] or 0
    tail = tail.select("k1", "k2", "tail_log", "tail_known", F.lit(0.0).alias("tail_score"))
    if rare is not None:
        found = other_grams(rows, tree).join(rare, "code").groupBy("k1", "k2").agg(F.sum(F.col("n") * F.col("log10")).alias("tail_score"))
        both = tail.unionByName(found.select("k1", "k2", F.lit(0.0).alias("tail_log"), F.lit(0).cast("long").alias("tail_known"), "tail_score"))
        tail = cut_lineage(both.groupBy("k1", "k2").agg(*(F.sum(c).alias(c) for c in ("tail_log", "tail_known", "tail_score"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = head_logs.value
        for b in batches:
            texts = b.column("t").to_pylist()
            n, known, log, size = [], [], [], []
            for t in texts:
                p = plain(t)
                w = p[:-1].split(b" ") if len(p) > 1 else []
                hits = [logs[x] for x in w if x in logs]
                n.append(len(w)), known.append(len(hits)), log.append(math.fsum(hits)), size.append(len(p))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "train", "k1", "k2")), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(log, pa.float64()),
                                              pa.array(size, pa.int64()), pa.array(tree.value.score(texts), pa.float64())],
                                             names=["id", "train", "k1", "k2", "words", "head_known", "head_log", "n_bytes", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = cut_lineage(rows.select("id", "train", "k1", "k2", "t").mapInArrow(
        run, f"id {kind}, train boolean, k1 long, k2 long, words long, head_known long, head_log double, n_bytes long, score double"))
    copies = scored.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    sums = scored.where("train").agg(F.sum(F.col("words") + 1).alias("n"), F.count("*").alias("ends")).first()
    tokens, ends = sums["n"] or 0, sums["ends"]
    vocabulary = len(words) + new_words + (ends > 0)
    tail = tail.join(copies, ["k1", "k2"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    each = [(F.col(c) / F.col("copies")).alias(c) for c in ("tail_log", "tail_score")]
    tail = cut_lineage(tail.select("k1", "k2", *each, F.call_function("div", "tail_known", "copies").alias("tail_known")))
    out = scored.join(tail, ["k1", "k2"], "left").withColumns({"n_tokens": F.col("words") + 1, "score": F.col("score") + F.coalesce("tail_score", F.lit(0.0))})
    zero = F.lit(0)
    log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + F.lit(math.log10(ends + 1))
    return out.select(
        F.col("id").alias(id_col), "train", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", zero) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (log - F.col("n_tokens") * F.lit(math.log10(tokens + vocabulary + 1))).alias("base_score"),
        "score", "n_bytes", (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
