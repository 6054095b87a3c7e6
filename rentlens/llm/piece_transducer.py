"""SentencePiece encoding and decoding as a shortest path through a weighted finite-state transducer."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.shared import text_of

SPACE = "▁"
#: Texts between two cuts that a Python worker remembers, and pairs of pieces.
CACHE_CHUNKS, CACHE_PAIRS = 500_000, 500_000
FAR = float("inf")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        elif key & 7 == 2:
            size, at = _varint(raw, at)
            value, at = raw[at:at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = raw[at:at + size], at + size
        yield key >> 3, value


class PieceTransducer:
    """The composition normaliser . pieces . byte fallback, searched for its cheapest path.

    States are positions in the normalised text together with the last piece; an arc reads the characters of a piece
    (or one character outside the vocabulary, writing its bytes) and writes its id. For a BPE model an arc has a
    finite weight only if the last piece and the new one, joined, would be merged back into just these two: a
    sequence whose neighbours all agree in this way is what the merges give, and the only such one, so the shortest
    path is the BPE encoding itself. For a unigram model every arc is open and weighs minus the piece's score.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec = {"trainer": {}, "normalizer": {}}
        for number, value in _fields(raw):
            if number in (2, 3):
                spec["trainer" if number == 2 else "normalizer"] = dict(_fields(value))
        self.is_bpe = spec["trainer"].get(3, 1) == 2
        self.dummy_prefix, self.squeeze, self.escape = (bool(spec["normalizer"].get(i, 1)) for i in (3, 4, 5))
        if spec["normalizer"].get(2, b"") or not self.escape:
            raise ValueError("only identity normalisers with escaped white space are compiled here")
        ids = range(model.get_piece_size())
        self.piece = [model.id_to_piece(i) for i in ids]
        self.cost = [-model.get_score(i) for i in ids]
        self.unknown = model.unk_id()
        self.byte = {int(self.piece[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.plain = {self.piece[i]: i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.letters = {p for p in self.plain if len(p) == 1}
        # pieces with spaces at their start only (or all spaces) make every path cut before a run of spaces, and a line
        # end outside the vocabulary is a cut itself
        self.cuts = all(SPACE not in p.lstrip(SPACE) for p in self.plain)
        line = "" if any("\n" in p for p in self.plain) else "\n"
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+|{line or '$'}").findall
        self.bytes_of = [bytes([int(self.piece[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else
                         " ⁇ ".encode() if i == self.unknown else self.piece[i].replace(SPACE, " ").encode() for i in ids]
        self.longest = max(map(len, self.plain))
        #: by ``first * number of pieces + second``
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, list[tuple[float, str, str]]] = {}
        self.known: dict[str, bytes] = {"": b""}
        if self.is_bpe:
            self.plain = {p: i for p, i in self.plain.items() if len(p) == 1 or self._history(i)[-1][1] == p}
        self.size = [len(p) for p in self.piece]
        # arcs by first letters: prefixes of pieces, with the id where a piece ends and -1 elsewhere
        self.trie: dict[str, int] = {}
        for p, i in self.plain.items():
            for k in range(1, len(p)):
                self.trie.setdefault(p[:k], -1)
            self.trie[p] = i
        # for each piece the longest shorter one that it starts with
        self.shorter = [-1] * len(self.piece)
        for p, i in self.plain.items():
            self.shorter[i] = next((self.trie[p[:k]] for k in range(len(p) - 1, 0, -1) if self.trie[p[:k]] >= 0), -1)

    def history(self, text: str) -> list[tuple[float, str, str]]:
        """The merges of a short text in order, the best-scored neighbours first and the left ones if equal: what
        each costs and the first and last part before it, and the parts at the end at an infinite cost."""
        parts, rank, out = list(text), self.plain, []
        while True:
            best = min(((self.cost[rank[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
            out.append((best[0] if best else FAR, parts[0], parts[-1]))
            if best is None:
                return out
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def agree(self, a: int, b: int) -> bool:
        """Whether the merges keep these two neighbours apart as they are.

        Each piece is merged as if alone until a merge across the seam is the next best one.
        """
        left, right = self._history(a), self._history(b)
        i = j = 0
        while True:
            (mine, _, last), (other, first, _) = left[i], right[j]
            seam = self.plain.get(last + first)
            if seam is not None and self.cost[seam] < mine and self.cost[seam] <= other:
                known = False
                break
            if mine == other == FAR:
                known = True
                break
            if mine <= other:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a * len(self.piece) + b] = known
        return known

    def _history(self, i: int) -> list[tuple[float, str, str]]:
        if i not in self.histories:
            self.histories[i] = self.history(self.piece[i])
        return self.histories[i]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def _longest(self, text: str, i: int) -> int:
        """The longest piece that the text holds at ``i``; ``shorter`` leads to the others."""
        out, get = -1, self.trie.get
        for j in range(i + 1, min(len(text), i + self.longest) + 1):
            p = get(text[i:j])
            if p is None:
                break
            if p >= 0:
                out = p
        return out

    def _only_path(self, text: str) -> list[int]:
        """The path of finite weight over a stretch of letters of the vocabulary, of a BPE model.

        There is one, and one to each position on the way, so the search goes forward by the longest open arc and
        leaves a position without any for good: no position is entered twice.
        """
        n, size, pairs, count, shorter = len(text), self.size, self.pairs, len(self.piece), self.shorter
        path, dead = [], set()
        i, before, p = 0, -1, self._longest(text, 0)
        while True:
            while p >= 0:
                j = i + size[p]
                if j not in dead:
                    open_arc = before < 0 or pairs.get(before * count + p)
                    if self.agree(before, p) if open_arc is None else open_arc:
                        break
                p = shorter[p]
            else:
                dead.add(i)
                p = path.pop()
                i -= size[p]
                before = path[-1] if path else -1
                p = shorter[p]
                continue
            path.append(p)
            if j == n:
                return path
            i, before, p = j, p, self._longest(text, j)

    def _cheapest_path(self, text: str) -> list[int]:
        """Shortest path over a stretch of letters of the vocabulary, of a unigram model: every position keeps its
        cheapest last piece."""
        n = len(text)
        last, cost = [-1] * (n + 1), [FAR] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            if cost[i] == FAR:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                p = self.trie.get(text[i:j])
                if p is None:
                    break
                if p >= 0 and cost[i] + self.cost[p] < cost[j]:
                    cost[j], last[j] = cost[i] + self.cost[p], p
        out, i = [], n
        while i > 0:
            out.append(last[i])
            i -= len(self.piece[last[i]])
        return out[::-1]

    def _between(self, text: str) -> list[int]:
        return self._only_path(text) if self.is_bpe else self._cheapest_path(text)

    def path(self, text: str) -> list[int]:
        """Ids of a normalised text. Characters outside the vocabulary become bytes (or the unknown id), and nothing
        reaches across them."""
        if text and self.letters.issuperset(text):
            return self._between(text)
        out, start = [], 0
        for i, c in enumerate(text):
            if c not in self.letters:
                out += self._between(text[start:i]) if start < i else []
                out += [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]
                start = i + 1
        return out + (self._between(text[start:]) if start < len(text) else [])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers. Every path passes the cuts, so stretches between them are
        searched one by one, and each once while it is remembered."""
        normal = self.normalise(text)
        chunks = self.chunks(normal) if self.cuts else [normal]
        try:
            return b"".join([self.known[c] for c in chunks])
        except KeyError:
            pass
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
            self.known[""] = b""
        for c in set(chunks).difference(self.known):
            ids = self.path(c)
            self.known[c] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([self.known[c] for c in chunks])

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; broken UTF-8 becomes the replacement character."""
        raw = b"".join([self.bytes_of[i] for i in ids.tolist()])
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_LOADED: dict[str, PieceTransducer] = {}


def transducer(path: str) -> PieceTransducer:
    """The compiled transducer of a model file, once for each worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceTransducer(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, with_ids: bool = True) -> DataFrame:
    """One row per input row: ``id, n_ids, n_bytes_ids, ids_sha256, round_trip`` (and ``ids``, little-endian bytes).

    ``n_bytes_ids`` counts the ids of the byte fallback; ``round_trip`` tells whether the decoded ids are the text.
    Null texts count as empty and have no ids. Repeated rows give repeated results; an empty table an empty one;
    other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        is_byte = np.zeros(len(t.piece), bool)
        is_byte[list(t.byte.values())] = True
        for b in batches:
            n, fallback, digests, same, raw = [], [], [], [], []
            for text in b.column("t").to_pylist():
                ids = t.encode(text)
                numbers = np.frombuffer(ids, "<u4")
                n.append(len(numbers)), fallback.append(int(is_byte[numbers].sum())), digests.append(hashlib.sha256(ids).hexdigest())
                same.append(t.decode(numbers) == text)
                if with_ids:
                    raw.append(ids)
            columns = [pa.array(n, pa.int64()), pa.array(fallback, pa.int64()), pa.array(digests), pa.array(same, pa.bool_()), *([pa.array(raw, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *columns], names=[id_col, "n_ids", "n_bytes_ids", "ids_sha256", "round_trip", *(["ids"] if with_ids else [])])

    schema = f"{id_col} {kind}, n_ids long, n_bytes_ids long, ids_sha256 string, round_trip boolean" + (", ids binary" if with_ids else "")
    return docs.select(id_col, text_of(text_col).alias("t")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """``id, text`` from the ids."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for b in batches:
            texts = [t.decode(np.frombuffer(x or b"", "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(texts, pa.string())], names=[id_col, "text"])
    return encoded.select(id_col, F.col("ids")).mapInArrow(run, f"{id_col} {kind}, text string")
