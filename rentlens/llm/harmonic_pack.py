"""Harmonic packing: pieces of reciprocal-capacity classes fill bins of a fixed count."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.shared import text_of
from rentlens.session import cut_lineage

CAPACITY, END_ID = 4096, 2
#: Pieces up to this many tokens are not cut further; a bin of them pads less than this many tokens.
SMALL = 63
#: A remainder that fills its share of a bin up to this part of the capacity is not cut.
SLACK = 1 / 64
#: Tokens of a packing worker, and how many workers' leftovers meet in the next round.
WORKER_TOKENS, FAN_IN = 1 << 22, 16
#: Pretokens and words whose ids a Python worker remembers.
CACHE_WORDS = 600_000
LAST_LEVEL = 62

#: Fixed value: the tokenizer's own split, for lower-case text of the first 256 characters. What it skips is white space.
_PRETOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa00-9²³¹¼½¾a-zªµºß-öø-ÿ]+").findall
_WHITE = re.compile("[ \t\n\x0b\x0c\r]+").split


class _Pretokens(dict):
    """The ids of each pretoken met, as little-endian unsigned 32-bit numbers; found by the BPE model when missing."""

    def __init__(self, tokenize: Callable[[str], list], letters: dict[int, str]) -> None:
        super().__init__()
        self.tokenize, self.letters = tokenize, letters

    def __missing__(self, p: str) -> bytes:
        plain = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters)
        ids = self[p] = array("I", [t.id for t in self.tokenize(plain)]).tobytes()
        return ids


_KNOWN: dict[str, tuple[_Pretokens, dict[str, bytes]]] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across a pretoken's edge, so each pretoken is encoded once while
    it is remembered. Texts of the first 256 characters are already composed and are split here; others, and those
    that may hold a special token, go word by word through the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    if path not in _KNOWN:
        _KNOWN[path] = _Pretokens(tokenizer.model.tokenize, _byte_letters()), {}
    pretokens, words = _KNOWN[path]

    def word(w: str) -> bytes:
        ids = words.get(w)
        if ids is None:
            ids = words[w] = b"".join(map(pretokens.__getitem__, _PRETOKENS(w.lower()))) if _simple(w) else np.array(
                tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return ids

    def encode(text: str) -> bytes:
        if len(pretokens) + len(words) > CACHE_WORDS:
            pretokens.clear()
            words.clear()
        if _simple(text):
            return b"".join(map(pretokens.__getitem__, _PRETOKENS(text.lower())))
        return b"".join(map(word, _WHITE(text)))

    return encode


def _simple(text: str) -> bool:
    """Whether a text has the first 256 characters only, and no special token."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return "<|" not in text


def cuts(n: int, capacity: int = CAPACITY, small: int = SMALL, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens.

    Whole sequences first. A remainder r belongs to class k = capacity // r, whose bins take k pieces. Where k
    pieces of its length would leave a bin too empty, exactly capacity // (k + 1) tokens are cut off, a full
    share of the next class, and what is left goes on. Shares of full size leave almost nothing to pad, and
    what is left shrinks like the terms of a greedy sum of unit fractions, so there are only a few pieces.
    """
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r > small and (capacity // r) * r < capacity * (1 - slack):
        share = capacity // (capacity // r + 1)
        out.append(share)
        r -= share
    return out + [r] * (r > 0)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *,
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens`` (and ``ids``, little-endian bytes) of every piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        for b in batches:
            rows, starts, lengths, crcs, totals, parts = [], [], [], [], [], []
            for i, text in enumerate(b.column("t").to_pylist()):
                ids = memoryview(encode(text) + end)
                total, start = len(ids) // 4, 0
                for length in cuts(total, capacity):
                    part = ids[4 * start:4 * (start + length)]
                    for column, value in zip((rows, starts, lengths, crcs, totals), (i, start, length, zlib.crc32(part), total)):
                        column.append(value)
                    if with_ids:
                        parts.append(part.tobytes())
                    start += length
            numbers = [pa.array(c, pa.int64()) for c in (starts, lengths, crcs, totals)]
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(rows, pa.int64())), *numbers, *([pa.array(parts, pa.binary())] if with_ids else [])],
                                             names=[id_col, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return docs.select(id_col, text_of(text_col).alias("t")).mapInArrow(run, schema)


def _first_fit(capacity: int, keep: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", *keep[:1], "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        free, seq, offset = np.full(len(b) + 1, capacity), np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        opened = 0
        for i, n in enumerate(b["length"].to_numpy()):
            at = int(np.argmax(free[:opened + 1] >= n))
            opened = max(opened, at + 1)
            seq[i], offset[i] = at, capacity - free[at]
            free[at] -= n
        return b[keep].assign(sequence_id=seq + (LAST_LEVEL << 57), offset=offset)
    return run


def harmonic_pack(cut: DataFrame, id_col: str = "doc_id", *, capacity: int = CAPACITY, worker_tokens: int = WORKER_TOKENS) -> DataFrame:
    """The pieces (at most ``capacity`` tokens each) with ``sequence_id`` and ``offset``.

    Pieces are dealt over workers by hash. Within a worker and class k, every k pieces in order fill a sequence;
    the k - 1 or fewer left over go on, those of ``FAN_IN`` workers together, until one worker is left. What the
    last one keeps is less than one sequence for each of about ``2 * sqrt(capacity)`` classes, so it is bounded,
    and goes into sequences by first fit decreasing. All but that bounded rest is placed by windows over one
    worker's pieces. Ids are built from the round, worker, class and bin, so that a repeated task gives the same.

    Pieces of length 0 do not exist (every document ends with an id); repeated documents give repeated pieces,
    each placed once. An empty table gives an empty result.
    """
    keep = cut.columns
    total = cut.agg(F.sum("length").alias("n")).first()["n"] or 0
    workers = max(1, -(-total // worker_tokens))
    k = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    rest = cut.withColumn("worker", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(workers)))
    placed, level = [], 0
    while True:
        group = Window.partitionBy("worker", "k")
        order = group.orderBy(id_col, "start", "ids_crc32")
        ranked = rest.withColumn("k", k).withColumns({"r": F.row_number().over(order) - 1, "n": F.count("*").over(group)})
        ranked = ranked.withColumns({"full": F.col("r") < F.col("n") - F.col("n") % F.col("k"), "bin": F.call_function("div", F.col("r"), F.col("k"))})
        stored = cut_lineage(ranked)
        before = Window.partitionBy("worker", "k", "bin").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        seq = F.shiftleft(F.lit(level).cast("long"), 57) + F.shiftleft(F.col("worker"), 33) + F.shiftleft(F.col("k"), 20) + F.col("bin")
        placed.append(stored.where("full").withColumns({"sequence_id": seq, "offset": F.coalesce(F.sum("length").over(before), F.lit(0))}).select(*keep, "sequence_id", "offset"))
        rest = stored.where("not full").select(*keep, "worker")
        if workers == 1:
            break
        workers = -(-workers // FAN_IN)
        rest = rest.withColumn("worker", F.pmod("worker", F.lit(workers)))
        level += 1
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    placed.append(rest.groupBy("worker").applyInPandas(_first_fit(capacity, keep), f"{fields}, sequence_id long, offset long"))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY,
                   end_id: int = END_ID, with_ids: bool = False, worker_tokens: int = WORKER_TOKENS) -> DataFrame:
    """All documents cut and packed: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    A sequence is padded to ``capacity`` unless its length is a power of two. Null texts count as empty and give
    the end id alone; long texts are cut; other columns are ignored.
    """
    cut = cut_lineage(pieces(docs, tokenizer_path, id_col, text_col, capacity=capacity, end_id=end_id, with_ids=with_ids))
    return harmonic_pack(cut, id_col, capacity=capacity, worker_tokens=worker_tokens)
