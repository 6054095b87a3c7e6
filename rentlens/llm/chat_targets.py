"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed marks of the template. Escaped texts hold none of "<", "[" and "|", so no mark and no control string of
#: a chat template can come from a text.
OPEN, NAMED, CLOSE = "<|", "|>\n", "</s>\n"
ESCAPES = (("\\", "\\bs;"), ("<", "\\lt;"), ("[", "\\lb;"), ("|", "\\vb;"))
TARGET_ROLE = "assistant"


def escape(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def plain(text: str) -> str:
    """The text that ``escape`` wrote."""
    for plain_, safe in reversed(ESCAPES):
        text = text.replace(safe, plain_)
    return text


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv, turn, block, block_start, block_chars, example, loss_start, loss_chars``.

    ``block`` is the formatted turn. A conversation's transcript is its blocks in order, and every assistant turn
    is an example of its own: the transcript from 0 up to the end of its block, trainable only in
    ``[loss_start, loss_start + loss_chars)``, which is the reply without its marks. ``example`` numbers them from
    0 and is null for other turns, as are the two loss columns. ``written`` and ``render`` write the examples out
    from these spans.

    Null texts and roles count as empty. Turns with equal numbers are ordered by role and text, a null number
    comes first; rows without a conversation id form one conversation. Repeated rows are repeated turns. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    safe = rows.withColumns({"head": F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(NAMED)), "body": escape(F.col("text"))})
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    blocks = safe.select("conv", "turn", "role", "text", F.length("head").alias("h"), F.length("body").alias("b"),
                         F.concat("head", "body", F.lit(CLOSE)).alias("block"))
    is_target = F.col("role") == TARGET_ROLE
    n = F.col("h") + F.col("b") + len(CLOSE)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.withColumns({"end": F.sum(n).over(running), "position": F.row_number().over(order) - 1,
                                 "targets": F.sum(is_target.cast("long")).over(running)})
    start = F.col("end") - n
    return placed.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "position", "block", start.alias("block_start"),
        n.cast("long").alias("block_chars"), F.when(is_target, F.col("targets") - 1).alias("example"),
        F.when(is_target, start + F.col("h")).alias("loss_start"), F.when(is_target, F.col("b").cast("long")).alias("loss_chars"))


def render(expanded: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The examples written out: ``conv, example, text, loss_start, loss_chars``.

    Every example repeats its whole context, so this grows with the square of a conversation's turns.
    """
    kind = expanded.schema[conv_col].dataType.simpleString()
    return written(expanded, conv_col).where("example is not null").select(
        F.col("key").cast(kind).alias(conv_col), "example", "text", "loss_start", "loss_chars")


#: Characters of written examples that a task holds before it passes them on, if not one example alone is longer.
HELD = 1 << 22


def written(expanded: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The examples of ``render`` under the id as text (``key``), those of a conversation in order and side by side; turns
    after its last reply follow as its whole transcript with neither ``example`` nor mask.

    Blocks come sorted and the transcript grows as they pass; a task holds one transcript and ``HELD`` characters.
    """
    names = ["key", "example", "text", "loss_start", "loss_chars"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, rest, out, held = None, [], False, [], 0
        for b in batches:
            for key, block, *mask in zip(*(b.column(c).to_pylist() for c in ("key", "block", "example", "loss_start", "loss_chars"))):
                if parts and key != at:
                    if rest:
                        out.append((at, None, "".join(parts), None, None))
                    parts = []
                at, rest = key, mask[0] is None
                parts.append(block)
                if not rest:
                    parts = ["".join(parts)]
                    out.append((key, mask[0], parts[0], *mask[1:]))
                    held += len(parts[0])
                    if held > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out, held = [], 0
        if parts and rest:
            out.append((at, None, "".join(parts), None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    # the id travels as text, so that a null among numbers changes none of them
    blocks = expanded.select(F.col(conv_col).cast("string").alias("key"), "position", "block", "example", "loss_start", "loss_chars")
    return blocks.repartition("key").sortWithinPartitions("key", "position").mapInArrow(run, "key string, example long, text string, loss_start long, loss_chars long")


#: A turn of a transcript. Escaped roles and texts hold none of the marks' first characters.
TURN = re.compile(r"<\|([^|<\[]*)\|>\n([^|<\[]*)</s>\n")


def read_turns(transcript: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, unescaped."""
    end = 0
    while end < len(transcript):
        turn = TURN.match(transcript, end)
        if turn is None:
            raise ValueError(f"no turn at character {end}")
        end = turn.end()
        yield plain(turn[1]), plain(turn[2])


def digest(expanded: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its written examples: its turns, digests of all turns and of the text under the mask.

    The mask of every example is cut out of its own text; the turns are those of the last, which holds all of them.
    ``formatted_chars`` is the length of the transcript, ``examples_chars`` that of all examples. Examples come in order
    and are hashed as they pass.
    """
    kind = expanded.schema[conv_col].dataType.simpleString()
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "examples_chars"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    class Sums:
        def __init__(self, key):
            self.key, self.loss, self.last = key, hashlib.sha256(), ""
            self.loss_chars = self.examples = self.examples_chars = 0

        def add(self, example, text, start, chars):
            self.last = text
            if example is not None:
                target = plain(text[start:start + chars])
                self.loss.update(target.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(target)
                self.examples += 1
                self.examples_chars += len(text)

        def row(self):
            n, turns = 0, hashlib.sha256()
            for role, text in read_turns(self.last):
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            return (self.key, n, turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), len(self.last), self.examples, self.examples_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            done = []
            for key, *example in zip(*(b.column(c).to_pylist() for c in ("key", "example", "text", "loss_start", "loss_chars"))):
                if sums is None or key != sums.key:
                    if sums is not None:
                        done.append(sums.row())
                    sums = Sums(key)
                sums.add(*example)
            yield from _batch(done)
        if sums is not None:
            yield from _batch([sums.row()])

    def _batch(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), types)], names=names)

    out = written(expanded, conv_col).mapInArrow(
        run, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, examples_chars long")
    return out.select(F.col("key").cast(kind).alias(conv_col), *names[1:])
