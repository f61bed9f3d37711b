r"""Chat formatting in budgeted windows.

A conversation's turns are numbered in order and dealt into segments of `segment` turns, so a conversation of any
length is formatted by many tasks. In a segment, prefix sums of turn tokens choose spans of whole turns that fit the
budget; each window begins with the conversation's system turn, repeats a limited number of turns of history, and then
has its own turns. Loss spans cover the texts of its own assistant turns; repeated ones are masked. A turn longer than
the budget has a window of its own.

A turn is `<|im_start|>role\ntext<|im_end|>\n`. Inside texts and roles one backslash is put into every `<` `\`* `|`, and
in roles backslashes and line ends are escaped, so control strings can't be forged and reading back is exact.

Null text or role: empty. Rows with equal turn numbers are ordered by role and text; null turn numbers come first. A
null conv_id is a conversation. A text of any length is one turn, whole, in a window of its own if it exceeds the
budget. Columns besides conv_id, turn, role and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerlake.llm.bpe import loaded
from ledgerlake.llm.shared import SLICE_BYTES

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
WINDOWS = "conv_id long, segment long, first long, text string, turns array<long>, loss array<struct<start:long,stop:long>>, tokens long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and where its escaped text begins and ends in it."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def spans(tokens: list[int], fixed: int, budget: int, history: int, own: int) -> list[tuple[int, int, int]]:
    """(from, first, stop) of each window over turns of these lengths: history begins at `from`, own turns at `first`.

    own: the first turn that is this segment's. History takes at most a quarter of the budget.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    out, first = [], own
    while first < len(tokens):
        begin = first
        while begin > 0 and first - begin < history and sums[first] - sums[begin - 1] <= budget // 4:
            begin -= 1
        while begin < first and fixed + sums[first + 1] - sums[begin] > budget:
            begin += 1
        stop = max(first + 1, int(np.searchsorted(sums, sums[begin] + budget - fixed, side="right")) - 1)
        out.append((begin, first, stop))
        first = stop
    return out


def numbered(rows: DataFrame, segment: int, history: int) -> DataFrame:
    """Turns with their number and segment; a segment also gets the turns before it and the system turn."""
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    at = plain.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    first = F.first(F.struct("role", "text")).over(order.rowsBetween(W.unboundedPreceding, 0))
    at = at.withColumn("_first", F.when(F.col("idx") % segment == 0, first))
    at = at.withColumn("segment", F.floor(F.col("idx") / segment))
    also = F.when(F.col("idx") % segment >= segment - history, F.array(F.col("segment"), F.col("segment") + 1)).otherwise(F.array("segment"))
    return at.withColumn("_own", F.col("segment")).withColumn("segment", F.explode(also)).select("conv_id", "segment", "idx", "role", "text", "_first", (F.col("_own") == F.col("segment")).alias("own"))


def formatted(rows: DataFrame, tokenizer: str, budget: int = 2048, history: int = 4, segment: int = 128) -> DataFrame:
    """One row a window: its text, the numbers of its turns, and its loss spans (code points of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        names = ["conv_id", "segment", "first", "text", "turns", "loss", "tokens"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.int64()]

        def windows(group: list[tuple], shown: list[tuple], head: str, counts: np.ndarray) -> list[tuple]:
            start = next(k for k, r in enumerate(group) if r[6])
            fixed, tokens = int(counts[0]), counts[1:].tolist()
            out = []
            skip = 1 if head and group[0][2] == 0 else 0  # the system turn itself stands in the head
            for begin, first, stop in spans(tokens[skip:], fixed, budget, history, max(0, start - skip)):
                begin, first, stop = begin + skip, first + skip, stop + skip
                parts, turns, loss = [head] if head else [], [0] if head else [], []
                length, total = len(head), fixed
                for k in range(begin, stop):
                    text, a, b = shown[k]
                    if k >= first and group[k][3] == "assistant" and b > a:
                        loss.append({"start": length + a, "stop": length + b})
                    parts.append(text)
                    turns.append(group[k][2])
                    length += len(text)
                    total += tokens[k]
                out.append((group[0][0], group[0][1], group[first][2], "".join(parts), turns, loss, total))
            if skip and len(group) == 1:
                out.append((group[0][0], group[0][1], 0, head, [0], [], fixed))
            return out

        def formatted_groups(groups: list[list[tuple]]) -> pa.RecordBatch:
            """The windows of several segments, whose texts are encoded together."""
            told = []
            for group in groups:
                system = next(r for r in group if r[6])[5]
                system = system if system and system["role"] == "system" else None
                told.append((group, [render(r[3], r[4]) for r in group], render(system["role"], system["text"])[0] if system else ""))
            _, counts = bpe.encode_batch([x for _, shown, head in told for x in (head, *(s[0] for s in shown))])
            found, at = [], 0
            for group, shown, head in told:
                found += windows(group, shown, head, counts[at : at + len(shown) + 1])
                at += len(shown) + 1
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        groups: list[list[tuple]] = []
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                if held and row[:2] != held[0][:2]:
                    # the turn after the last own one belongs to the next segment alone
                    groups += [held] if any(r[6] for r in held) else []
                    held = []
                    if size > SLICE_BYTES:
                        yield from [formatted_groups(groups)] if groups else []
                        groups, size = [], 0
                held.append(row)
                size += len(row[4]) + 64
        groups += [held] if any(r[6] for r in held) else []
        yield from [formatted_groups(groups)] if groups else []

    turns = numbered(rows, segment, history)
    return turns.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "idx").mapInArrow(run, WINDOWS)


def digests(windows: DataFrame) -> DataFrame:
    """What the windows say, read back from them: turns once each in order, and all text under the loss spans.

    A conversation's windows stream through one task in order, for its digests are chains; only states are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: dict = {}
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def done() -> tuple:
            return (key[0], state["next"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

        def emit(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            found = []
            for conv, text, turns, loss in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if key != (conv,):
                    if key is not None:
                        found.append(done())
                    key, state = (conv,), {"next": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                state["chars"] += len(text)
                for index, match in zip(turns, TURN.finditer(text), strict=True):
                    if index >= state["next"]:
                        state["turns"].update(f"{unescape_role(match[1])}\n{unescape(match[2])}\n".encode())
                        state["next"] = index + 1
                for span in loss:
                    own = unescape(text[span["start"] : span["stop"]])
                    state["loss_chars"] += len(own)
                    state["loss"].update(own.encode())
            if found:
                yield emit(found)
        if key is not None:
            yield emit([done()])

    ordered = windows.select("conv_id", "text", "turns", "loss", "first").repartition("conv_id").sortWithinPartitions("conv_id", "first")
    return ordered.select("conv_id", "text", "turns", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
