"""Chat formatting into windows of a token budget, with a loss mask.

Turns are written as ``### role: text</turn>`` and a newline.  Inside texts a
backslash precedes each backslash, the second of two number signs, and the
slash of ``</turn``, so that no control string appears there and the text can be
read back.  Prefix sums of the turns' tokens choose spans of whole turns.
Every window begins with the conversation's leading system turn and, after the
first window, with a limited history repeated from the one before; the loss
mask covers each assistant text once, where it is new.

A turn beyond the budget alone gets a window of its own.  A null text or role is
empty; turns sort by number (null first), then role and text; repeated rows are
turns of their own; rows with a null id form one conversation.
A conversation, like a document, is formatted by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = "</turn>\n"
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)

WINDOWS = "window int, text string, n_turns int, n_repeated int, n_tokens long, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn", "<\\/turn")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def spans(tokens: np.ndarray, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first repeated turn, first new turn, end) of each window, by prefix sums.

    ``system`` leading turns stand in every window beside the span.  The
    repeated turns hold at most ``history`` tokens.
    """
    sums = np.concatenate(([0], np.cumsum(tokens)))
    out, new, n = [], system, len(tokens)
    while new < n or not out:
        back = new if not out else max(int(np.searchsorted(sums, sums[new] - history)), system)
        room = sums[back] + budget - sums[system]
        end = int(np.searchsorted(sums, room, "right")) - 1
        if end <= new < n:  # the history leaves no room: without it
            back = new
            end = max(new + 1, int(np.searchsorted(sums, sums[new] + budget - sums[system], "right")) - 1)
        end = max(end, new)
        out.append((back, new, min(end, n)))
        new = min(end, n)
    return out


def write_windows(turns: list[tuple[str, str, int]], budget: int, history: int, target: str = "assistant") -> Iterator[tuple[str, int, int, int, list[tuple[int, int]]]]:
    """(text, turns, repeated turns, tokens, loss spans) of each window of one conversation's (role, text, tokens)."""
    system = int(bool(turns) and turns[0][0] == "system")
    tokens = np.array([t[2] for t in turns], dtype=np.int64)
    for nth, (back, new, end) in enumerate(spans(tokens, system, budget, history)):
        chosen = [*range(system), *range(back, end)]
        parts, loss, at = [], [], 0
        for i in chosen:
            role, text, _ = turns[i]
            head, body = f"### {escape(role).replace(':', chr(92) + ':')}: ", escape(text)
            if role == target and i >= new:
                loss.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, _END]
            at += len(head) + len(body) + len(_END)
        yield "".join(parts), len(chosen), new - back + (system if nth else 0), int(tokens[chosen].sum()), loss


def read_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window's text."""
    out, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        end = text.index(_END, head.end())
        out.append((unescape(head[1]), unescape(text[head.end() : end])))
        at = end + len(_END)
    return out


def format_conversations(turns: DataFrame, budget: int = 2048, history: int = 256, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a window: conv_id, window, text, n_turns, n_repeated (turns that an earlier window has), n_tokens, loss (code points from, to)."""
    empty = F.lit("")
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text"))
    grouped = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    tokens = F.transform("turns", lambda t: F.regexp_count(t["text"], F.lit(r"\w+|[^\w\s]")) + F.lit(4))
    listed = grouped.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"), tokens.alias("tokens"))

    def write(batches):
        for batch in batches:
            rows = {n: [] for n in ("conv_id", "window", "text", "n_turns", "n_repeated", "n_tokens", "loss")}
            for conv, roles, texts, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for nth, (text, n, again, n_tokens, loss) in enumerate(write_windows(list(zip(roles, texts, counts, strict=True)), budget, history)):
                    for name, value in zip(rows, (conv, nth, text, n, again, n_tokens, [{"start": a, "end": b} for a, b in loss]), strict=True):
                        rows[name].append(value)
            kinds = {"conv_id": batch.column("conv_id").type, "window": pa.int32(), "text": pa.string(), "n_turns": pa.int32(), "n_repeated": pa.int32(), "n_tokens": pa.int64(), "loss": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds[n]) for n in rows], names=list(rows))

    return listed.mapInArrow(write, f"conv_id {dict(listed.dtypes)['conv_id']}, {WINDOWS}")


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_text (role, newline, text, newline a turn), loss_text and formatted_chars, from the windows alone."""
    per_conv = windows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "text", "n_repeated", "loss"))).alias("w"), F.sum(F.length("text")).alias("formatted_chars"))

    def read(batches):
        for batch in batches:
            n, told, loss = [], [], []
            for windows_ in batch.column("w").to_pylist():
                turns, learned = [], []
                for w in windows_:
                    turns += read_window(w["text"])[w["n_repeated"] :]
                    learned += [unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"]]
                n.append(len(turns))
                told.append("".join(f"{role}\n{text}\n" for role, text in turns))
                loss.append("".join(learned))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(loss, pa.string()), batch.column("formatted_chars")], names=["conv_id", "n_turns", "turns_text", "loss_text", "formatted_chars"])

    return per_conv.mapInArrow(read, f"conv_id {dict(per_conv.dtypes)['conv_id']}, n_turns long, turns_text string, loss_text string, formatted_chars long")
