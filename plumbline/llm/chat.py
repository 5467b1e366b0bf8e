"""Chats as training text: one text per conversation, its token ids, and a loss mask aligned by offsets.

Template: ``<|start|>role<|text|>text<|end|>`` for every turn. ``<|`` cannot
occur inside roles and texts: a backslash is put between its two characters,
and one more where backslashes stand there already, which can be undone.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: roles whose texts are learned
LEARNED = ("assistant",)
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|start\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
#: conversations rendered and encoded at once
AT_ONCE = 200


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text) if "<" in text else text


@lru_cache(maxsize=2)
def chat_tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file with the marks of the template as tokens, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    made.add_special_tokens([START, TEXT, END])
    return made


def render(turns: list[dict], learned: tuple[str, ...] = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and the sorted spans of the texts to learn."""
    parts, spans, at = [], [], 0
    for turn in turns:
        role, text = turn["role"] or "", escape(turn["text"] or "")
        head = f"{START}{escape(role)}{TEXT}"
        begin = at + len(head)
        at = begin + len(text) + len(END)
        parts += [head, text, END]
        if role in learned and text:
            spans.append((begin, begin + len(text)))
    return "".join(parts), spans


def covered(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens that overlap one of the sorted, separate spans: each looks for the first span that ends after its start."""
    if not spans:
        return np.zeros(len(starts), bool)
    low, high = np.array(spans).T
    which = np.searchsorted(high, starts, side="right")
    return (which < len(low)) & (ends > low[np.minimum(which, len(low) - 1)]) & (ends > starts)


def text_under(formatted: str, mask, starts, ends) -> str:
    """All text under the mask, unescaped, each stretch once."""
    out, begin, reach = [], None, -1
    for on, a, b in zip(mask, starts, ends):
        if on and begin is not None and a <= reach:
            reach = max(reach, b)
        elif on:
            if begin is not None:
                out.append(formatted[begin:reach])
            begin, reach = a, b
    if begin is not None:
        out.append(formatted[begin:reach])
    return "".join(map(unescape, out))


def conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, by turn (null first; ties by role, then text). Null is a conversation of its own."""
    row = F.struct(*[df[f"`{c}`"].alias(n) for c, n in ((turn, "turn"), (role, "role"), (text, "text"))])
    return df.groupBy(df[f"`{conv_id}`"].alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def format_chats(
    df: DataFrame, path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: tuple[str, ...] = LEARNED
) -> DataFrame:
    """conv_id, formatted, ids, starts, ends (in code points) and mask, one row per conversation.

    A conversation is rendered as a whole and encoded once. The mask is true
    for the tokens of the learned roles' texts, not for marks. Null roles and
    texts are empty. A conversation is one row of the result, so it has to fit
    into one; conversations are dealt over tasks by their id. An empty table
    gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chat_tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                piece = batch.slice(lo, AT_ONCE)
                made = [render(t, learned) for t in piece.column(1).to_pylist()]
                coded = own.encode_batch([t for t, _ in made], add_special_tokens=False)
                offsets = [np.array(c.offsets, np.int32).reshape(-1, 2) for c in coded]
                masks = [covered(s, o[:, 0], o[:, 1]) for (_, s), o in zip(made, offsets)]
                bounds = pa.array(np.cumsum([0, *map(len, offsets)]), pa.int32())
                both = np.concatenate(offsets)
                lists = [np.array([i for c in coded for i in c.ids], np.int32), both[:, 0], both[:, 1], np.concatenate(masks)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([t for t, _ in made], pa.string()), *[pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(x))) for x in lists]],
                    names=["conv_id", "formatted", "ids", "starts", "ends", "mask"],
                )

    grouped = conversations(df, conv_id, turn, role, text)
    whole = ArrayType(IntegerType())
    schema = StructType(
        [
            StructField("conv_id", grouped.schema["conv_id"].dataType),
            StructField("formatted", StringType()),
            *[StructField(n, whole) for n in ("ids", "starts", "ends")],
            StructField("mask", ArrayType(BooleanType())),
        ]
    )
    return grouped.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss_text, read from formatted conversations."""
    turn = StructType([StructField("role", StringType()), StructField("text", StringType())])
    schema = StructType(
        [formatted.schema["conv_id"], StructField("formatted", StringType()), StructField("turns", ArrayType(turn)), StructField("loss_text", StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            turns = [[{"role": unescape(r), "text": unescape(t)} for r, t in TURN.findall(text)] for text in texts]
            loss = [text_under(*row) for row in zip(texts, *[c.to_pylist() for c in batch.columns[2:]])]
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(turns, kind), pa.array(loss, pa.string())], names=["conv_id", "formatted", "turns", "loss_text"]
            )

    return formatted.select("conv_id", "formatted", "mask", "starts", "ends").mapInArrow(run, schema)
