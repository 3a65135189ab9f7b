"""Token-level chat formatting.

Each turn is <start> role newline content <end> newline.  Roles and contents are encoded
on their own and reserved ids are spliced in between, so that no token reaches over a border
and no text gives a reserved id.  The loss mask is the prefix sum of +1 where an
answer's content begins and -1 behind its end token.  Control strings that occur in contents or roles
are escaped: a zero-width space goes behind their first character.

Turns are ordered by (turn, role, text), nulls last; repeated rows are turns of their own.  Defined
cases: a null or empty text is an empty content; a null role is the role "unknown"; rows with a null conv_id
are one conversation; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.shared import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROL = {"<|endoftext|>": 50256, "<|im_start|>": 50257, "<|im_end|>": 50258}
LEARNED_ROLES = ("assistant",)


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if (top := max(ranks.values())) >= min(CONTROL.values()):
        raise ValueError(f"reserved ids begin at {min(CONTROL.values())}, the vocabulary ends at {top}")
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def escape(text: str) -> str:
    if "<|" in text:
        for c in CONTROL:
            text = text.replace(c, c[0] + "\u200b" + c[1:])
    return text


def assemble(conversations: list[list[tuple[str, str]]], encode_batch, learned=LEARNED_ROLES):
    """(ids, mask, ends): flat arrays, and where each conversation ends. encode_batch: texts -> lists of ids."""
    begin, end = CONTROL["<|im_start|>"], CONTROL["<|im_end|>"]
    turns = [t for c in conversations for t in c]
    roles = sorted({r for r, _ in turns})
    if not turns:
        return np.empty(0, np.int32), np.empty(0, np.int8), np.zeros(len(conversations), np.int64)
    newline, *heads = encode_batch(["\n", *(escape(r) for r in roles)])
    heads = {r: np.array([begin, *h, *newline], np.int32) for r, h in zip(roles, heads)}
    body = [np.array(x, np.int32) for x in encode_batch([escape(t) for _, t in turns])]
    tail = np.array([end, *newline], np.int32)
    parts = [p for (r, _), b in zip(turns, body) for p in (heads[r], b, tail)]
    size = np.array([len(p) for p in parts], np.int64).reshape(-1, 3)
    at = np.cumsum(size.reshape(-1)).reshape(-1, 3)
    ids = np.concatenate(parts)
    step = np.zeros(len(ids) + 1, np.int32)
    answers = np.array([r in learned for r, _ in turns])
    step[at[answers, 0]] += 1
    step[at[answers, 1] + 1] -= 1
    ends = np.concatenate([[0], at[:, 2]])[np.cumsum([len(c) for c in conversations])]
    return ids, np.cumsum(step[:-1]).astype(np.int8), ends


def chat_tokens(conversations: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """conv_id, n_turns, ids, mask, n_tokens, n_learned: a row for each conversation."""
    ship(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turn = F.struct(F.col("turn").isNull().alias("none"), "turn", F.col("role").isNull().alias("no_role"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.col("text").isNull().alias("no_text"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def run(batches):
        e = encoding(path)
        for b in batches:
            talks = [list(zip(r, t)) for r, t in zip(b.column("roles").to_pylist(), b.column("texts").to_pylist())]
            ids, mask, ends = assemble(talks, lambda x: e.encode_ordinary_batch(x, num_threads=1))
            offs = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            ids_, mask_ = pa.ListArray.from_arrays(offs, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offs, pa.array(mask, pa.int8()))
            learned = np.concatenate([[0], np.cumsum(mask)])
            bounds = np.concatenate([[0], ends]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([len(t) for t in talks], pa.int32()), ids_, mask_, pc.list_value_length(ids_), pa.array((learned[bounds[1:]] - learned[bounds[:-1]]).astype(np.int32))], names=["conv_id", "n_turns", "ids", "mask", "n_tokens", "n_learned"])

    return whole.mapInArrow(run, f"conv_id {kind}, n_turns int, ids array<int>, mask array<tinyint>, n_tokens int, n_learned int")
