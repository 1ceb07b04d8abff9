"""Chat formatting at the level of tokens: segments are encoded apart, reserved ids are spliced in between.

Template, with S a segment and every marker one reserved id::

    user       [INST] S [/INST]
    system     [SYS] S [/SYS]
    assistant  [ASST] S </s>
    any other  [ROLE] name [TEXT] S </s>

a conversation being ``<s>``, its turns in order. In a segment each ``\\`` is doubled and a ``\\`` is put after the
first character of each control string, so no control string is left in it and a ``\\`` always guards one character.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import short_batches, table

# Control strings in the order of their reserved ids.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ASST]", "[ROLE]", "[TEXT]")
FIRST_ID = 50256  # the first id that the byte vocabulary leaves free
IDS = {c: FIRST_ID + i for i, c in enumerate(CONTROLS)}
BOS, EOS, INST, END_INST, SYS, END_SYS, ASST, ROLE, TEXT = IDS.values()
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_GUARDED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """``text`` without control strings; undone by `unescape`."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The text that `escape` was given."""
    return _GUARDED.sub(r"\1", text)


class Codec:
    """A lossless byte-level vocabulary; one to a Python worker."""

    made: dict[str, Codec] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, path: str) -> Codec:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")


#: Reserved ids before and after the segment of a turn whose role needs no name.
PLAIN = {"user": ([INST], [END_INST]), "system": ([SYS], [END_SYS]), "assistant": ([ASST], [EOS])}


def assemble(turns: list[tuple[str, list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a conversation from (role, ids of the role's name, ids of its text) turns.

    Segments are laid end to end; the mask is the running sum of +1 where an assistant's text begins and -1 where
    it ends.
    """
    parts: list[list[int]] = [[BOS]]
    trained = [False]
    for role, name, ids in turns:
        before, after = PLAIN.get(role) or ([ROLE, *name, TEXT], [EOS])
        parts += [before, ids, after]
        trained += [False, role == "assistant", False]
    ends = np.cumsum([len(p) for p in parts])
    steps = np.zeros(ends[-1] + 1, np.int64)
    on = np.array(trained)
    np.add.at(steps, (ends - [len(p) for p in parts])[on], 1)
    np.add.at(steps, ends[on], -1)
    return np.concatenate([np.asarray(p, np.int64) for p in parts]), np.cumsum(steps)[:-1]


def read_back(ids: list[int], codec: Codec) -> tuple[list[tuple[str, str]], str]:
    """(role, text) turns and the formatted text, from the ids of a conversation alone."""
    roles = {INST: "user", SYS: "system", ASST: "assistant"}
    turns: list[tuple[str, str]] = []
    said: list[str] = []
    role, name, held = None, None, []
    for i in [*ids, BOS]:
        if i < FIRST_ID:
            held.append(i)
            continue
        segment, held = codec.decode(held), []
        said += [segment, CONTROLS[i - FIRST_ID]]
        if i in roles or i == ROLE:
            role, name = roles.get(i), None
        elif i == TEXT:
            name = unescape(segment)
        elif i != BOS:
            turns.append((role if role is not None else name or "", unescape(segment)))
    return turns, "".join(said[:-1])


def under_mask(ids: list[int], mask: list[int], codec: Codec) -> str:
    """The text under the loss mask: the masked runs decoded and unescaped, one after another."""
    on = np.asarray(mask, bool)
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    return "".join(unescape(codec.decode(ids[a:b])) for a, b in zip(edge[::2], edge[1::2], strict=True))


def format_chats(conversations: DataFrame, vocabulary: str = "") -> DataFrame:
    """One row per conversation: conv_id, ids array<int>, loss_mask array<tinyint>.

    Turns are encoded row by row wherever they lie; only their ids meet, at the row they form. A conversation is one
    output row, so its turns do come together; nothing else does. Rows are ordered by turn (null first), then role
    and text, so ties and repeated rows have one result and all of them stay. A null text or role is empty, rows
    with a null conv_id form one conversation, and other columns are ignored. Texts of any length are encoded whole; an
    empty table gives no rows. As a conversation is one row, all its ids have to fit a task.
    """

    @F.pandas_udf("name array<int>, ids array<int>")
    def encoded(role: pd.Series, text: pd.Series) -> pd.DataFrame:
        codec = Codec.get(vocabulary)
        name = [[] if r in PLAIN else codec.encode(escape(r)) for r in role]
        return pd.DataFrame({"name": name, "ids": [codec.encode(escape(t)) for t in text]})

    @F.pandas_udf("ids array<int>, loss_mask array<tinyint>")
    def joined(turns: pd.Series) -> pd.DataFrame:
        made = [assemble([(t["role"], list(t["name"]), list(t["ids"])) for t in conversation]) for conversation in turns]
        return pd.DataFrame({"ids": [a.astype(np.int32) for a, _ in made], "loss_mask": [b.astype(np.int8) for _, b in made]})

    c = short_batches(conversations).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = c.select("conv_id", F.struct("turn", "role", "text", encoded("role", "text").alias("e")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    slim = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["e"]["name"].alias("name"), t["e"]["ids"].alias("ids")))
    return whole.select("conv_id", joined(slim).alias("j")).select("conv_id", "j.ids", "j.loss_mask")


def digests(formatted: DataFrame, vocabulary: str = "") -> DataFrame:
    """One row per row of ``formatted``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read
    back from ids and mask alone. Ids that `format_chats` made are taken for granted; a conversation without a turn
    has the digests of the empty text; an empty table gives no rows.
    """

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(ids: pd.Series, mask: pd.Series) -> pd.DataFrame:
        codec, rows = Codec.get(vocabulary), []
        for i, m in zip(ids, mask, strict=True):
            i = i.tolist()
            turns, text = read_back(i, codec)
            loss = under_mask(i, m, codec)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", read("ids", "loss_mask").alias("d")).select("conv_id", "d.*")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    all_rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_chats(all_rows))


def _sql() -> str:
    controls = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in CONTROLS)
    escapes = rf"(length(text) - length(replace(text, '\', ''))) + {controls}"
    overhead = f"CASE role WHEN 'user' THEN {len('[INST][/INST]')} WHEN 'system' THEN {len('[SYS][/SYS]')} WHEN 'assistant' THEN {len('[ASST]</s>')} ELSE {len('[ROLE][TEXT]</s>')} + length(role) END"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
d AS (SELECT *, length(text) + {escapes} + {overhead} AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) + 3 AS BIGINT) AS formatted_chars
FROM d GROUP BY conv_id
"""


QUERIES = {"op9_chat_formatting": op9_chat_formatting}
SQL = {"op9_chat_formatting": _sql()}
