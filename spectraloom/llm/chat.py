"""Chat formatting by rotating perspectives: each dialogue once for every participant, with that speaker as the assistant.

All other speakers are users with their names, system turns stay, and spans mark what the assistant says: the characters
to learn from. A dialogue is rendered in parts of ``turns_per_part`` turns, by turn number, so that none meets in one task
whole; its parts in order make the text. Text is shuffled once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_START, _END = "<|im_start|>", "<|im_end|>\n"
_STOP = len(_END) - 1  # the end mark is learnt, the line end isn't


def _render(turns: list[dict], speaker: str) -> tuple[str, list[int], list[int]]:
    out, at, starts, ends = [], 0, [], []
    for t in turns:
        who, text = t["speaker"], t["text"]
        head = f"{_START}assistant\n" if who == speaker else f"{_START}system\n" if who == "system" else f"{_START}user name={who}\n"
        if who == speaker:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(text) + _STOP)
        out += [head, text, _END]
        at += len(head) + len(text) + len(_END)
    return "".join(out), starts, ends


def _rotate(batches):
    names = ["_conv", "part", "perspective", "n_turns", "text", "mask_starts", "mask_ends"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for b in batches:
        for r in range(b.num_rows):
            turns, who = b.column(2)[r].as_py(), b.column(3)[r].as_py()
            for lo in range(0, len(who), 16):
                rows = [(b.column(0)[r].as_py(), b.column(1)[r].as_py(), s, len(turns), *_render(turns, s)) for s in who[lo : lo + 16]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def rotate(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns_per_part: int = 128) -> DataFrame:
    """(conv, part, perspective, n_turns, text, mask_starts, mask_ends): one row per dialogue, part and participant.

    Spans are of code points, [start, end) in the part's text. Turns are in order of turn (null first, as part -1), role, text; repeated
    rows are turns of their own. A null or empty role is the speaker ``unknown``; ``system`` is not a participant, so a
    dialogue of system turns alone gives no row. Null text is empty. Rows without a dialogue's id belong to none and are
    left out. Marks inside texts are broken (``<| im_``), so that no text can end its turn. Other columns are dropped.
    """
    mend = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    rows = chats.select(F.col(conv).cast("long").alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.when(F.coalesce(F.col(role), F.lit("")) == "", "unknown").otherwise(mend(role)).alias("speaker"), mend(text).alias("text")).filter("_conv IS NOT NULL")
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("_turn") / turns_per_part), F.lit(-1)).cast("long"))
    grouped = rows.groupBy("_conv", "part").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_turn", F.lit(-(1 << 62))).alias("t"), "speaker", "text"))).alias("turns"))
    who = rows.filter("speaker != 'system'").select("_conv", "speaker").distinct().groupBy("_conv").agg(F.array_sort(F.collect_list("speaker")).alias("who"))
    of_part = rows.select("_conv", "part").distinct().join(who, "_conv")
    out = grouped.join(of_part, ["_conv", "part"]).select("_conv", "part", "turns", "who").transform(C.map_batches, _rotate, "_conv long, part long, perspective string, n_turns long, text string, mask_starts array<long>, mask_ends array<long>")
    return out.withColumnRenamed("_conv", conv)


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.transform(F.arrays_zip("mask_starts", "mask_ends"), lambda x: F.concat(x["mask_starts"].cast("string"), F.lit("-"), x["mask_ends"].cast("string")))
    return out.select("conv_id", "part", "perspective", "n_turns", F.length("text").cast("long").alias("n_chars"), F.array_join(spans, ",").alias("mask"), F.md5("text").alias("text_md5"))


SQL = f"""
WITH t AS (SELECT conv_id, COALESCE(turn, -4611686018427387904) AS turn, COALESCE(CAST(floor(turn / 128.0) AS BIGINT), -1) AS part,
    CASE WHEN COALESCE(role, '') = '' THEN 'unknown' ELSE replace(role, '<|im_', '<| im_') END AS speaker, replace(COALESCE(text, ''), '<|im_', '<| im_') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
heads AS (SELECT t.*, perspective, speaker = perspective AS own, CASE WHEN speaker = perspective THEN '{_START}assistant' WHEN speaker = 'system' THEN '{_START}system'
    ELSE '{_START}user name=' || speaker END || chr(10) AS head FROM t JOIN p USING (conv_id)),
placed AS (SELECT *, COALESCE(SUM(length(head) + length(text) + {len(_END)}) OVER (PARTITION BY conv_id, part, perspective ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length(head) AS s FROM heads)
SELECT conv_id, part, perspective, COUNT(*) AS n_turns, CAST(SUM(length(head) + length(text) + {len(_END)}) AS BIGINT) AS n_chars,
  COALESCE(string_agg(CASE WHEN own THEN CAST(s AS BIGINT) || '-' || CAST(s + length(text) + {_STOP} AS BIGINT) END, ',' ORDER BY turn, speaker, text), '') AS mask,
  md5(string_agg(head || text || '{_END.strip()}' || chr(10), '' ORDER BY turn, speaker, text)) AS text_md5
FROM placed GROUP BY ALL"""
