"""Cumulative-snapshot collapse and rendering of chats.

Logs often hold a conversation again after every turn. Each turn gets a hash of its place, role and text; the
exclusive or of the hashes so far is the hash of the prefix that ends there. A conversation whose whole hash is a
proper prefix of another one is dropped by an anti-join, and so are equal conversations but for the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the chat format.
TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, place (from 1), and the two halves of the rolling prefix hash. Ties of turn go by role, then text, nulls first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    said = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashed = one.withColumn("h1", F.xxhash64(F.lit(1), *said)).withColumn("h2", F.xxhash64(F.lit(2), *said))
    return hashed.withColumn("p1", F.bit_xor("h1").over(so_far)).withColumn("p2", F.bit_xor("h2").over(so_far)).drop("h1", "h2")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no other one extends; of equal ones, the smallest id.

    Ends and prefixes are reduced to distinct hashes before they meet, so a first turn that every conversation
    shares is one row.
    """
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("place", "p1", "p2")).alias("end"))
    unique = ends.groupBy("end").agg(F.min("conv_id").alias("conv_id"))
    unique = unique.select("conv_id", F.col("end.place").alias("n_turns"), F.col("end.p1").alias("p1"), F.col("end.p2").alias("p2"))
    last = hashed.groupBy("conv_id").agg(F.max("place").alias("last"))
    inner = hashed.join(last, "conv_id").where("place < last").select("p1", "p2", F.col("place").alias("n_turns")).distinct()
    return unique.join(inner, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered: one row per maximal conversation of turns (conv_id, turn, role, text).

    Null roles and texts render as empty; rows without conv_id form no conversation; repeated rows are turns of
    their own; other columns are not read; an empty table gives no rows.
    """
    hashed = prefix_hashes(turns.where(F.col("conv_id").isNotNull()))
    kept = maximal_conversations(hashed)
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    line = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))
    said = hashed.select("conv_id", "place", line.alias("line")).join(kept, "conv_id")
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    return said.groupBy("conv_id").agg(F.first("n_turns").cast("long").alias("n_turns"), F.concat_ws("", F.transform(lines, lambda x: x.line)).alias("rendered"))


ORACLE = """
WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce('r' || role, 'n'), x := coalesce('t' || text, 'n')) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, said FROM t GROUP BY said)
SELECT u.conv_id, len(u.said)::BIGINT AS n_turns, t.rendered FROM u JOIN t USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM u AS o WHERE len(o.said) > len(u.said) AND o.said[1] = u.said[1] AND o.said[1:len(u.said)] = u.said)
"""
