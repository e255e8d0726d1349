"""Preference formatting of chat data, in Spark expressions only.

For each pair of conversations, chosen and rejected, the longest common prefix of turns is
rendered once as the prompt; the turns behind it are the two completions, each with a loss mask
that covers what the assistant says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.shared import let, running

TURN = "<|{role}|>\n{text}\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def pairs_by_id(turns: DataFrame) -> DataFrame:
    """(conv_id, pair_id, side): conversation 2i is pair i's chosen one, 2i + 1 its rejected one."""
    return turns.withColumns({"pair_id": F.floor(F.col("conv_id") / 2).cast("long"), "side": F.pmod("conv_id", F.lit(2)).cast("int")})


def preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, side 0 chosen / 1 rejected, turn, role, text) -> one row per pair that has both sides.

    pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask. A mask is the
    list of start:end, in code points of its completion and joined by commas, of the assistant's
    texts. Turns are numbered by the turn column; a turn number that a conversation repeats is
    ordered by role and text and each repetition compared in that order. Null role or text counts
    as empty. Rows with a null pair, side or turn belong to no conversation and give nothing; an
    empty table gives no row. The common prefix comes from an aggregate by turn, so a turn that
    very many pairs share is never a group of its own.
    """
    said = turns.filter(F.col("pair_id").isNotNull() & F.col("side").isNotNull() & F.col("turn").isNotNull()).select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    by_turn = said.groupBy("pair_id", "turn").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == i, F.struct("role", "text")))).alias(n) for i, n in ((0, "chosen"), (1, "rejected"))]
    )
    pair = by_turn.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "chosen", "rejected"))).alias("t"))
    pair = pair.select("pair_id", *[F.flatten(F.col(f"t.{side}")).alias(side) for side in ("chosen", "rejected")]).filter((F.size("chosen") > 0) & (F.size("rejected") > 0))
    longest = F.least(F.size("chosen"), F.size("rejected"))
    first_difference = F.array_min(
        F.filter(F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.when(F.get("chosen", i) == F.get("rejected", i), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    )
    pair = pair.withColumn("p", F.coalesce(first_difference, longest))
    text = lambda a: F.array_join(F.transform(a, lambda x: render(x["role"], x["text"])), "")
    behind = lambda c: F.slice(c, F.col("p") + 1, F.greatest(F.size(c) - F.col("p"), F.lit(0)))

    def mask(a: Column, ends: Column) -> Column:
        """ends: where each turn ends; a text ends one place before its turn."""
        said = let(ends, lambda e: F.transform(a, lambda x, i: F.struct(x["role"].alias("role"), F.length(x["text"]).alias("n"), (F.get(e, i) - 1).alias("end"))))
        spans = F.filter(said, lambda x: x["role"] == "assistant")
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", (x["end"] - x["n"]).cast("string"), x["end"].cast("string"))), ",")

    pair = pair.withColumns({"c": behind(F.col("chosen")), "r": behind(F.col("rejected"))})
    pair = pair.withColumns({f"{n}_ends": running(F.transform(n, lambda x: F.length(render(x["role"], x["text"])))) for n in ("c", "r")})
    return pair.select(
        "pair_id",
        F.col("p").cast("long").alias("n_prompt_turns"),
        text(F.slice("chosen", 1, F.col("p"))).alias("prompt"),
        text(F.col("c")).alias("chosen"),
        text(F.col("r")).alias("rejected"),
        mask(F.col("c"), F.col("c_ends")).alias("chosen_mask"),
        mask(F.col("r"), F.col("r_ends")).alias("rejected_mask"),
    )


PREFERENCE_SQL = """
WITH s AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), whole AS (
  SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM s GROUP BY pair_id HAVING nc > 0 AND nr > 0
), same AS (
  SELECT a.pair_id, a.k FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.k = b.k AND a.role = b.role AND a.text = b.text
), prefix AS (
  SELECT w.pair_id, coalesce((SELECT max(k) FROM (SELECT k, row_number() OVER (ORDER BY k) AS i FROM same WHERE same.pair_id = w.pair_id) WHERE k = i), 0)::BIGINT AS p FROM whole w
), r AS (
  SELECT s.*, p, '<|' || role || '|>' || chr(10) || text || chr(10) AS shown FROM s JOIN prefix USING (pair_id)
), o AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY k) AS upto FROM r WHERE k > p
), done AS (
  SELECT pair_id, side, string_agg(shown, '' ORDER BY k) AS body,
    coalesce(string_agg((upto - length(text) - 1)::BIGINT::VARCHAR || ':' || (upto - 1)::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (role = 'assistant'), '') AS mask
  FROM o GROUP BY pair_id, side
)
SELECT x.pair_id, x.p AS n_prompt_turns,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM r WHERE r.pair_id = x.pair_id AND side = 0 AND k <= r.p), '') AS prompt,
  coalesce(c.body, '') AS chosen, coalesce(j.body, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(j.mask, '') AS rejected_mask
FROM prefix x LEFT JOIN done c ON c.pair_id = x.pair_id AND c.side = 0 LEFT JOIN done j ON j.pair_id = x.pair_id AND j.side = 1
"""
