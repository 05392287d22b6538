"""Chat formatting: budgeted, turn-aligned windows over conversations."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from corvane.llm.tables import table

BUDGET, HISTORY, OVERHEAD = 256, 2, 4


def turn_tokens(text: Column, overhead: int = OVERHEAD) -> Column:
    """Words and single punctuation marks of the text, and `overhead` for the turn's header."""
    return (F.coalesce(F.regexp_count(text, F.lit("[\\p{L}\\p{M}\\p{N}_]+|[^ \\t\\n\\r\\f\\p{L}\\p{M}\\p{N}_]")), F.lit(0)) + overhead).cast("bigint")


def plan_windows(roles: list[str | None], n: list[int], budget: int, history: int) -> Iterator[tuple[int, int, int, bool]]:
    """(turn's place, window, position, is_repeated) of one conversation's turns, in output order."""
    system = next((i for i, r in enumerate(roles) if r == "system"), None)
    rest = [i for i in range(len(roles)) if i != system]
    fixed = n[system] if system is not None else 0
    sums = [0]
    for i in rest:
        sums.append(sums[-1] + n[i])
    window, first = 0, 0
    while first < len(rest) or window == 0:
        # the most history that fits beside the first new turn
        back = 0
        while first and back < min(history, first) and first < len(rest) and fixed + sums[first + 1] - sums[first - back - 1] <= budget:
            back += 1
        # as far as the prefix sums stay within the budget, one new turn at least
        last = bisect_right(sums, budget - fixed + sums[first - back], first + 1) - 1 if first < len(rest) else first
        last = max(last, min(first + 1, len(rest)))
        place = 0
        if system is not None:
            yield system, window, 0, window > 0
            place = 1
        for k in range(first - back, last):
            yield rest[k], window, place, k < first
            place += 1
        window, first = window + 1, last


def _windows(budget: int, history: int) -> callable:
    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        conv, roles, n = rows.column("conv_id").to_pylist(), rows.column("role").to_pylist(), rows.column("n_tokens").to_pylist()
        out: list[tuple[int, int, int, bool]] = []
        start = 0
        for end in range(1, len(conv) + 1):
            if end == len(conv) or conv[end] != conv[start]:
                out += [(start + i, w, p, r) for i, w, p, r in plan_windows(roles[start:end], n[start:end], budget, history)]
                start = end
        for low in range(0, len(out), 4096):
            part = out[low : low + 4096]
            at = [x[0] for x in part]
            taken = rows.take(pa.array(at, pa.int64()))
            loss = [roles[i] == "assistant" and not r for i, _, _, r in part]
            columns = [taken.column("conv_id"), pa.array([x[1] for x in part], pa.int32()), pa.array([x[2] for x in part], pa.int32()), *(taken.column(c) for c in ("turn", "role", "text", "n_tokens")), pa.array([x[3] for x in part]), pa.array(loss)]
            yield from pa.table(columns, ["conv_id", "window_no", "position", "turn", "role", "text", "n_tokens", "is_repeated", "in_loss"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column(0).to_pylist()
            if held and held[-1].column(0)[-1].as_py() != conv[0]:
                yield from emit(pa.Table.from_batches(held))
                held = []
            cut = next((i for i in range(len(conv) - 1, 0, -1) if conv[i - 1] != conv[-1]), 0)
            if cut:  # whole conversations, with what was held of the first of them
                yield from emit(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from emit(pa.Table.from_batches(held))

    return run


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, overhead: int = OVERHEAD) -> DataFrame:
    """Splits conversations into windows of at most `budget` tokens that begin and end at turns.

    Every window begins with the conversation's system turn (its first turn with the role system),
    repeats up to `history` turns from before (as many of the last ones as fit beside the first new
    turn), and goes on with new turns as long as the running sum of tokens allows. A first new turn that
    doesn't fit alone is kept whole, in a window of its own that is over the budget. Loss falls on
    assistant turns where they are new; repeated ones are masked.

    Result: conv_id, window_no, position (both from 0), turn, role, text, n_tokens, is_repeated, in_loss;
    one row for each turn of each window. A conversation with a system turn only is one window.

    Order: turn, then role, text; nulls first, so that ties and repeated rows are all kept, in a fixed
    order. Null conv_id: those rows are one conversation. Null role: no system turn, no loss. Null or empty
    text: header tokens only. Very long texts are counted whole and never cut. Empty table: empty result. Other columns are ignored, whatever their names. One
    conversation at a time is held by a task.
    """
    base = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), turn_tokens(F.col("text"), overhead).alias("n_tokens"))
    kinds = {f.name: f.dataType for f in base.schema}
    schema = StructType([StructField(c, kinds.get(c, t)) for c, t in (("conv_id", None), ("window_no", IntegerType()), ("position", IntegerType()), ("turn", None), ("role", None), ("text", None), ("n_tokens", LongType()), ("is_repeated", BooleanType()), ("in_loss", BooleanType()))])
    ordered = base.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_windows(budget, history), schema)


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_windows(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH RECURSIVE base AS (
  SELECT conv_id, turn, role, text,
         (4 + coalesce(len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^ \\t\\n\\r\\f\\p{L}\\p{M}\\p{N}_]')), 0))::BIGINT AS n
  FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST, n) AS r FROM base),
sys AS (SELECT conv_id, min(r) AS r FROM ranked WHERE role = 'system' GROUP BY conv_id),
sysrow AS (SELECT ranked.* FROM ranked JOIN sys ON ranked.conv_id IS NOT DISTINCT FROM sys.conv_id AND ranked.r = sys.r),
t AS (
  SELECT a.conv_id, a.turn, a.role, a.text, a.n, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.r) - 1 AS i
  FROM ranked a LEFT JOIN sys s ON a.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE s.r IS NULL OR a.r <> s.r),
cost AS (
  SELECT t.conv_id, t.i, t.n, coalesce(s.n, 0) AS fixed,
         lag(t.n, 1) OVER w AS p1, lag(t.n, 2) OVER w AS p2
  FROM t LEFT JOIN sysrow s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
  WINDOW w AS (PARTITION BY t.conv_id ORDER BY t.i)),
walk AS (
  SELECT conv_id, i, 0::BIGINT AS win, 0::BIGINT AS h, 0::BIGINT AS s, (fixed + n)::BIGINT AS used FROM cost WHERE i = 0
  UNION ALL
  SELECT c.conv_id, c.i,
         CASE WHEN k.used + c.n <= 256 THEN k.win ELSE k.win + 1 END,
         CASE WHEN k.used + c.n <= 256 THEN k.h
              WHEN c.p2 IS NOT NULL AND c.fixed + c.p1 + c.p2 + c.n <= 256 THEN c.i - 2
              WHEN c.p1 IS NOT NULL AND c.fixed + c.p1 + c.n <= 256 THEN c.i - 1 ELSE c.i END,
         CASE WHEN k.used + c.n <= 256 THEN k.s ELSE c.i END,
         CASE WHEN k.used + c.n <= 256 THEN k.used + c.n
              WHEN c.p2 IS NOT NULL AND c.fixed + c.p1 + c.p2 + c.n <= 256 THEN c.fixed + c.p1 + c.p2 + c.n
              WHEN c.p1 IS NOT NULL AND c.fixed + c.p1 + c.n <= 256 THEN c.fixed + c.p1 + c.n ELSE c.fixed + c.n END
  FROM walk k JOIN cost c ON c.conv_id IS NOT DISTINCT FROM k.conv_id AND c.i = k.i + 1),
wins AS (SELECT conv_id, win, min(h) AS h, min(s) AS s, max(i) AS e FROM walk GROUP BY conv_id, win
         UNION ALL SELECT conv_id, 0, 0, 0, -1 FROM sysrow s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id IS NOT DISTINCT FROM s.conv_id)),
lines AS (
  SELECT w.conv_id, w.win, 0 AS o, -1 AS i, s.turn, s.role, s.text, s.n, w.win > 0 AS rep FROM wins w JOIN sysrow s ON w.conv_id IS NOT DISTINCT FROM s.conv_id
  UNION ALL
  SELECT w.conv_id, w.win, 1, t.i, t.turn, t.role, t.text, t.n, t.i < w.s FROM wins w JOIN t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i BETWEEN w.h AND w.e)
SELECT conv_id, win::INT AS window_no, (row_number() OVER (PARTITION BY conv_id, win ORDER BY o, i) - 1)::INT AS "position",
       turn, role, text, n AS n_tokens, rep AS is_repeated, coalesce(role = 'assistant' AND NOT rep, false) AS in_loss
FROM lines
"""
