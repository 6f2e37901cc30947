"""SQL text for the stateful operators: one recursive step per row, written apart from the Spark code."""

from __future__ import annotations


def numbered(rows: str) -> str:
    """``rows`` is a query with ``key, ts, id`` and more columns."""
    return f"num AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS rn FROM ({rows}))"


def first_per_window(rows: str, window: int, inclusive: bool) -> str:
    over = f"n.ts - s.last {'>' if inclusive else '>='} CAST({window} AS BIGINT)"
    return f"""{numbered(rows)}, walk AS (
 SELECT key, 0::BIGINT AS rn, NULL::BIGINT AS last, NULL::VARCHAR AS id, NULL::BIGINT AS ts, FALSE AS kept FROM num GROUP BY key
 UNION ALL
 SELECT n.key, n.rn, CASE WHEN s.last IS NULL OR {over} THEN n.ts ELSE s.last END, n.id, n.ts, s.last IS NULL OR {over}
 FROM walk s JOIN num n ON n.key = s.key AND n.rn = s.rn + 1)"""


def threshold(rows: str, window: int, wanted: int) -> str:
    held = f"list_filter(s.held, lambda x: x > n.ts - CAST({window} AS BIGINT))"
    return f"""{numbered(rows)}, walk AS (
 SELECT key, 0::BIGINT AS rn, CAST([] AS BIGINT[]) AS held, NULL::VARCHAR AS id, NULL::BIGINT AS ts, FALSE AS fired FROM num GROUP BY key
 UNION ALL
 SELECT n.key, n.rn, CASE WHEN len({held}) + 1 >= {wanted} THEN CAST([] AS BIGINT[]) ELSE list_append({held}, n.ts) END,
 n.id, n.ts, len({held}) + 1 >= {wanted}
 FROM walk s JOIN num n ON n.key = s.key AND n.rn = s.rn + 1)"""


def sequence(rows: str, window: int, counts: list[int]) -> str:
    """``rows`` also has booleans ``s0, s1, ...``, one per step."""
    hit = "CASE step " + " ".join(f"WHEN {i} THEN s{i}" for i in range(len(counts))) + " END"
    need = "CASE step " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(counts)) + " END"
    flags = ", ".join(f"n.s{i}" for i in range(len(counts)))
    late = f"s.began IS NOT NULL AND n.ts - s.began > CAST({window} AS BIGINT)"
    return f"""{numbered(rows)}, walk AS (
 SELECT key, 0::BIGINT AS rn, 0 AS step, 0 AS cnt, NULL::BIGINT AS began, NULL::VARCHAR AS id, NULL::BIGINT AS ts, FALSE AS fired FROM num GROUP BY key
 UNION ALL
 SELECT key, rn,
  CASE WHEN hit AND cnt + 1 >= need THEN CASE WHEN step = {len(counts) - 1} THEN 0 ELSE step + 1 END ELSE step END,
  CASE WHEN hit THEN CASE WHEN cnt + 1 >= need THEN 0 ELSE cnt + 1 END ELSE cnt END,
  CASE WHEN hit AND cnt + 1 >= need AND step = {len(counts) - 1} THEN NULL WHEN hit THEN coalesce(began, ts) ELSE began END,
  id, ts, hit AND cnt + 1 >= need AND step = {len(counts) - 1}
 FROM (SELECT *, {hit} AS hit, {need} AS need FROM (
  SELECT n.key, n.rn, n.id, n.ts, {flags}, CASE WHEN {late} THEN 0 ELSE s.step END AS step,
   CASE WHEN {late} THEN 0 ELSE s.cnt END AS cnt, CASE WHEN {late} THEN NULL ELSE s.began END AS began
  FROM walk s JOIN num n ON n.key = s.key AND n.rn = s.rn + 1)))"""


def token_bucket(rows: str, interval: int, capacity: int) -> str:
    """Ends in ``admitted(key, ts, id, allowed)``."""
    return f"""src AS ({rows}), org AS (SELECT key, min(ts) AS t0 FROM src GROUP BY key), tk AS (
 SELECT src.*, (src.ts - t0) // CAST({interval} AS BIGINT) AS tick,
  row_number() OVER (PARTITION BY src.key, (src.ts - t0) // CAST({interval} AS BIGINT) ORDER BY src.ts, src.id) AS place
 FROM src JOIN org ON src.key = org.key), cnt AS (
 SELECT key, tick, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY tick) AS rn FROM tk GROUP BY key, tick), fill AS (
 SELECT key, 0::BIGINT AS rn, 0::BIGINT AS tick, {capacity}::BIGINT AS open, {capacity}::BIGINT AS rest FROM org
 UNION ALL
 SELECT c.key, c.rn, c.tick, least({capacity}, f.rest + c.tick - f.tick), greatest(least({capacity}, f.rest + c.tick - f.tick) - c.n, 0)
 FROM fill f JOIN cnt c ON c.key = f.key AND c.rn = f.rn + 1), admitted AS (
 SELECT tk.key, tk.ts, tk.id, tk.place <= fill.open AS allowed FROM tk JOIN fill ON fill.key = tk.key AND fill.tick = tk.tick AND fill.rn > 0)"""
