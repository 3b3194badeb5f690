"""DuckDB twins of the queries on trace lines."""

from __future__ import annotations

from strandlog.plans.oracle import STEPS, simulated

LINES = r"""
raw AS (SELECT event_id + 1 AS seq, event_type AS e, user_id AS u, user_id % 16 AS n, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
ev AS (
  SELECT seq, e, u, n, k, CAST(u % 4 AS INT) AS ctx, 65536 * (n + 1) AS base, CASE n % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'node' WHEN 2 THEN 'buf' ELSE 'odd' END AS type,
    CASE n % 4 WHEN 0 THEN 'ext' WHEN 1 THEN 'proc' END AS sub
  FROM raw),
first_seen AS (SELECT coalesce(sub, type) AS key, min(seq) AS seq, any_value(type) AS type_name, any_value(sub) AS name FROM ev WHERE e = 'signup' AND type <> 'odd' GROUP BY 1),
subs AS (SELECT row_number() OVER (ORDER BY seq) AS id, key, type_name, name FROM first_seen),
af0 AS (SELECT seq, e, base, type, sub, lag(e) OVER (PARTITION BY base ORDER BY seq) AS before FROM ev WHERE e = 'error' OR (e = 'signup' AND type <> 'odd')),
af AS (SELECT * FROM af0 WHERE (e = 'signup' AND coalesce(before, 'error') = 'error') OR (e = 'error' AND before = 'signup')),
life0 AS (SELECT *, lead(seq) OVER (PARTITION BY base ORDER BY seq) AS stop FROM af),
life AS (SELECT row_number() OVER (ORDER BY a.seq) AS id, s.id AS subclass_id, a.base, a.seq AS start, a.stop FROM life0 a JOIN subs s ON s.key = coalesce(a.sub, a.type) WHERE e = 'signup'),
acc0 AS (SELECT v.seq, CASE e WHEN 'click' THEN 'r' ELSE 'w' END AS type, v.base + 8 * (k % 9) AS address, k % 9 AS place, u, ctx, l.id AS alloc_id FROM ev v LEFT JOIN life l ON l.base = v.base AND v.seq > l.start AND (l.stop IS NULL OR v.seq < l.stop) WHERE e IN ('click', 'purchase')),
acc AS (SELECT row_number() OVER (ORDER BY seq) AS id, * FROM acc0 WHERE alloc_id IS NOT NULL AND place < 8),
op0 AS (
  SELECT seq, ctx, n, u % 2 AS flags, k % 5 AS place, CASE WHEN k % 4 < 2 THEN 'P' ELSE 'V' END AS kind, CASE WHEN k % 2 = 0 THEN 'r' ELSE 'w' END AS side, base,
    CASE k % 5 WHEN 0 THEN base + 48 WHEN 1 THEN base + 56 WHEN 2 THEN 66 WHEN 3 THEN 4096 + 16 * n ELSE 900000000 + n END AS address,
    CASE k % 5 WHEN 0 THEN 'rw_semaphore' WHEN 2 THEN 'rcu' ELSE 'mutex' END AS type, CASE k % 5 WHEN 0 THEN 'rw' WHEN 2 THEN 'r' ELSE 'w' END AS sides
  FROM ev WHERE e = 'view' AND NOT (k % 5 = 4 AND n % 2 = 0)),
op AS (
  SELECT o.*, l.id AS home, (o.place = 2 OR o.place = 3 AND o.address <= 4296) AS static
  FROM op0 o LEFT JOIN life l ON o.place < 2 AND l.base = o.base AND o.seq > l.start AND (l.stop IS NULL OR o.seq < l.stop)),
usable AS (SELECT * FROM op WHERE home IS NOT NULL OR static),
lk0 AS (SELECT address, home, min(seq) AS seen, arg_min(type, seq) AS type, arg_min(sides, seq) AS sides, arg_min(static, seq) AS static, arg_min(flags, seq) AS flags FROM usable WHERE kind = 'P' GROUP BY 1, 2),
lk AS (SELECT *, sum(length(sides)) OVER (ORDER BY seen) - length(sides) + 1 AS id FROM lk0),
side AS (
  SELECT lk.*, CAST(id + CASE WHEN sides = 'rw' AND s = 'w' THEN 1 ELSE 0 END AS BIGINT) AS lock_id, s AS sub_lock FROM (SELECT *, unnest(string_split(sides, '')) AS s FROM lk) lk),
locks AS (
  SELECT lock_id AS id, address, CASE WHEN static THEN NULL ELSE home END AS embedded_in, type AS lock_type_name, sub_lock,
    CASE WHEN NOT static THEN NULL WHEN address BETWEEN 4096 AND 4115 THEN 'table' WHEN address = 4128 THEN 'third' WHEN address = 4144 THEN 'fourth' END AS lock_var_name, CAST(flags AS INT) AS flags
  FROM side),
ops AS (
  SELECT o.seq, o.ctx, o.kind, s.lock_id, o.side, o.flags = 1 AS recursive, 'l' || o.n || '.c' AS file, o.place AS line
  FROM usable o JOIN side s ON s.address = o.address AND s.home IS NOT DISTINCT FROM o.home AND s.sub_lock = o.side AND o.seq >= s.seen),
rejected AS (
  SELECT CASE WHEN e = 'error' THEN 'free of an unused address' WHEN type = 'odd' THEN 'unknown type' ELSE 'address in use' END AS reason FROM ev WHERE e IN ('signup', 'error') AND seq NOT IN (SELECT seq FROM af)
  UNION ALL SELECT CASE WHEN alloc_id IS NULL THEN 'no allocation at base' ELSE 'outside its allocation' END FROM acc0 WHERE alloc_id IS NULL OR place = 8
  UNION ALL SELECT 'lock of unknown place' FROM op WHERE home IS NULL AND NOT static
  UNION ALL SELECT CASE WHEN l.seen IS NULL OR o.seq < l.seen THEN 'release of an unseen lock' ELSE 'side that the lock lacks' END
  FROM usable o LEFT JOIN lk l ON l.address = o.address AND l.home IS NOT DISTINCT FROM o.home WHERE l.seen IS NULL OR o.seq < l.seen OR instr(l.sides, o.side) = 0)"""


def lines(select: str) -> str:
    return f"WITH {LINES.strip()}\n{select}"


SQL = {
    "lines_subclasses": lines("SELECT CAST(id AS INT) AS id, type_name, name FROM subs"),
    "lines_allocations": lines("SELECT id, CAST(subclass_id AS INT) AS subclass_id, base AS base_address, CASE WHEN stop IS NULL THEN 64 ELSE 32 END AS size, start AS start_ts, stop AS end_ts FROM life"),
    "lines_accesses": lines("SELECT id, alloc_id, seq AS ts, type, 4 AS size, address, ctx AS context FROM acc"),
    "lines_locks": lines("SELECT * FROM locks"),
    "lines_lock_operations": lines("SELECT seq, ctx, kind, lock_id, side, recursive, file, CAST(line AS INT) AS line FROM ops"),
    "lines_stacktraces": lines("SELECT row_number() OVER (ORDER BY first) AS id, 4096 + u10 AS instruction_ptr, u3 || ',20' AS stacktrace FROM (SELECT u % 10 AS u10, u % 3 AS u3, min(seq) AS first FROM acc GROUP BY 1, 2)"),
    "lines_rejected": lines("SELECT reason, count(*) AS n FROM rejected GROUP BY 1"),
}

# The machine's operations and accesses; the read and the write side of a lock are locks of their own here.
EVENTS = """
mev AS (
  SELECT seq, ctx::BIGINT AS ctx, kind, lock_id AS lock, side, recursive AS again FROM ops
  UNION ALL SELECT seq, ctx, type, NULL, NULL, false FROM acc)"""
SQL["lines_transactions"] = f"WITH RECURSIVE {LINES.strip()},{simulated(EVENTS)}\n{STEPS}"
