"""DuckDB twins of the queries: common table expressions for the trace database, and a statement for each query.

Column names and rows equal those of the Spark queries.
"""

from __future__ import annotations

#: The base tables, from `events`.
BASE = r"""
ev AS (
  SELECT event_id + 1 AS seq, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, user_id, event_type, CAST(user_id % 4 AS INT) AS ctx,
    CASE event_type WHEN 'signup' THEN 'P' WHEN 'error' THEN 'V' WHEN 'purchase' THEN 'w' WHEN 'click' THEN 'r' WHEN 'view' THEN 'r' END AS kind
  FROM events),
pv0 AS (SELECT seq, ctx, k % 4 AS slot, kind, lag(kind) OVER (PARTITION BY ctx, k % 4 ORDER BY seq) AS before FROM ev WHERE kind IN ('P', 'V')),
pv AS (SELECT seq, ctx, slot, kind FROM pv0 WHERE (kind = 'P' AND coalesce(before, 'V') = 'V') OR (kind = 'V' AND before = 'P')),
acq AS (SELECT ctx, slot, ctx * 4 + slot + 1 AS lock_id, seq AS a, r FROM (SELECT *, lead(seq) OVER (PARTITION BY ctx, slot ORDER BY seq) AS r FROM pv) WHERE kind = 'P'),
raw AS (
  SELECT seq AS id, ctx, ctx * 8 + k % 8 + 1 AS alloc_id, seq AS ts, kind AS type, (ctx * 8 + k % 8 + 1) * 65536 + 8 * ((k // 8) % 6) + 4 * (k % 2) AS address, user_id % 10 + 1 AS stacktrace_id
  FROM ev WHERE kind IN ('r', 'w')),
held AS (SELECT raw.id, raw.ctx, acq.lock_id, acq.a, acq.r FROM raw JOIN acq ON raw.ctx = acq.ctx AND acq.a < raw.id AND (acq.r IS NULL OR raw.id < acq.r)),
tops AS (SELECT id, ctx, max(a) AS a_top FROM held GROUP BY ALL),
keyed AS (
  SELECT t.id, t.a_top, max(y.r) AS restart FROM tops t LEFT JOIN acq y ON y.ctx = t.ctx AND y.a < t.a_top AND y.r > t.a_top AND y.r < t.id GROUP BY t.id, t.a_top),
txn AS (SELECT id, coalesce(restart, a_top) * 1048576 + a_top AS txn_id FROM keyed),
accesses AS (SELECT raw.id, alloc_id, txn_id, ts, type, 4 AS size, address, stacktrace_id, ctx AS context FROM raw LEFT JOIN txn USING (id)),
locks_held AS (SELECT DISTINCT txn_id, lock_id, a AS start, 'l' || ((lock_id - 1) % 4) || '.c' AS last_file, (lock_id - 1) % 4 + 1 AS last_line FROM held JOIN txn USING (id)),
data_types AS (SELECT * FROM (VALUES (1, 'node'), (2, 'buf')) t(id, name)),
subclasses AS (SELECT * FROM (VALUES (1, 1, 'ext'), (2, 1, 'proc'), (3, 2, NULL)) t(id, data_type_id, name)),
allocations AS (
  SELECT i AS id, CASE WHEN (i - 1) % 2 = 1 THEN 3 WHEN (i - 1) % 8 < 4 THEN 1 ELSE 2 END AS subclass_id, i * 65536 AS base_address, 64 AS size, 0 AS start_ts, NULL AS end_ts FROM range(1, 33) t(i)),
member_names AS (SELECT i AS id, CASE WHEN i = 7 THEN 'm_lock' ELSE 'm' || (i - 1) END AS name FROM range(1, 8) t(i)),
structs_layout AS (
  SELECT t AS data_type_id, CASE WHEN t = 2 AND m = 6 THEN 'atomic_t' ELSE 'int' END AS data_type_name, m AS member_name_id, 8 * (m - 1) AS byte_offset, CASE WHEN m = 7 THEN 16 ELSE 8 END AS size
  FROM range(1, 3) a(t), range(1, 8) b(m)),
stacktraces AS (
  SELECT i AS id, s AS sequence, 4096 + 16 * i + s AS instruction_ptr, 4096 + 16 * i + s - CASE WHEN s > 0 THEN 1 ELSE 0 END AS instruction_ptr_prev,
    'fn' || ((3 * i + s) % 7) AS function, i + s AS line, 'fn' || ((3 * i + s) % 7) || '.c' AS file FROM range(1, 11) a(i), range(0, 3) b(s)),
function_blacklist AS (SELECT * FROM (VALUES (1, NULL, NULL, 'fn3', 0), (2, 1, NULL, 'fn5', NULL), (3, 3, 2, 'fn1', NULL)) t(id, subclass_id, member_name_id, fn, sequence)),
member_blacklist AS (SELECT 2 AS subclass_id, 3 AS member_name_id),
locks AS (
  SELECT i + 1 AS id, CASE i % 4 WHEN 0 THEN 4096 + i + 1 WHEN 1 THEN 66 WHEN 2 THEN 65536 * (i // 4 * 8 + 3) + 48 ELSE 65536 * (i // 4 * 8 + 4) + 52 END AS address,
    CASE i % 4 WHEN 2 THEN i // 4 * 8 + 3 WHEN 3 THEN i // 4 * 8 + 4 END AS embedded_in, CASE i % 4 WHEN 0 THEN 'mutex' WHEN 1 THEN 'rcu' WHEN 2 THEN 'spinlock' ELSE 'rw_semaphore' END AS lock_type_name,
    CASE i % 4 WHEN 1 THEN 'r' WHEN 3 THEN 'r' ELSE 'w' END AS sub_lock, CASE WHEN i % 4 = 0 THEN 'glock' || (i // 4) END AS lock_var_name, 0 AS flags FROM range(0, 16) t(i)),
layout_flat AS (SELECT l.*, CAST(o AS INT) AS helper_offset FROM structs_layout l, range(0, 64) t(o) WHERE o BETWEEN byte_offset AND byte_offset + size - 1),
mapped AS (
  SELECT ac.id AS ac_id, ac.txn_id, ac.alloc_id, ac.type AS ac_type, ac.context, a.subclass_id, sc.data_type_id, ac.stacktrace_id, sl.member_name_id, sl.byte_offset, ac.address, sl.data_type_name AS member_type
  FROM accesses ac JOIN allocations a ON ac.alloc_id = a.id JOIN subclasses sc ON a.subclass_id = sc.id
  LEFT JOIN layout_flat sl ON sl.data_type_id = sc.data_type_id AND sl.helper_offset = ac.address - a.base_address),
flat AS (
  SELECT ac_id, txn_id, alloc_id, ac_type, context, subclass_id, data_type_id, stacktrace_id, member_name_id, byte_offset FROM mapped m
  WHERE member_name_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM member_blacklist b WHERE b.subclass_id = m.subclass_id AND b.member_name_id = m.member_name_id)
    AND NOT EXISTS (
      SELECT 1 FROM stacktraces s JOIN function_blacklist f ON f.fn = s.function
      WHERE s.id = m.stacktrace_id AND (f.sequence IS NULL OR f.sequence = s.sequence)
        AND ((f.subclass_id IS NULL AND f.member_name_id IS NULL) OR (f.subclass_id = m.subclass_id AND (f.member_name_id IS NULL OR f.member_name_id = m.member_name_id))))),
emb AS (
  SELECT l.id AS lock_id, l.sub_lock, a.id AS alloc_id, a.subclass_id, sc.data_type_id, sl.member_name_id
  FROM locks l JOIN allocations a ON l.embedded_in = a.id JOIN subclasses sc ON a.subclass_id = sc.id
  JOIN layout_flat sl ON sl.data_type_id = sc.data_type_id AND sl.helper_offset = l.address - a.base_address)"""


def described(subclasses: bool) -> str:
    of_type = "CASE WHEN sc.name IS NULL THEN dt.name ELSE dt.name || ':' || sc.name END" if subclasses else "dt.name"
    return f"""
lk AS (
  SELECT l.id AS lock_id, l.embedded_in, l.sub_lock,
    CASE WHEN l.embedded_in IS NULL THEN coalesce(l.lock_var_name || ':', '') || l.id || '(' || l.lock_type_name || '[' || l.sub_lock || '])' END AS own,
    '(' || {of_type} || '.' || mn.name || CASE WHEN l.address - a.base_address = sl.byte_offset THEN '' ELSE '?' END || '[' || l.sub_lock || '])' AS place
  FROM locks l LEFT JOIN allocations a ON l.embedded_in = a.id LEFT JOIN subclasses sc ON a.subclass_id = sc.id LEFT JOIN data_types dt ON dt.id = sc.data_type_id
  LEFT JOIN layout_flat sl ON sl.data_type_id = sc.data_type_id AND sl.helper_offset = l.address - a.base_address LEFT JOIN member_names mn ON mn.id = sl.member_name_id)"""


LABEL = "CASE WHEN lk.embedded_in IS NULL THEN lk.own WHEN lk.embedded_in = g.alloc_id THEN 'EMBSAME' || lk.place ELSE 'EMBOTHER' || lk.place END"


def base(select: str, more: str = "") -> str:
    return f"WITH {BASE.strip()}{',' + more if more else ''}\n{select}"


def observed(subclasses: bool = False, wor: bool = False, where: str = "true", name: str = "obs") -> str:
    """CTEs lk, fac, g, obs."""
    type_id = "f.subclass_id" if subclasses else "f.data_type_id"
    type_name = "CASE WHEN sc.name IS NULL THEN dt.name ELSE dt.name || ':' || sc.name END" if subclasses else "dt.name"
    fold = "max(f.ac_type)" if wor else "f.ac_type"
    return f"""{described(subclasses)},
named AS (SELECT f.*, {type_id} AS type_id, {type_name} AS type_name, mn.name AS member, dt.name AS dt_name FROM flat f JOIN subclasses sc ON sc.id = f.subclass_id JOIN data_types dt ON dt.id = f.data_type_id JOIN member_names mn ON mn.id = f.member_name_id),
fac AS (SELECT alloc_id, txn_id, type_id, type_name, byte_offset, member, {fold} AS ac_type FROM named f WHERE txn_id IS NOT NULL AND {where} GROUP BY alloc_id, txn_id, type_id, type_name, byte_offset, member{'' if wor else ', f.ac_type'}),
g AS (SELECT alloc_id, txn_id, type_id, type_name, string_agg(ac_type || ':' || member, ',' ORDER BY byte_offset, ac_type, member) AS members_accessed FROM fac GROUP BY alloc_id, txn_id, type_id, type_name),
one AS (
  SELECT g.type_id, g.type_name, g.members_accessed, string_agg({LABEL}, ',' ORDER BY lh.start, lh.lock_id) AS locks_held
  FROM g JOIN locks_held lh ON lh.txn_id = g.txn_id JOIN lk ON lk.lock_id = lh.lock_id GROUP BY g.alloc_id, g.txn_id, g.type_id, g.type_name, g.members_accessed
  UNION ALL SELECT type_id, type_name, ac_type || ':' || member, '' FROM named WHERE txn_id IS NULL AND {where}),
{name} AS (SELECT type_id, type_name, members_accessed, locks_held, count(*) AS occurrences FROM one GROUP BY ALL)"""


STACK = f"""{described(False)},
named AS (SELECT f.*, dt.name AS type_name, mn.name AS member FROM flat f JOIN data_types dt ON dt.id = f.data_type_id JOIN member_names mn ON mn.id = f.member_name_id),
one AS (
  SELECT g.type_name, g.member, g.ac_type, g.stacktrace_id, string_agg({LABEL}, ',' ORDER BY lh.start, lh.lock_id) AS locks_held
  FROM named g JOIN locks_held lh ON lh.txn_id = g.txn_id JOIN lk ON lk.lock_id = lh.lock_id GROUP BY g.ac_id, g.type_name, g.member, g.ac_type, g.stacktrace_id
  UNION ALL SELECT type_name, member, ac_type, stacktrace_id, '' FROM named WHERE txn_id IS NULL)"""

#: Combinations, hypotheses and support, from the plain observations.
MINED = observed() + """,
combo AS (
  SELECT type_name, m[1] AS access, m[3:] AS member, CASE WHEN locks_held = '' THEN [] ELSE string_split(locks_held, ',') END AS locks, sum(occurrences)::BIGINT AS occurrences
  FROM (SELECT type_name, unnest(string_split(members_accessed, ',')) AS m, locks_held, occurrences FROM obs) GROUP BY ALL),
tot AS (SELECT type_name, access, member, sum(occurrences)::BIGINT AS total, sum(CASE WHEN len(locks) > 0 THEN occurrences ELSE 0 END)::BIGINT AS with_locks, count(*) AS combinations FROM combo GROUP BY ALL),
firsts AS (SELECT type_name, access, member, locks AS raw, list_filter(locks, lambda x, i: list_position(locks, x) = i) AS locks, occurrences FROM combo),
hyp AS (
  SELECT type_name, access, member, list_filter(locks, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS locks, sum(occurrences)::BIGINT AS occurrences
  FROM (SELECT *, unnest(range(0, CAST(pow(2, len(locks)) AS BIGINT))) AS mask FROM firsts) GROUP BY ALL),
hset AS (SELECT *, list_sort(locks) AS lock_set FROM hyp),
sup AS (
  SELECT type_name, access, member, array_to_string(lock_set, ' + ') AS lock_set, array_to_string(locks, ' -> ') AS locks, len(locks)::INT AS n_locks, set_occurrences, occurrences, total,
    occurrences / total AS percentage, occurrences / total * (least(occurrences / 50.0, 1) * least(occurrences / 50.0, 1) * (3 - 2 * least(occurrences / 50.0, 1))) AS confidence
  FROM (SELECT *, sum(occurrences) OVER (PARTITION BY type_name, access, member, lock_set)::BIGINT AS set_occurrences FROM hset) JOIN tot USING (type_name, access, member))"""

OBS = "SELECT type_id, type_name, members_accessed, locks_held, occurrences FROM obs"

SQL: dict[str, str] = {
    "acquisitions": base("SELECT ctx, slot, lock_id, a, r FROM acq"),
    "accesses": base("SELECT id, alloc_id, txn_id, type, address, stacktrace_id FROM accesses"),
    "locks_held": base("SELECT * FROM locks_held"),
    "transactions": base("SELECT txn_id AS id, min(ts) AS first_ts, max(ts) AS last_ts, min(context) AS start_ctx, count(*) AS n_accesses FROM accesses WHERE txn_id IS NOT NULL GROUP BY txn_id"),
    "layout_flat": base("SELECT data_type_id, member_name_id, byte_offset, helper_offset FROM layout_flat"),
    "accesses_flat": base("SELECT * FROM flat"),
    "locks_embedded_flat": base("SELECT * FROM emb"),
    "broken_accesses": base("SELECT ac_id, alloc_id, address, data_type_id FROM mapped WHERE member_name_id IS NULL"),
    "without_atomics": base("SELECT id, alloc_id, txn_id, type FROM accesses WHERE id NOT IN (SELECT ac_id FROM mapped WHERE member_type LIKE '%atomic\\_t%' ESCAPE '\\')"),
    "ignored_accesses": base(
        """SELECT m.ac_id, s.sequence, s.function, f.id AS rule_id, CASE WHEN f.id IS NULL THEN 0 ELSE 1 END AS by_function, CASE WHEN b.subclass_id IS NULL THEN 0 ELSE 1 END AS by_member
FROM mapped m JOIN stacktraces s ON s.id = m.stacktrace_id
LEFT JOIN function_blacklist f ON f.fn = s.function AND (f.sequence IS NULL OR f.sequence = s.sequence)
  AND ((f.subclass_id IS NULL AND f.member_name_id IS NULL) OR (f.subclass_id = m.subclass_id AND (f.member_name_id IS NULL OR f.member_name_id = m.member_name_id)))
LEFT JOIN member_blacklist b ON b.subclass_id = m.subclass_id AND b.member_name_id = m.member_name_id
WHERE m.member_name_id IS NOT NULL AND (f.id IS NOT NULL OR b.subclass_id IS NOT NULL)"""
    ),
    "txn_members_locks": base(OBS, observed()),
    "txn_members_locks_wor": base(OBS, observed(wor=True)),
    "txn_members_locks_subclasses": base(OBS, observed(subclasses=True)),
    "txn_members_locks_one_type": base(OBS, observed(where="dt_name = 'node'")),
    "txn_members_locks_one_member": base(OBS, observed(where="member = 'm1'")),
    "stack_members_locks": base("SELECT type_name, ac_type || ':' || member AS member, locks_held, count(DISTINCT stacktrace_id) AS occurrences FROM one GROUP BY ALL", STACK),
    "most_accessed_types": base("SELECT dt.name, count(*) AS n FROM flat f JOIN data_types dt ON dt.id = f.data_type_id GROUP BY 1"),
    "txn_members": base("SELECT type_id, members_accessed, count(*) AS occurrences FROM (SELECT alloc_id, txn_id, type_id, string_agg(ac_type || ':' || member, ',' ORDER BY byte_offset, member) AS members_accessed FROM fac GROUP BY ALL) GROUP BY ALL", observed(wor=True)),
    "lock_free_accesses": base("SELECT data_type_id, ac_type, count(*) AS n FROM flat WHERE txn_id IS NULL GROUP BY ALL"),
    "lock_distribution": base(
        """SELECT f.alloc_id, f.member_name_id, f.ac_type, coalesce(t.locks, '') AS locks, count(*) AS n FROM flat f LEFT JOIN
(SELECT txn_id, string_agg(l.lock_type_name || '[' || l.sub_lock || ']', '+' ORDER BY start, lock_id) AS locks FROM locks_held h JOIN locks l ON l.id = h.lock_id GROUP BY txn_id) t ON t.txn_id = f.txn_id GROUP BY ALL"""
    ),
    "type_members": base("SELECT CASE WHEN sc.name IS NULL THEN dt.name ELSE dt.name || ':' || sc.name END AS type_name, count(DISTINCT l.member_name_id) AS members FROM subclasses sc JOIN data_types dt ON dt.id = sc.data_type_id JOIN structs_layout l ON l.data_type_id = dt.id GROUP BY 1"),
    "blacklisted_members": base("SELECT subclass_id, count(*) AS n FROM member_blacklist GROUP BY 1"),
    "atomic_members": base("SELECT dt.name AS type_name, mn.name AS member, l.byte_offset FROM structs_layout l JOIN data_types dt ON dt.id = l.data_type_id JOIN member_names mn ON mn.id = l.member_name_id WHERE l.data_type_name = 'atomic_t'"),
    "callgraph_traces": base("SELECT f.stacktrace_id, string_agg(s.function, ',' ORDER BY s.sequence, f.ac_id) AS trace, count(*) AS n FROM flat f JOIN stacktraces s ON s.id = f.stacktrace_id GROUP BY 1"),
    "call_edges": base("SELECT b.function AS caller, a.function AS callee, count(*) AS n FROM flat f JOIN stacktraces a ON a.id = f.stacktrace_id JOIN stacktraces b ON b.id = a.id AND b.sequence = a.sequence + 1 GROUP BY ALL"),
    "lock_addresses": base("SELECT id AS lock_id, hex(address) AS address_hex, hex(address >> 8) AS page_hex FROM locks"),
    "totals": base("SELECT what, count(*) AS n FROM (SELECT CASE WHEN embedded_in IS NULL THEN 'locks, global' ELSE 'locks, embedded' END AS what FROM locks UNION ALL SELECT 'accesses, ' || type FROM accesses) GROUP BY 1"),
    "event_histogram": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "context_distribution": base(
        """SELECT f.ac_type, f.member_name_id, coalesce(t.lock, 'none') AS lock, CASE WHEN (e.k & 64) <> 0 THEN 'hardirq' WHEN (e.k & 32) <> 0 THEN 'softirq' ELSE 'task' END AS irq, count(*) AS n
FROM flat f JOIN ev e ON e.seq = f.ac_id LEFT JOIN (SELECT txn_id, arg_max(l.lock_type_name, start) AS lock FROM locks_held h JOIN locks l ON l.id = h.lock_id GROUP BY 1) t ON t.txn_id = f.txn_id GROUP BY ALL"""
    ),
    "lock_combinations": base("SELECT type_name, access, member, array_to_string(locks, ',') AS locks, occurrences FROM combo", MINED),
    "member_totals": base("SELECT * FROM tot", MINED),
    "hypotheses": base("SELECT * FROM sup", MINED),
    "hypotheses_over_cutoff": base("SELECT * FROM sup WHERE set_occurrences / total >= 0.1", MINED),
    "hypotheses_to_two_locks": base("SELECT type_name, access, member, lock_set, locks, occurrences FROM sup WHERE n_locks <= 2", MINED),
    "hypothesis_lattice": base("SELECT DISTINCT type_name, access, member, array_to_string(p, ' + ') AS parent, array_to_string(lock_set, ' + ') AS child FROM (SELECT *, unnest([lock_set[:-2], lock_set[2:]]) AS p FROM (SELECT DISTINCT type_name, access, member, lock_set FROM hset WHERE len(lock_set) > 0))", MINED),
    "flagship_top_rules": base(
        """SELECT type_name, access, member, locks, occurrences, total, percentage FROM (
  SELECT *, row_number() OVER (PARTITION BY type_name, access, member ORDER BY occurrences DESC, n_locks DESC, locks) AS k FROM sup WHERE n_locks > 0) WHERE k = 1""",
        MINED,
    ),
    "lock_numbers": base(
        """SELECT lock, row_number() OVER (ORDER BY seen) AS number FROM (
  SELECT lock, min({'a': type_id, 'b': occurrences, 'c': members_accessed, 'd': locks_held, 'e': pos}) AS seen
  FROM (SELECT *, unnest(string_split(locks_held, ',')) AS lock, generate_subscripts(string_split(locks_held, ','), 1) AS pos FROM obs WHERE locks_held <> '') GROUP BY lock)""",
        observed(),
    ),
}


def examples(data_type: str, member: str, access: str, locks: list[str], counter: bool, subclass: str | None = None, other: str = "EMB") -> str:
    """`locks` are pieces `JOIN ...` that narrow accesses f to those that hold the rule."""
    elsewhere = "'EMBOTHER' || lk.place" if other == "EMBOTHER" else "'EMB:' || lk.lock_id || lk.place"
    where = f"d.name = '{data_type}' AND m.name = '{member}' AND f.ac_type = '{access}'" + (f" AND s.name = '{subclass}'" if subclass else "")
    name = f"{data_type}:{subclass}" if subclass else data_type
    return f"""{described(True)},
f AS (SELECT f.* FROM flat f JOIN data_types d ON d.id = f.data_type_id JOIN member_names m ON m.id = f.member_name_id JOIN subclasses s ON s.id = f.subclass_id WHERE {where}),
good AS (SELECT DISTINCT f.ac_id FROM f {' '.join(locks)}),
chosen AS (SELECT * FROM f WHERE ac_id {'NOT IN' if counter else 'IN'} (SELECT ac_id FROM good)),
site AS (
  SELECT g.ac_id, g.stacktrace_id, coalesce(string_agg(CASE WHEN lk.embedded_in IS NULL THEN lk.own WHEN lk.embedded_in = g.alloc_id THEN 'EMBSAME' || lk.place ELSE {elsewhere} END || '@' || lh.last_file || ':' || lh.last_line, ',' ORDER BY lh.start, lh.lock_id), 'nolocks') AS locks
  FROM chosen g LEFT JOIN locks_held lh ON lh.txn_id = g.txn_id LEFT JOIN lk ON lk.lock_id = lh.lock_id GROUP BY g.ac_id, g.stacktrace_id),
cnt AS (SELECT stacktrace_id, locks, count(*) AS n FROM site GROUP BY ALL),
tr AS (SELECT id, string_agg('0x' || hex(instruction_ptr) || '@' || function || '@' || file || ':' || line, ',' ORDER BY sequence) AS stacktrace FROM stacktraces GROUP BY id),
ex AS (
  SELECT '{name}' AS data_type, '{member}' AS member, '{access}' AS accesstype, c.stacktrace_id, tr.stacktrace, string_agg(locks || '#' || n, '+' ORDER BY n DESC, locks DESC) AS locks_held
  FROM cnt c JOIN tr ON tr.id = c.stacktrace_id GROUP BY c.stacktrace_id, tr.stacktrace)"""


def same(k: int, member: str, data_type: str, sides: str = "'w'", subclass: str = "") -> str:
    return f"JOIN locks_held h{k} ON h{k}.txn_id = f.txn_id JOIN emb e{k} ON e{k}.lock_id = h{k}.lock_id AND e{k}.alloc_id = f.alloc_id AND e{k}.sub_lock IN ({sides}) JOIN data_types d{k} ON d{k}.id = e{k}.data_type_id AND d{k}.name = '{data_type}' JOIN subclasses s{k} ON s{k}.id = e{k}.subclass_id{subclass} JOIN member_names m{k} ON m{k}.id = e{k}.member_name_id AND m{k}.name = '{member}'"


def elsewhere(k: int, member: str, data_type: str, more: str = "") -> str:
    return same(k, member, data_type).replace(f"e{k}.alloc_id = f.alloc_id", f"e{k}.alloc_id <> f.alloc_id") + more


def by_id(k: int, ids: str) -> str:
    return f"JOIN locks_held h{k} ON h{k}.txn_id = f.txn_id AND h{k}.lock_id IN ({ids})"


EX = "SELECT * FROM ex"
CEX_ONE = examples("node", "m0", "r", [same(1, "m_lock", "node")], True)
CEX_TWO = examples("node", "m1", "w", [by_id(1, "1")], True)

SQL |= {
    "counterexamples": base(EX, CEX_ONE),
    "examples": base(EX, examples("node", "m0", "r", [same(1, "m_lock", "node")], False)),
    "counterexamples_subclass": base(EX, examples("node", "m1", "w", [same(1, "m_lock", "node", subclass=" AND s1.name = 'ext'")], True, "ext", "EMBOTHER")),
    "counterexamples_by_id": base(EX, examples("node", "m1", "w", [by_id(1, "SELECT b.id FROM locks a JOIN locks b ON a.address = b.address WHERE a.id = 2")], True)),
    "counterexamples_in_order": base(EX, examples("node", "m1", "r", [by_id(1, "1"), elsewhere(2, "m_lock", "node", " AND h2.start > h1.start")], True)),
    "examples_any_order": base(EX, examples("node", "m1", "r", [by_id(1, "1"), elsewhere(2, "m_lock", "node")], False)),
    "violation_stats": base(
        """SELECT name AS type_name, coalesce(v, 0)::BIGINT AS violations, coalesce(m, 0)::BIGINT AS members, coalesce(l, 0)::BIGINT AS locations FROM data_types LEFT JOIN (
  SELECT data_type, sum(n) AS v, count(DISTINCT member) AS m, count(DISTINCT stacktrace) AS l FROM (
    SELECT 'node' AS data_type, f.ac_id, 1 AS n, m.name AS member, f.stacktrace_id AS stacktrace FROM flat f JOIN member_names m ON m.id = f.member_name_id
    WHERE f.data_type_id = 1 AND ((m.name = 'm0' AND f.ac_type = 'r' AND f.ac_id NOT IN (SELECT f.ac_id FROM flat f """
        + same(1, "m_lock", "node")
        + """)) OR (m.name = 'm1' AND f.ac_type = 'w' AND f.ac_id NOT IN (SELECT f.ac_id FROM flat f """
        + by_id(2, "1")
        + """)))) GROUP BY 1) ON data_type = name"""
    ),
    "accesses_by_lock_member_function": base(
        f"""SELECT dt_name, sl_member, ac_type, stacktrace, locks_held, count(*) AS total, bool_or(hidden) AS hidden_access, bool_or(flatten) AS flatten_accesses FROM (
  SELECT g.ac_id, g.dt_name, g.sl_member, g.ac_type, t.stacktrace, h.hidden, h.flatten,
    coalesce(string_agg(replace({LABEL}, '?[', '[') || '@' || lh.last_file || ':' || lh.last_line, ' -> ' ORDER BY lh.start, lh.lock_id), 'nolocks') AS locks_held
  FROM g JOIN t ON t.ac_id = g.ac_id JOIN h ON h.ac_id = g.ac_id LEFT JOIN locks_held lh ON lh.txn_id = g.txn_id LEFT JOIN lk ON lk.lock_id = lh.lock_id
  GROUP BY g.ac_id, g.dt_name, g.sl_member, g.ac_type, t.stacktrace, h.hidden, h.flatten) GROUP BY dt_name, sl_member, ac_type, stacktrace, locks_held""",
        f"""{described(True)},
g AS (
  SELECT m.*, mn.name AS sl_member, CASE WHEN sc.name IS NULL THEN dt.name ELSE dt.name || ':' || sc.name END AS dt_name
  FROM mapped m LEFT JOIN member_names mn ON mn.id = m.member_name_id JOIN subclasses sc ON sc.id = m.subclass_id JOIN data_types dt ON dt.id = sc.data_type_id),
t AS (
  SELECT g.ac_id, string_agg(lower(hex(s.instruction_ptr)) || '@' || s.function || '@' || s.file || ':' || s.line || '@m_bl:' || CASE WHEN b.subclass_id IS NULL THEN 0 ELSE 1 END || '@fn_bl:' || CASE WHEN f.id IS NULL THEN 0 ELSE 1 END, ',' ORDER BY s.sequence) AS stacktrace
  FROM g JOIN stacktraces s ON s.id = g.stacktrace_id LEFT JOIN member_blacklist b ON b.subclass_id = g.subclass_id AND b.member_name_id = g.member_name_id
  LEFT JOIN function_blacklist f ON f.fn = s.function AND (f.sequence IS NULL OR f.sequence = s.sequence)
    AND ((f.subclass_id IS NULL AND f.member_name_id IS NULL) OR (f.subclass_id = g.subclass_id AND (f.member_name_id IS NULL OR f.member_name_id = g.member_name_id))) GROUP BY g.ac_id),
h AS (
  SELECT g.ac_id, coalesce(bool_or(p.ac_type = 'w' AND g.ac_type = 'r'), false) AS hidden, coalesce(bool_or(p.ac_type = g.ac_type), false) AS flatten
  FROM g LEFT JOIN flat p ON p.ac_id <> g.ac_id AND p.txn_id = g.txn_id AND p.alloc_id = g.alloc_id GROUP BY g.ac_id)""",
    ),
    "validation": base(
        """SELECT * FROM (
SELECT 'accesses: repeated key' AS "constraint", count(*) AS n FROM (SELECT id FROM accesses GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'locks_held: repeated key', count(*) FROM (SELECT txn_id, lock_id FROM locks_held GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'structs_layout: repeated key', count(*) FROM (SELECT data_type_id, byte_offset FROM structs_layout GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'member_blacklist: repeated key', count(*) FROM (SELECT subclass_id, member_name_id FROM member_blacklist GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'allocations: size > 0', count(*) FROM allocations WHERE NOT size > 0
UNION ALL SELECT 'accesses: type in (''r'', ''w'')', count(*) FROM accesses WHERE type NOT IN ('r', 'w')
UNION ALL SELECT 'locks: sub_lock in (''r'', ''w'')', count(*) FROM locks WHERE sub_lock NOT IN ('r', 'w')
UNION ALL SELECT 'accesses.alloc_id: no parent', count(*) FROM accesses WHERE alloc_id NOT IN (SELECT id FROM allocations)
UNION ALL SELECT 'accesses.txn_id: no parent', count(*) FROM accesses WHERE txn_id IS NOT NULL AND txn_id NOT IN (SELECT txn_id FROM locks_held)
UNION ALL SELECT 'locks_held.lock_id: no parent', count(*) FROM locks_held WHERE lock_id NOT IN (SELECT id FROM locks)
UNION ALL SELECT 'locks.embedded_in: no parent', count(*) FROM locks WHERE embedded_in IS NOT NULL AND embedded_in NOT IN (SELECT id FROM allocations)
UNION ALL SELECT 'allocations.subclass_id: no parent', count(*) FROM allocations WHERE subclass_id NOT IN (SELECT id FROM subclasses))"""
    ),
}


def documented_rules() -> str:
    from strandlog.sources.documented import RULES

    return ",\nrules AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in RULES) + ") t(type_name, access, member, rule))"


CHECKED = MINED + documented_rules() + """,
chk AS (
  SELECT *, CASE WHEN hypotheses = 0 THEN 'none' WHEN percentage IS NULL THEN 'red' WHEN percentage = 1 THEN 'green' ELSE 'yellow' END AS colour FROM (
    SELECT r.type_name, r.access, r.member, r.rule, count(s.locks) AS hypotheses, max(CASE WHEN regexp_full_match(s.locks, r.rule) THEN s.percentage END) AS percentage
    FROM rules r LEFT JOIN sup s ON s.type_name = r.type_name AND s.access = r.access AND s.member = r.member GROUP BY ALL))"""
TOP = MINED + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type_name, access, member ORDER BY occurrences DESC, n_locks DESC, locks) AS k FROM sup WHERE n_locks > 0) WHERE k = 1)"""

SQL |= {
    "rule_check": base("SELECT * FROM chk", CHECKED),
    "rule_check_summary": base("SELECT type_name, count(*) AS rules, count(*) FILTER (colour = 'none') AS no_observations, count(*) FILTER (colour <> 'none') AS observed, count(*) FILTER (colour = 'green') AS \"full\", count(*) FILTER (colour = 'yellow') AS found, count(*) FILTER (colour = 'red') AS not_found FROM chk GROUP BY 1", CHECKED),
    "support_distribution": base("SELECT access, avg(percentage) AS mean, count(*) AS members, count(*) FILTER (percentage < 0.9) AS below FROM top GROUP BY 1", TOP),
    "accepted_share": base("SELECT t AS threshold, count(*) FILTER (100 * percentage >= t) AS accepted, count(*) AS members FROM top, range(0, 101, 5) r(t) GROUP BY 1", TOP),
    "no_lock_ratio": base("SELECT t AS threshold, count(DISTINCT CASE WHEN 100 * percentage >= 50 THEN (type_name, access, member) END) AS members, count(DISTINCT CASE WHEN n_locks > 0 AND 100 * percentage >= t THEN (type_name, access, member) END) AS locked FROM sup, range(50, 101, 5) r(t) GROUP BY 1", MINED),
    "support_histogram": base("SELECT CAST(floor(100 * percentage) AS BIGINT) AS bin, count(*) AS n FROM sup WHERE n_locks > 0 AND access = 'w' AND 100 * percentage >= 10 GROUP BY 1", MINED),
    "confidence_quartiles": base("SELECT access, min(confidence) AS least, quantile_cont(confidence, 0.25) AS q1, quantile_cont(confidence, 0.5) AS median, quantile_cont(confidence, 0.75) AS q3, max(confidence) AS most FROM sup GROUP BY 1", MINED),
}

#: Coverage inputs.
INPUTS = r"""
ev AS (SELECT event_id + 1 AS seq, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
maps AS (SELECT user_id AS map, (7 * k + user_id) % 211 AS number, lpad(lower(hex((7 * k + user_id) % 211)), 16, '0') AS bb, seq AS t FROM ev),
ins AS (SELECT user_id % 4 AS part, seq AS addr, event_type = 'signup' AS is_call, event_type = 'error' AS is_stop, '/f' || (user_id % 10) || '.c' AS file, k AS line, k % 10 = 0 AS is_pc FROM ev),
src AS (SELECT p_partkey, '/fs/' || p_type || '/' || p_brand || '.c' AS file, p_size AS line, p_partkey IN (SELECT l_partkey FROM lineitem) AS covered FROM part)"""
WALKS = """,
isl AS (SELECT *, coalesce(min(CASE WHEN is_stop THEN addr END) OVER (PARTITION BY part ORDER BY addr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS island FROM ins),
walk AS (SELECT DISTINCT i.file, i.line FROM isl i JOIN (SELECT part, island, min(addr) AS first FROM isl WHERE is_pc GROUP BY ALL) p ON p.part = i.part AND p.island = i.island AND i.addr >= p.first)"""


def inputs(select: str, more: str = "") -> str:
    return f"WITH {INPUTS.strip()}{more}\n{select}"


SQL |= {
    "coverage_unique": inputs("SELECT DISTINCT map, bb FROM maps"),
    "coverage_shifted": inputs("SELECT DISTINCT map, lpad(lower(hex(number + 5)), 16, '0') AS bb FROM maps"),
    "coverage_union": inputs("SELECT DISTINCT bb FROM maps WHERE map IN (0, 1, 2)"),
    "coverage_intersection": inputs("SELECT bb FROM maps WHERE map = 0 INTERSECT SELECT bb FROM maps WHERE map = 1"),
    "coverage_minus": inputs("SELECT bb FROM maps WHERE map = 0 EXCEPT SELECT bb FROM maps WHERE map = 1"),
    "coverage_subsystem": inputs("SELECT DISTINCT bb FROM maps WHERE number % 5 IN (1, 2)"),
    **dict.fromkeys(("coverage_pairs", "coverage_pairs_all"), inputs("SELECT a.map AS map_a, b.map AS map_b, count(*) AS n FROM (SELECT DISTINCT map, bb FROM maps) a JOIN (SELECT DISTINCT map, bb FROM maps) b ON a.bb = b.bb AND a.map <> b.map GROUP BY ALL")),
    "coverage_suite_overlaps": inputs(
        """SELECT array_to_string(list_filter(s, lambda x, i: (mask >> (i - 1)) & 1 = 1), '&') AS suites, count(*) AS n
FROM (SELECT s, unnest(range(1, CAST(pow(2, len(s)) AS BIGINT))) AS mask FROM (SELECT bb, list_sort(list(DISTINCT 's' || (map % 4))) AS s FROM maps WHERE number % 4 <> map % 4 GROUP BY bb)) GROUP BY 1"""
    ),
    "coverage_series": inputs(
        """SELECT p.map, p.t - min(p.t) OVER () AS t, p.current, p.current_subset, sum(coalesce(n.new, 0)) OVER w AS aggregate, sum(coalesce(n.new_subset, 0)) OVER w AS aggregate_subset
FROM p LEFT JOIN n ON n.map = p.map WINDOW w AS (ORDER BY p.t, p.map ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        """,
u AS (SELECT map, bb, min(t) AS t, (number < 100)::INT AS inside FROM maps GROUP BY map, bb, number),
p AS (SELECT map, min(t) AS t, count(*) AS current, sum(inside) AS current_subset FROM u GROUP BY map),
f AS (SELECT u.bb, u.inside, first(u.map ORDER BY p.t, p.map) AS map FROM u JOIN p ON p.map = u.map GROUP BY ALL),
n AS (SELECT map, count(*) AS new, sum(inside) AS new_subset FROM f GROUP BY map)""",
    ),
    "coverage_bitmap": inputs("SELECT user_id AS map, 4096 + seq * 64 + j AS bb FROM ev, range(0, 64) r(j) WHERE (k::BIGINT >> j::INT) & 1 = 1"),
    "coverage_after_calls": inputs("SELECT part, addr FROM (SELECT *, lag(is_call) OVER (PARTITION BY part ORDER BY addr) AS after FROM ins) WHERE after"),
    "coverage_walks": inputs("SELECT * FROM walk", WALKS),
    "coverage_share": inputs("SELECT c.file, count(*) AS coverable, count(w.file) AS covered, 100.0 * count(w.file) / count(*) AS percentage FROM (SELECT DISTINCT file, line FROM ins) c LEFT JOIN walk w ON w.file = c.file AND w.line = c.line GROUP BY 1", WALKS),
    "coverage_block_of_line": inputs("SELECT h.file, h.line, (SELECT max(b.line) FROM src b WHERE b.p_partkey % 3 = 0 AND b.file = h.file AND b.line <= h.line) AS start FROM src h WHERE h.covered"),
    "coverage_by_file": inputs("SELECT file AS name, count(*) AS lines, sum(covered) AS covered, 100.0 * sum(covered) / count(*) AS percentage FROM (SELECT file, line, max(covered::INT) AS covered FROM src GROUP BY ALL) GROUP BY 1"),
    "coverage_by_directory": inputs("SELECT regexp_replace(file, '/[^/]*$', '') AS name, count(*) AS lines, sum(covered) AS covered, 100.0 * sum(covered) / count(*) AS percentage FROM (SELECT file, line, max(covered::INT) AS covered FROM src GROUP BY ALL) GROUP BY 1"),
    "coverage_compose": inputs("SELECT DISTINCT map, 'run ' || map AS command FROM maps WHERE map NOT IN (SELECT map FROM maps WHERE number < 3)"),
    "coverage_curve_lines": inputs("SELECT DISTINCT number AS i, number % 16 AS x, number // 16 AS y FROM maps"),
}

# The quadrants of a Hilbert curve, from the last two bits of a cell's number on; a spiral as a walk whose k-th step has the direction of its leg.
SQL["coverage_curve_hilbert"] = inputs(
    """SELECT i, x, y FROM hil WHERE s = 16""",
    """,
hil AS (
  SELECT DISTINCT number AS i, number::BIGINT AS d, 0::BIGINT AS x, 0::BIGINT AS y, 1::BIGINT AS s FROM maps
  UNION ALL
  SELECT i, d // 4, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN s - 1 - y ELSE y END + s * rx, CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN s - 1 - x ELSE x END + s * ry, s * 2
  FROM (SELECT *, (d // 2) % 2 AS rx, xor(d % 2, (d // 2) % 2) AS ry FROM hil) WHERE s < 16)""",
).replace("WITH ", "WITH RECURSIVE ", 1)
SQL["coverage_curve_spiral"] = inputs(
    """SELECT k AS i, 8 + x AS x, 8 + y AS y FROM way WHERE k IN (SELECT number FROM maps)""",
    """,
leg AS (SELECT k, CASE WHEN k = 0 THEN -1 ELSE (floor(sqrt(4 * k - 3))::BIGINT - 1) % 4 END AS turn FROM (SELECT unnest(range(0, 256)) AS k)),
way AS (SELECT k, sum(CASE turn WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) OVER (ORDER BY k)::BIGINT AS x, sum(CASE turn WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END) OVER (ORDER BY k)::BIGINT AS y FROM leg)""",
)
# Each step's map has the most blocks that are not taken; the taken ones are a list.
SQL["coverage_set_cover"] = inputs(
    "SELECT step, map, gain, total FROM cov WHERE step > 0",
    """,
u AS (SELECT map, list(DISTINCT bb) AS bbs FROM maps GROUP BY map),
cov AS (
  SELECT 0 AS step, 0::BIGINT AS map, 0::BIGINT AS gain, 0::BIGINT AS total, [''] AS taken
  UNION ALL
  SELECT step, map, gain, total, taken FROM (
    SELECT c.step + 1 AS step, u.map::BIGINT AS map, len(list_filter(u.bbs, lambda b: NOT list_contains(c.taken, b)))::BIGINT AS gain, c.total + len(list_filter(u.bbs, lambda b: NOT list_contains(c.taken, b)))::BIGINT AS total,
      list_concat(c.taken, u.bbs) AS taken, row_number() OVER (ORDER BY len(list_filter(u.bbs, lambda b: NOT list_contains(c.taken, b))) DESC, u.map) AS k
    FROM cov c CROSS JOIN u) WHERE k = 1 AND gain > 0)""",
).replace("WITH ", "WITH RECURSIVE ", 1)
# Of the orders of locks that every observation has, the longest; equal ones by their locks' numbers.
SQL["winners_lockset"] = base(
    """SELECT w.type_name, w.access, w.member, array_to_string(w.locks, ' -> ') AS locks, CASE WHEN w.k = 1 THEN 1 ELSE 2 END AS accepted,
  coalesce((SELECT string_agg(array_to_string(o.locks, ' -> '), ',' ORDER BY o.k) FROM longest o WHERE o.type_name = w.type_name AND o.access = w.access AND o.member = w.member AND o.k <> w.k), '') AS conflicts
FROM longest w""",
    MINED
    + """,
num AS (SELECT lock, row_number() OVER (ORDER BY seen) AS number FROM (
  SELECT lock, min({'a': type_id, 'b': occurrences, 'c': members_accessed, 'd': locks_held, 'e': pos}) AS seen
  FROM (SELECT *, unnest(string_split(locks_held, ',')) AS lock, generate_subscripts(string_split(locks_held, ','), 1) AS pos FROM obs WHERE locks_held <> '') GROUP BY lock)),
always AS (SELECT h.type_name, h.access, h.member, h.locks FROM hyp h JOIN tot t USING (type_name, access, member) WHERE h.occurrences = t.total),
placed AS (
  SELECT a.type_name, a.access, a.member, a.locks, coalesce(list_sort(list(n.number) FILTER (n.number IS NOT NULL)), []) AS numbers
  FROM (SELECT *, unnest(CASE WHEN len(locks) = 0 THEN [''] ELSE locks END) AS lock FROM always) a LEFT JOIN num n ON n.lock = a.lock GROUP BY ALL),
longest AS (
  SELECT *, row_number() OVER (PARTITION BY type_name, access, member ORDER BY numbers) AS k
  FROM (SELECT *, max(len(locks)) OVER (PARTITION BY type_name, access, member) AS most FROM placed) WHERE len(locks) = most)""",
)

def simulated(events: str) -> str:
    """A machine of each lock, an operation a step: `open` are acquisitions {ctx, side, a}, the newest last. `events` is a CTE mev (seq, ctx, kind, lock, side, again). CTEs m_op to m_txn."""
    return f"""{events},
m_op AS (SELECT *, row_number() OVER (PARTITION BY lock ORDER BY seq) AS k FROM mev WHERE kind IN ('P', 'V')),
m_sim AS (
  SELECT lock, 0::BIGINT AS k, 0::BIGINT AS seq, -1::BIGINT AS ctx, CAST([] AS STRUCT(ctx BIGINT, side VARCHAR, a BIGINT)[]) AS open, CAST([] AS BIGINT[]) AS ended, false AS lost FROM m_op WHERE k = 1
  UNION ALL
  SELECT lock, k, seq, ctx, CASE WHEN kind = 'P' THEN list_append(list_filter(open, lambda x: NOT list_contains(gone, x.a)), {{'ctx': ctx, 'side': side, 'a': seq}}) ELSE list_filter(open, lambda x: NOT list_contains(gone, x.a)) END,
    gone, kind = 'V' AND len(gone) = 0
  FROM (
    SELECT o.*, s.open, CASE
      WHEN o.kind = 'P' THEN list_transform(list_filter(s.open, lambda x: x.side <> o.side OR (o.side = 'w' AND NOT o.again)), lambda x: x.a)
      WHEN len(list_filter(s.open, lambda x: x.side = o.side)) = 0 THEN []
      WHEN len(list_filter(s.open, lambda x: x.side = o.side AND x.ctx = o.ctx)) > 0 THEN [list_max(list_transform(list_filter(s.open, lambda x: x.side = o.side AND x.ctx = o.ctx), lambda x: x.a))]
      ELSE [list_max(list_transform(list_filter(s.open, lambda x: x.side = o.side AND x.ctx = list_min(list_transform(list_filter(s.open, lambda y: y.side = o.side), lambda y: y.ctx))), lambda x: x.a))] END AS gone
    FROM m_sim s JOIN m_op o ON o.lock = s.lock AND o.k = s.k + 1)),
m_life AS (SELECT p.ctx, p.lock, p.seq AS a, e.seq AS e FROM m_op p LEFT JOIN (SELECT seq, unnest(ended) AS a FROM m_sim) e ON e.a = p.seq WHERE p.kind = 'P'),
m_hold AS (SELECT m.seq, m.ctx, l.lock, l.a FROM mev m JOIN m_life l ON l.ctx = m.ctx AND l.a < m.seq AND (l.e IS NULL OR m.seq < l.e) WHERE m.kind NOT IN ('P', 'V')),
m_top AS (SELECT seq, ctx, max(a) AS top FROM m_hold GROUP BY ALL),
m_seen AS (SELECT seq, string_agg(lock, ',' ORDER BY a, lock) AS locks FROM (SELECT seq, lock, max(a) AS a FROM m_hold GROUP BY ALL) GROUP BY seq),
m_cut AS (SELECT ctx, a AS older, e AS cut FROM m_life WHERE e IS NOT NULL UNION ALL SELECT ctx, -1, seq FROM m_sim WHERE lost),
m_txn AS (SELECT t.seq, coalesce(max(c.cut), t.top) || ':' || t.top AS txn_id FROM m_top t LEFT JOIN m_cut c ON c.ctx = t.ctx AND c.older < t.top AND c.cut > t.top AND c.cut < t.seq GROUP BY t.seq, t.top)"""


STEPS = "SELECT m.seq, txn.txn_id, coalesce(seen.locks, '') AS locks FROM mev m LEFT JOIN m_txn txn ON txn.seq = m.seq LEFT JOIN m_seen seen ON seen.seq = m.seq WHERE m.kind NOT IN ('P', 'V')"
RAW_EVENTS = """
mev AS (
  SELECT seq, ctx::BIGINT AS ctx, kind, (ctx * 4 + k % 4 + 1)::BIGINT AS lock, CASE WHEN (k % 4) % 2 = 1 THEN 'r' ELSE 'w' END AS side, (k % 4) % 2 = 1 AS again FROM ev WHERE kind IN ('P', 'V')
  UNION ALL SELECT id, ctx, type, NULL, NULL, false FROM raw)"""
SQL["machine_raw"] = base(STEPS, simulated(RAW_EVENTS)).replace("WITH ", "WITH RECURSIVE ", 1)
SQL["machine_locks"] = base("SELECT raw.id AS seq, coalesce(string_agg(held.lock_id, ',' ORDER BY held.a), '') AS locks FROM raw LEFT JOIN held ON held.id = raw.id GROUP BY raw.id")
SQL["prefix_hits"] = base(
    """SELECT r.type_name, count(*) FILTER (regexp_matches(b.locks, '^(?:' || r.rule || ')')) AS positive, count(*) FILTER (NOT regexp_matches(b.locks, '^(?:' || r.rule || ')')) AS negative, count(*) FILTER (b.locks IS NULL) AS not_found
FROM rules r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type_name, access, member ORDER BY occurrences DESC, n_locks, locks DESC) AS k FROM sup) WHERE k = 1) b
  ON b.type_name = r.type_name AND b.access = r.access AND b.member = r.member GROUP BY 1""",
    CHECKED,
)

RULES = """SELECT s.type_name AS type, s.member, s.access AS accesstype, CASE WHEN s.locks = '' THEN '(no locks held)' ELSE s.locks END AS locks, CASE WHEN w.accepted = 1 THEN w.conflicts ELSE '' END AS conflictlist, s.occurrences, s.total,
  100 * s.percentage AS percentage, coalesce(w.accepted, 0) AS accepted, s.confidence,
  CASE WHEN s.occurrences = s.total THEN '' ELSE s.type_name || ' ' || s.access || ':' || s.member || ' CEX SEQ ' || CASE WHEN s.locks = '' THEN '(no locks held)' ELSE chr(39) || replace(s.locks, ' -> ', chr(39) || ' ' || chr(39)) || chr(39) END END AS parameters
FROM sup s LEFT JOIN won w ON w.type_name = s.type_name AND w.access = s.access AND w.member = s.member AND w.locks = s.locks WHERE s.set_occurrences / s.total >= 0.1"""
SQL |= {
    "rule_rows": base(RULES, MINED + f", won AS ({SQL['winners_lockset']})"),
    "rule_rows_of_winners": base(RULES + " AND w.accepted = 1", MINED + f", won AS ({SQL['winners_lockset']})"),
    "member_blacklist_added": base("SELECT * FROM (SELECT subclass_id, member_name_id FROM member_blacklist UNION SELECT 2, id FROM member_names WHERE name IN ('m2', 'm4'))"),
    "function_blacklist_added": base("SELECT subclass_id, member_name_id, fn, sequence FROM function_blacklist UNION ALL SELECT 3, NULL, 'fn2', NULL"),
    "function_blacklist_for_any": base("SELECT subclass_id, member_name_id, fn, sequence FROM function_blacklist UNION ALL SELECT NULL, NULL, f, NULL FROM (VALUES ('fn2'), ('fn4')) t(f)"),
    "counterexamples_of_types": f"SELECT * FROM ({base(EX, CEX_ONE)}) UNION ALL SELECT * FROM ({base(EX, CEX_TWO)})",
    "counterexample_tree": base(
        """SELECT array_to_string(fr[1:i], ' > ') AS path, array_to_string(fr[1:i-1], ' > ') AS parent, CAST(i AS INT) AS depth, CASE WHEN i = len(fr) THEN regexp_replace(h, '#[0-9]+$', '') END AS locks,
  sum(CASE WHEN i = len(fr) THEN CAST(regexp_extract(h, '#([0-9]+)$', 1) AS BIGINT) ELSE 0 END)::BIGINT AS n
FROM (SELECT *, unnest(range(1, len(fr) + 1)) AS i FROM (SELECT list_reverse(string_split(stacktrace, ',')) AS fr, unnest(string_split(locks_held, '+')) AS h FROM ex)) GROUP BY ALL""",
        CEX_ONE,
    ),
    "coverage_convert": inputs("SELECT '0x' || lower(hex(m.number)) AS basic_block, s.file, s.line FROM maps m JOIN src s ON s.p_partkey = m.number"),
    "coverage_preprocess": inputs("SELECT DISTINCT 'runs/' || (map % 3) || '/' || map || '.map' AS path, map || '.map' AS map, bb FROM maps"),
}

#: Blocks with their lines, and the lines that are looked for.
BLOCKS = """,
blk0 AS (SELECT file, line AS start, list(DISTINCT '/fs/inc/h' || (p_partkey % 50) || '.h') AS headers FROM src WHERE p_partkey % 3 = 0 GROUP BY ALL),
blk AS (SELECT file, start, unnest(list_concat([{'file': file, 'line': start - 2}, {'file': file, 'line': start}, {'file': file, 'line': start + 1}], list_transform(headers, lambda h: {'file': h, 'line': start % 9}))) AS x FROM blk0),
hits AS (
  SELECT file, line FROM src WHERE covered
  UNION SELECT CASE WHEN p_partkey % 2 = 0 THEN '/fs/inc/h' ELSE '/lib/h' END || (p_partkey % 70) || '.h', line % 11 FROM src WHERE covered),
floors AS (SELECT h.file, h.line, (SELECT max(b.start) FROM blk0 b WHERE b.file = h.file AND b.start <= h.line) AS start, h.file IN (SELECT file FROM blk0) AS known FROM hits h),
holders AS (SELECT x.file AS file, x.line AS line, min({'f': file, 's': start}) AS holder FROM blk GROUP BY ALL),
fnd AS (
  SELECT f.file, f.line, CASE WHEN start IS NOT NULL THEN f.file WHEN known OR f.file LIKE '/fs/inc/%' THEN holder.f END AS block_file, CASE WHEN start IS NOT NULL THEN start WHEN known OR f.file LIKE '/fs/inc/%' THEN holder.s END AS block_start,
    CASE WHEN start = f.line THEN 'start' WHEN start IS NOT NULL THEN 'floor' WHEN (known OR f.file LIKE '/fs/inc/%') AND holder IS NOT NULL THEN 'inside' END AS found
  FROM floors f LEFT JOIN holders h ON h.file = f.file AND h.line = f.line)"""
SQL |= {
    "coverage_blocks_of_hits": inputs("SELECT * FROM fnd", BLOCKS),
    "coverage_lines_of_hits": inputs(
        """SELECT file, sum(hit)::BIGINT AS covered, count(*) AS total, 100.0 * sum(hit) / count(*) AS percentage FROM (
  SELECT x.file AS file, x.line AS line, max(CASE WHEN EXISTS (SELECT 1 FROM fnd WHERE fnd.block_file = blk.file AND fnd.block_start = blk.start) THEN 1 ELSE 0 END) AS hit FROM blk GROUP BY ALL) GROUP BY 1""",
        BLOCKS,
    ),
}


def lcov_twin(name: str, lines: str, where: str = "true") -> str:
    return inputs(
        f"""SELECT l.name, l.lines, l.covered, 100.0 * l.covered / l.lines AS percentage, f.functions, f.covered_functions, 100.0 * f.covered_functions / f.functions AS function_percentage FROM ({lines}) l
JOIN (SELECT name, count(*) AS functions, count(*) FILTER (hits > 0) AS covered_functions FROM (
  SELECT name, fn, max(hits) AS hits FROM (SELECT {name} AS name, 'g' || (p_partkey % 7) AS fn, 0 AS hits FROM src UNION ALL SELECT {name}, 'f' || (p_partkey % 20), covered::INT FROM src) GROUP BY ALL) GROUP BY 1) f ON f.name = l.name
WHERE {where}"""
    )


def lcov_lines(name: str) -> str:
    return f"""SELECT name, count(*) AS lines, count(*) FILTER (hits > 0) AS covered FROM (
  SELECT {name} AS name, file, line, max(hits) AS hits FROM (SELECT file, line, covered::INT AS hits FROM src UNION ALL SELECT file, line + 1, 0 FROM src UNION ALL SELECT file, 0, p_partkey FROM src) GROUP BY ALL) GROUP BY 1"""


SQL |= {
    "lcov_by_file": lcov_twin("substr(file, 5)", lcov_lines("substr(file, 5)")),
    "lcov_by_directory": lcov_twin("regexp_replace(file, '/[^/]*$', '')", lcov_lines("regexp_replace(file, '/[^/]*$', '')")),
    "lcov_sums_of_files": lcov_twin("file", "SELECT file AS name, sum(3)::BIGINT AS lines, sum(covered::INT + 1)::BIGINT AS covered FROM src GROUP BY 1", "regexp_matches(l.name, 'Brand#[12]')"),
    # The scope of an address's length 64 is its part; the narrowest one that holds it comes first.
    "inlined_frames": inputs(
        """SELECT id AS stacktrace_id, row_number() OVER (PARTITION BY id ORDER BY frame, level DESC) - 1 AS sequence, ip AS instruction_ptr, function,
  CASE WHEN inner_file IS NULL THEN (SELECT p_brand || '.c' FROM part q WHERE q.p_partkey = pc // 64) ELSE inner_file END AS file,
  CASE WHEN inner_file IS NULL THEN (SELECT q.p_size * 4 + (pc % 64) // 16 FROM part q WHERE q.p_partkey = pc // 64) ELSE inner_line END AS line
FROM (SELECT f.*, s.function, s.level, lead(s.call_file) OVER w AS inner_file, lead(s.call_line) OVER w AS inner_line FROM frames f LEFT JOIN scopes s ON f.pc >= s.low AND f.pc < s.high WINDOW w AS (PARTITION BY f.id, f.frame ORDER BY s.level))""",
        """,
scopes AS (
  SELECT p_partkey * 64 AS low, p_partkey * 64 + 64 AS high, 0 AS level, 'f' || p_partkey AS function, NULL AS call_file, NULL AS call_line FROM part
  UNION ALL SELECT p_partkey * 64 + 8, p_partkey * 64 + 40, 1, 'in' || p_brand, 'c' || p_partkey, p_size FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey * 64 + 16, p_partkey * 64 + 24, 2, 'deep' || p_brand, 'd' || p_partkey, p_size + 1 FROM part WHERE p_size % 6 = 0),
frames AS (
  SELECT seq AS id, frame, ip, CASE WHEN frame = 0 THEN ip ELSE ip - 1 END AS pc
  FROM (SELECT seq, unnest([(user_id * 64 + k * 5) % 12000 + 32, (user_id * 37 + k * 64) % 12000 + 32, (user_id * 211 + k * 8) % 12000 + 32]) AS ip, unnest([0, 1, 2]) AS frame FROM ev))""",
    ),
}



def searches(settings: str) -> str:
    """A breadth-first search of each member under each setting, a node a step. `settings` are rows (setting, strategy, accept, reduction). CTEs num to won."""
    return f""",
setting AS (SELECT * FROM ({settings}) t(setting, strategy, accept, reduction)),
num AS (SELECT lock, row_number() OVER (ORDER BY seen) AS number FROM (
  SELECT lock, min({{'a': type_id, 'b': occurrences, 'c': members_accessed, 'd': locks_held, 'e': pos}}) AS seen
  FROM (SELECT *, unnest(string_split(locks_held, ',')) AS lock, generate_subscripts(string_split(locks_held, ','), 1) AS pos FROM obs WHERE locks_held <> '') GROUP BY lock)),
mem AS (SELECT row_number() OVER (ORDER BY type_name, access, member) AS m, * FROM tot),
ords AS (
  SELECT h.type_name, h.access, h.member, h.locks, h.occurrences, coalesce(list(n.number ORDER BY h.pos) FILTER (n.number IS NOT NULL), []) AS ord
  FROM (SELECT *, unnest(CASE WHEN len(locks) = 0 THEN [''] ELSE locks END) AS lock, generate_subscripts(CASE WHEN len(locks) = 0 THEN [''] ELSE locks END, 1) AS pos FROM hyp) h LEFT JOIN num n ON n.lock = h.lock GROUP BY ALL),
rep AS (SELECT * FROM (SELECT *, list_sort(ord) AS s, row_number() OVER (PARTITION BY type_name, access, member, list_sort(ord) ORDER BY occurrences DESC, ord) AS k FROM ords) WHERE k = 1),
node AS (
  SELECT m.m, row_number() OVER (PARTITION BY m.m ORDER BY s) AS id, s, len(s) AS size, occurrences / total AS share, array_to_string(r.locks, ' -> ') AS locks, m.total, m.with_locks
  FROM rep r JOIN mem m ON m.type_name = r.type_name AND m.access = r.access AND m.member = r.member),
kid AS (SELECT p.m, p.id, list(c.id ORDER BY c.id) AS kids FROM node c JOIN node p ON p.m = c.m AND p.size = c.size - 1 AND (p.s = c.s[:-2] OR p.s = c.s[2:]) GROUP BY ALL),
fam AS (SELECT n.*, coalesce(k.kids, []) AS kids FROM node n LEFT JOIN kid k ON k.m = n.m AND k.id = n.id),
hunt AS (
  SELECT t.setting, t.strategy, t.accept, t.reduction, f.m, 0::BIGINT AS best_size, CASE WHEN strategy = 'topdown' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS best,
    CASE WHEN strategy = 'topdown' AND (total - with_locks) / total < 0.05 THEN [] ELSE [f.id] END AS found, CASE WHEN strategy = 'topdown' AND (total - with_locks) / total >= 0.05 THEN [] ELSE f.kids END AS queue
  FROM setting t, fam f WHERE f.size = 0
  UNION ALL
  SELECT setting, strategy, accept, reduction, m, CASE WHEN wins THEN size ELSE best_size END, CASE WHEN wins THEN share ELSE best END,
    CASE WHEN wins THEN [id] WHEN same AND NOT list_contains(found, id) THEN list_append(found, id) ELSE found END, CASE WHEN wins OR same THEN list_concat(queue[2:], kids) ELSE queue[2:] END
  FROM (
    SELECT *, same0 AND len(found) > 0 AS same, better OR (same0 AND len(found) = 0) AS wins FROM (
      SELECT h.*, f.id, f.size, f.share, f.kids,
        CASE strategy WHEN 'lockset' THEN share >= 1.0 AND size = best_size ELSE size = best_size AND share = best END AS same0,
        CASE strategy
          WHEN 'bottomup' THEN NOT (size = best_size AND share = best) AND ((accept <= share AND share < best) OR (size > best_size AND share = best))
          WHEN 'sharpen' THEN (size = best_size AND share > best) OR (size > best_size AND (share = best OR 1.0 - share / best <= reduction))
          WHEN 'lockset' THEN share >= 1.0 AND size > best_size
          ELSE NOT (size = best_size AND share = best) AND share >= accept AND share >= best AND size >= best_size END AS better
      FROM hunt h JOIN fam f ON f.m = h.m AND f.id = h.queue[1] WHERE len(h.queue) > 0))),
done AS (SELECT setting, m, unnest(found) AS id, generate_subscripts(found, 1) AS k, found FROM hunt WHERE len(queue) = 0),
won AS (
  SELECT d.setting, mem.type_name, mem.access, mem.member, f.locks, CASE WHEN d.k = 1 THEN 1 ELSE 2 END AS accepted,
    coalesce((SELECT string_agg(o.locks, ',' ORDER BY x.k) FROM done x JOIN fam o ON o.m = x.m AND o.id = x.id WHERE x.setting = d.setting AND x.m = d.m AND x.k <> d.k), '') AS conflicts
  FROM done d JOIN fam f ON f.m = d.m AND f.id = d.id JOIN mem ON mem.m = d.m)"""


def hunted(select: str, settings: str, before: str = MINED) -> str:
    return base(select, before + searches(settings)).replace("WITH ", "WITH RECURSIVE ", 1)


ONE = {s: f"VALUES (0, '{s}', 0.9::DOUBLE, 0.05::DOUBLE)" for s in ("bottomup", "sharpen", "topdown")}
GRID = """SELECT 10 - k, 'sharpen', 0.9::DOUBLE, k / 100.0 FROM range(0, 11) a(k) UNION ALL SELECT 11 + k, 'bottomup', (100 - k / 2.0) / 100.0, 0.05::DOUBLE FROM range(0, 21) b(k)
UNION ALL SELECT 32 + k, 'topdown', (100 - k / 2.0) / 100.0, 0.05::DOUBLE FROM range(0, 21) c(k) UNION ALL SELECT 53, 'lockset', 0.9::DOUBLE, 0.05::DOUBLE"""
HITS = "EXISTS (SELECT 1 FROM won w WHERE w.type_name = r.type_name AND w.access = r.access AND w.member = r.member AND regexp_full_match(w.locks, r.rule))"
SQL |= {f"winners_{s}": hunted("SELECT type_name, access, member, locks, accepted, conflicts FROM won", rows) for s, rows in ONE.items()}
SQL |= {
    "winner_check_sharpen": hunted(
        f"""SELECT coalesce(type_name, 'total') AS type_name, count(*) AS observed, sum(hit)::BIGINT AS matched, 100.0 * sum(hit) / count(*) AS percentage, count(*) FILTER (access = 'r') AS observed_r, coalesce(sum(hit) FILTER (access = 'r'), 0)::BIGINT AS matched_r,
  count(*) FILTER (access = 'w') AS observed_w, coalesce(sum(hit) FILTER (access = 'w'), 0)::BIGINT AS matched_w
FROM (SELECT r.*, CASE WHEN {HITS} THEN 1 ELSE 0 END AS hit FROM rules r JOIN tot t ON t.type_name = r.type_name AND t.access = r.access AND t.member = r.member) GROUP BY ROLLUP (type_name)""",
        ONE["sharpen"],
        CHECKED,
    ),
    "strategy_sweep": hunted(
        """SELECT setting, observed, matched, 100.0 * matched / observed AS percentage FROM (
  SELECT s.setting, count(*) AS observed, count(*) FILTER (EXISTS (SELECT 1 FROM won w WHERE w.setting = s.setting AND w.type_name = r.type_name AND w.access = r.access AND w.member = r.member AND regexp_full_match(w.locks, r.rule))) AS matched
  FROM (SELECT DISTINCT setting FROM won) s, rules r JOIN tot t ON t.type_name = r.type_name AND t.access = r.access AND t.member = r.member GROUP BY 1)""",
        GRID,
        CHECKED,
    ),
    "mining_stats": hunted(
        """SELECT dt.name AS type_name, l.members, coalesce(b.observed, 0) AS observed, coalesce(b.rules_r, 0) AS rules_r, coalesce(b.rules_w, 0) AS rules_w, coalesce(b.no_lock_r, 0) AS no_lock_r, coalesce(b.no_lock_w, 0) AS no_lock_w
FROM data_types dt JOIN (SELECT data_type_id, count(DISTINCT member_name_id) AS members FROM structs_layout GROUP BY 1) l ON l.data_type_id = dt.id LEFT JOIN (
  SELECT type_name, count(DISTINCT member) AS observed, count(*) FILTER (access = 'r') AS rules_r, count(*) FILTER (access = 'w') AS rules_w, count(*) FILTER (access = 'r' AND locks = '') AS no_lock_r, count(*) FILTER (access = 'w' AND locks = '') AS no_lock_w
  FROM won WHERE accepted = 1 GROUP BY 1) b ON b.type_name = dt.name""",
        ONE["sharpen"],
    ),
    "protected_members": hunted("SELECT type_name, locks, string_agg(access || ':' || member, ',' ORDER BY access || ':' || member) AS members FROM won WHERE accepted = 1 GROUP BY ALL", ONE["sharpen"]),
    "atomic_evaluation": hunted(
        """SELECT a.type_name, count(DISTINCT a.member) AS atomics, count(w.locks) AS found, count(*) FILTER (w.locks <> '') AS locked, count(*) FILTER (w.locks = '') AS not_locked
FROM (SELECT dt.name AS type_name, mn.name AS member FROM structs_layout l JOIN data_types dt ON dt.id = l.data_type_id JOIN member_names mn ON mn.id = l.member_name_id WHERE l.data_type_name LIKE 'atomic%') a
LEFT JOIN (SELECT * FROM won WHERE accepted = 1) w ON w.type_name = a.type_name AND w.member = a.member GROUP BY 1""",
        ONE["topdown"],
    ),
}

#: The catalog from parts, suppliers and line items.
CATALOG = r"""
prt AS (SELECT p_partkey::BIGINT AS k, p_size, lower(p_type) || '_' || substr(p_brand, 7) AS type_name FROM part),
typ AS (SELECT row_number() OVER (ORDER BY type_name) AS id, type_name AS name FROM (SELECT DISTINCT type_name FROM prt)),
mbr AS (SELECT prt.*, typ.id AS data_type_id FROM prt JOIN typ ON typ.name = prt.type_name),
sub AS (SELECT id * 10 AS id, id AS data_type_id, NULL AS name FROM typ WHERE id % 3 = 0 UNION ALL SELECT id * 10 + 1, id, 'a' FROM typ WHERE id % 3 > 0 UNION ALL SELECT id * 10 + 2, id, 'b' FROM typ WHERE id % 3 > 0),
lay AS (SELECT data_type_id, CASE p_size % 10 WHEN 0 THEN 'atomic_t' WHEN 1 THEN 'atomic64_t' WHEN 2 THEN 'atomic_long_t' ELSE 'int' END AS data_type_name, k AS member_name_id, 16 * k AS byte_offset, p_size % 13 + 4 AS size FROM mbr),
layf AS (SELECT data_type_id, member_name_id, byte_offset, unnest(range(byte_offset, byte_offset + size)) AS helper_offset FROM lay),
alc AS (SELECT s_suppkey::BIGINT AS id, CASE WHEN (s_suppkey % 20 + 1) % 3 = 0 THEN (s_suppkey % 20 + 1) * 10 ELSE (s_suppkey % 20 + 1) * 10 + 1 + s_suppkey % 2 END AS subclass_id, (s_suppkey::BIGINT + 1) * 4294967296 AS base FROM supplier),
lck AS (SELECT s * 4294967296 + p AS id, (s + 1) * 4294967296 + 16 * p + p % 3 * 2 AS address, s AS alloc_id, CASE WHEN p % 2 = 0 THEN 'w' ELSE 'r' END AS sub_lock FROM (SELECT DISTINCT l_suppkey::BIGINT AS s, l_partkey::BIGINT AS p FROM lineitem)),
mbl AS (SELECT CASE WHEN data_type_id % 3 = 0 THEN data_type_id * 10 ELSE data_type_id * 10 + 1 END AS subclass_id, k AS member_name_id FROM mbr WHERE p_size = 7),
fbl AS (SELECT CASE WHEN data_type_id % 3 = 0 THEN data_type_id * 10 ELSE data_type_id * 10 + 2 END AS subclass_id, CASE WHEN k % 2 = 0 THEN k END AS member_name_id, 'fn' || (k % 50) AS fn, CASE WHEN k % 3 > 0 THEN k % 4 END AS sequence FROM mbr WHERE p_size = 9)"""


def catalog(select: str) -> str:
    return f"WITH {CATALOG.strip()}\n{select}"


SQL |= {
    "layout_flat": catalog("SELECT * FROM layf"),
    "locks_embedded_flat": catalog("SELECT l.id AS lock_id, l.sub_lock, l.alloc_id, a.subclass_id, s.data_type_id, f.member_name_id FROM lck l JOIN alc a ON a.id = l.alloc_id JOIN sub s ON s.id = a.subclass_id JOIN layf f ON f.data_type_id = s.data_type_id AND f.helper_offset = l.address - a.base"),
    "type_members": catalog("SELECT CASE WHEN s.name IS NULL THEN t.name ELSE t.name || ':' || s.name END AS type_name, count(DISTINCT l.member_name_id) AS members FROM sub s JOIN typ t ON t.id = s.data_type_id JOIN lay l ON l.data_type_id = t.id GROUP BY 1"),
    "blacklisted_members": catalog("SELECT subclass_id, count(*) AS n FROM mbl GROUP BY 1"),
    "atomic_members": catalog("SELECT t.name AS type_name, 'm' || l.member_name_id AS member, l.byte_offset FROM lay l JOIN typ t ON t.id = l.data_type_id WHERE l.data_type_name <> 'int'"),
    "lock_addresses": catalog("SELECT id AS lock_id, hex(address) AS address_hex, hex(address >> 8) AS page_hex FROM lck"),
    "member_blacklist_added": catalog("SELECT * FROM mbl UNION SELECT s.id, k FROM sub s JOIN typ t ON t.id = s.data_type_id, prt WHERE t.name = 'economy_11' AND s.name = 'a' AND k IN (2, 4, 9)"),
    "function_blacklist_added": catalog("SELECT * FROM fbl UNION ALL SELECT s.id, NULL, 'fn2', NULL FROM sub s JOIN typ t ON t.id = s.data_type_id WHERE t.name = 'economy_12' AND s.name = 'b'"),
    "function_blacklist_for_any": catalog("SELECT * FROM fbl UNION ALL SELECT NULL, NULL, f, NULL FROM (VALUES ('fn2'), ('fn4')) t(f)"),
    "blacklists_expanded": catalog(
        """SELECT CASE WHEN k % 4 = 3 THEN NULL ELSE s.id END AS subclass_id, CASE WHEN k % 5 = 0 THEN k END AS member_name_id, 'fn' || (k % 50) AS fn, k % 4 AS sequence
FROM mbr m LEFT JOIN sub s ON s.data_type_id = m.data_type_id AND (k % 4 = 0 OR (k % 4 = 1 AND s.name = 'a'))
WHERE p_size = 11 AND k % 5 <> 1 AND (k % 4 = 3 OR s.id IS NOT NULL)"""
    ),
}
SQL["run_statistics"] = base(
    """SELECT 'events' AS topic, p AS param, count(*) FILTER (q = kind OR q = '') AS value FROM ev, (VALUES ('acquire', 'P'), ('release', 'V'), ('read', 'r'), ('write', 'w'), ('total', '')) t(p, q) GROUP BY 1, 2
UNION ALL SELECT 'locks', p, count(*) FILTER (q IS NULL OR q = (embedded_in IS NULL)) FROM locks, (VALUES ('static', true), ('dynamic', false), ('total', NULL)) t(p, q) GROUP BY 1, 2
UNION ALL SELECT 'accesses', 'total', count(*) FROM accesses"""
)
SQL["coverage_series_beyond"] = inputs(
    """SELECT p.map, p.t - min(p.t) OVER () AS t, p.current, p.current_subset, sum(coalesce(n.new, 0)) OVER w AS aggregate, sum(coalesce(n.new_subset, 0)) OVER w AS aggregate_subset, sum(coalesce(n.beyond, 0)) OVER w AS aggregate_beyond
FROM p LEFT JOIN n ON n.map = p.map WINDOW w AS (ORDER BY p.t, p.map ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    """,
u AS (SELECT map, bb, min(t) AS t, (number < 100)::INT AS inside, (number < 100 AND bb NOT IN (SELECT bb FROM maps WHERE map % 7 = 0))::INT AS beyond FROM maps GROUP BY map, bb, number),
p AS (SELECT map, min(t) AS t, count(*) AS current, sum(inside) AS current_subset FROM u GROUP BY map),
f AS (SELECT u.bb, u.inside, u.beyond, first(u.map ORDER BY p.t, p.map) AS map FROM u JOIN p ON p.map = u.map GROUP BY ALL),
n AS (SELECT map, count(*) AS new, sum(inside) AS new_subset, sum(beyond) AS beyond FROM f GROUP BY map)""",
)
SQL["coverage_unknown_pcs"] = inputs("SELECT part, count(*) AS pcs, count(*) FILTER (addr NOT IN (SELECT addr FROM ins WHERE k3 > 0)) AS unknown FROM (SELECT part, addr FROM ins WHERE is_pc) GROUP BY 1".replace("ins WHERE k3 > 0", "ins WHERE line % 3 > 0"))
SQL["hypotheses_of_chosen"] = base("SELECT * FROM sup WHERE type_name LIKE 'no%' AND (member = 'm0' OR (access = 'w' AND member = 'm1'))", MINED)
SQL["read_only_ratio"] = hunted("SELECT r.type_name, count(*) AS read_only, count(*) FILTER (w.locks = '') AS no_lock FROM rules r LEFT JOIN (SELECT * FROM won WHERE accepted = 1) w ON w.type_name = r.type_name AND w.access = r.access AND w.member = r.member WHERE r.access = 'r' AND r.member <> 'm2' GROUP BY 1", ONE["bottomup"], CHECKED)

#: Counterexamples of the rules of a table (rls): every way to place a rule's locks on those that a transaction holds, lock by lock.
OF_RULES = "," + described(True).replace("lk AS", "lks AS") + r""",
rl AS (SELECT row_number() OVER (ORDER BY type_name, member, access, locks) AS r, type_name, member, access, locks, string_split(locks, ' -> ') AS ls FROM rls WHERE locks NOT LIKE '%?%'),
pt AS (
  SELECT r, k, CASE WHEN l LIKE 'EMBSAME(%' THEN 'same' WHEN l LIKE 'EMBOTHER(%' THEN 'other' ELSE 'id' END AS kind, regexp_extract(l, '\[([rw])\]', 1) AS side,
    regexp_extract(l, '^EMB[A-Z]+\((\w+)\.(\w+)\[', 1) AS t, regexp_extract(l, '^EMB[A-Z]+\((\w+)\.(\w+)\[', 2) AS m, TRY_CAST(regexp_extract(l, '^(\w+:)?([0-9]+)\(', 2) AS INT) AS id
  FROM (SELECT r, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM rl)),
ca AS (
  SELECT p.r, p.k, p.kind, b.id AS lock_id, NULL::BIGINT AS owner FROM pt p JOIN locks a ON a.id = p.id JOIN locks b ON b.address = a.address AND (p.side = 'r' OR b.id = a.id) WHERE p.kind = 'id'
  UNION ALL SELECT p.r, p.k, p.kind, e.lock_id, e.alloc_id FROM pt p JOIN data_types d ON d.name = p.t JOIN member_names m ON m.name = p.m JOIN emb e ON e.data_type_id = d.id AND e.member_name_id = m.id AND (e.sub_lock = 'w' OR p.side = 'r')),
fr AS (SELECT rl.r, f.ac_id, f.txn_id, f.alloc_id, f.stacktrace_id FROM flat f JOIN data_types d ON d.id = f.data_type_id JOIN member_names m ON m.id = f.member_name_id JOIN rl ON rl.type_name = d.name AND rl.member = m.name AND rl.access = f.ac_type),
wk AS (
  SELECT r, ac_id, txn_id, alloc_id, 0::BIGINT AS k, -1::BIGINT AS start FROM fr
  UNION ALL SELECT w.r, w.ac_id, w.txn_id, w.alloc_id, w.k + 1, h.start FROM wk w JOIN ca ON ca.r = w.r AND ca.k = w.k + 1 JOIN locks_held h ON h.txn_id = w.txn_id AND h.lock_id = ca.lock_id AND (h.start > w.start OR NOT ORDERED)
  WHERE ca.kind = 'id' OR (ca.kind = 'same' AND ca.owner = w.alloc_id) OR (ca.kind = 'other' AND ca.owner <> w.alloc_id)),
bad AS (SELECT * FROM fr WHERE NOT EXISTS (SELECT 1 FROM wk JOIN rl ON rl.r = wk.r AND wk.k = len(rl.ls) WHERE wk.r = fr.r AND wk.ac_id = fr.ac_id)),
plc AS (
  SELECT b.r, b.ac_id, b.stacktrace_id, coalesce(string_agg(CASE WHEN q.embedded_in IS NULL THEN q.own WHEN q.embedded_in = b.alloc_id THEN 'EMBSAME' || q.place ELSE 'EMB:' || q.lock_id || q.place END || '@' || lh.last_file || ':' || lh.last_line, ',' ORDER BY lh.start, lh.lock_id), 'nolocks') AS locks
  FROM bad b LEFT JOIN locks_held lh ON lh.txn_id = b.txn_id LEFT JOIN lks q ON q.lock_id = lh.lock_id GROUP BY b.r, b.ac_id, b.stacktrace_id),
tr AS (SELECT id, string_agg('0x' || hex(instruction_ptr) || '@' || function || '@' || file || ':' || line, ',' ORDER BY sequence) AS stacktrace FROM stacktraces GROUP BY id),
cex AS (
  SELECT rl.type_name AS data_type, rl.member, rl.access AS accesstype, rl.locks AS rule, c.stacktrace_id, tr.stacktrace, string_agg(c.locks || '#' || c.n, '+' ORDER BY c.n DESC, c.locks DESC) AS locks_held, sum(c.n)::BIGINT AS n
  FROM (SELECT r, stacktrace_id, locks, count(*) AS n FROM plc GROUP BY ALL) c JOIN tr ON tr.id = c.stacktrace_id JOIN rl ON rl.r = c.r GROUP BY ALL),
nod AS (
  SELECT *, list_transform(list_reverse(string_split(stacktrace, ',')), lambda x: string_split(x, '@')[2] || '_' || string_split(x, ':')[-1]) AS fr FROM cex),
way AS (SELECT DISTINCT data_type, member, accesstype, fr FROM nod WHERE len(fr) > 1),
lea AS (SELECT data_type, member, accesstype, count(*) AS leaves FROM way w WHERE NOT EXISTS (SELECT 1 FROM way s WHERE s.data_type = w.data_type AND s.member = w.member AND s.accesstype = w.accesstype AND len(s.fr) < len(w.fr) AND w.fr[1:len(s.fr)] = s.fr) GROUP BY ALL)"""



def of_rules(select: str, rows: str = "top") -> str:
    """In order: each lock later than the one before it."""
    more = OF_RULES.replace(" OR NOT ORDERED", "")
    return base(select, TOP + f", rls AS (SELECT type_name, member, access, locks, occurrences, total, percentage FROM {rows})" + more).replace("WITH ", "WITH RECURSIVE ", 1)


REPORTED = "(SELECT * FROM sup WHERE n_locks > 0 AND set_occurrences / total >= 0.1)"
CEX = "SELECT data_type, member, accesstype, rule, stacktrace_id, stacktrace, locks_held FROM cex"
SQL |= {
    "counterexamples_of_top_rules": of_rules(CEX),
    "counterexamples_of_all_rules": of_rules(CEX, REPORTED),
    # Only locks in other allocations must come one after the other; the walk carries the start of the last of these.
    "examples_of_all_rules_any_order": of_rules(CEX, REPORTED)
    .replace("w.k + 1, h.start FROM", "w.k + 1, CASE WHEN ca.kind = 'other' THEN h.start ELSE w.start END FROM")
    .replace("AND (h.start > w.start)", "AND (h.start > w.start OR ca.kind <> 'other')")
    .replace("bad AS (SELECT * FROM fr WHERE NOT EXISTS", "bad AS (SELECT * FROM fr WHERE EXISTS"),
    "counterexample_graph": of_rules(
        """SELECT DISTINCT data_type, member, accesstype, CASE WHEN i = 1 THEN '' ELSE fr[i - 1] END AS caller, fr[i] AS callee, NULL::VARCHAR AS locks, 0::BIGINT AS n FROM (SELECT *, unnest(range(1, len(fr) + 1)) AS i FROM way)
UNION ALL SELECT data_type, member, accesstype, NULL, fr[-1], regexp_replace(h, '#[0-9]+$', ''), sum(CAST(regexp_extract(h, '#([0-9]+)$', 1) AS BIGINT))::BIGINT FROM (SELECT *, unnest(string_split(locks_held, '+')) AS h FROM nod WHERE len(fr) > 1) GROUP BY ALL"""
    ),
    "counterexample_report": of_rules(
        """SELECT c.data_type, c.member, c.accesstype, w.locks AS rule, w.occurrences, w.total, 100 * w.percentage AS percentage, c.traces, c.violations, coalesce(l.leaves, 0) AS leaves, CASE WHEN l.leaves > 7 THEN 'graph' ELSE 'tree' END AS form
FROM (SELECT data_type, member, accesstype, count(DISTINCT stacktrace) AS traces, sum(n)::BIGINT AS violations FROM cex GROUP BY ALL) c
JOIN rls w ON w.type_name = c.data_type AND w.member = c.member AND w.access = c.accesstype LEFT JOIN lea l ON l.data_type = c.data_type AND l.member = c.member AND l.accesstype = c.accesstype"""
    ),
}
