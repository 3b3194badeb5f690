"""Documented rules for the derived trace's types, as text: the fixture that evaluation queries score against."""

from __future__ import annotations

#: type, access, member, rule (a regular expression over a hypothesis' locks).
RULES = (
    ("node", "r", "m0", r"EMBSAME\(node\.m_lock\[[rw]\]\)"),
    ("node", "w", "m0", r"EMBSAME\(node\.m_lock\[w\]\)"),
    ("node", "r", "m1", r"glock[0-9]:[0-9]+\(mutex\[w\]\)"),
    ("node", "w", "m1", r"glock0:1\(mutex\[w\]\)"),
    ("node", "r", "m2", r".* -> .*"),
    ("buf", "r", "m0", r"[0-9]+\(rcu\[r\]\)"),
    ("buf", "w", "m3", r""),
    ("buf", "w", "m9", r"EMBOTHER\(node\.m_lock\[w\]\)"),
)


def rules(spark):
    return spark.createDataFrame(list(RULES), "type_name string, access string, member string, rule string")
