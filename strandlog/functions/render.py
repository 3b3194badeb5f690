"""Text forms of small, bounded results: rule reports, call graphs, counterexample pages. Inputs are collected rows."""

from __future__ import annotations

import html
import struct
import zlib
from collections.abc import Iterable


def dot_graph(edges: Iterable[tuple[str, str, int]]) -> str:
    body = "".join(f'  "{a}" -> "{b}" [label="{n}"];\n' for a, b, n in sorted(edges))
    return f"digraph calls {{\n{body}}}\n"


def rule_report(rows: Iterable[tuple[str, str, str, str, int, int, int]]) -> str:
    """(type, access, member, locks, occurrences, total, accepted) as text; ! marks winners, ? their equals."""
    out, last = [], None
    for t, a, m, locks, n, total, accepted in rows:
        if (t, a, m) != last:
            out.append(f"{t} {a}:{m} ({total} accesses)")
            last = (t, a, m)
        out.append(f"  {'!' if accepted == 1 else '?' if accepted == 2 else ' '} {100 * n / total:6.2f}% {n:8d} {locks or '(no locks held)'}")
    return "\n".join(out) + "\n"


def counterexample_page(title: str, rows: Iterable[tuple[str, str]]) -> str:
    """(stack trace, locks#n+...) as a plain page, the outermost frame first."""
    items = []
    for trace, locks in rows:
        frames = "".join(f"<li>{html.escape(f)}</li>" for f in reversed(trace.split(",")))
        held = "".join(f"<li>{html.escape(x.rpartition('#')[2])} &times; {html.escape(x.rpartition('#')[0])}</li>" for x in locks.split("+"))
        items.append(f"<section><ol>{frames}</ol><ul>{held}</ul></section>")
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(items)}"


def table_page(names: list[str], rows: Iterable[tuple]) -> str:
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + row(names, "th") + "".join(row(r, "td") for r in rows) + "</table>"


def euler_input(overlaps: Iterable[tuple[str, int]]) -> str:
    """(suites joined by &, size of their overlap) as the named numbers that an Euler diagram is fitted to."""
    return "c(\n" + ",\n".join(f"'{name}' = {n}" for name, n in sorted(overlaps, key=lambda x: (x[0].count("&"), x[0]))) + "\n)\n"


def png_image(side: int, cells: Iterable[tuple[int, int, tuple[int, int, int]]]) -> bytes:
    """A square image of coloured cells (x, y, red green blue) on white."""
    rows = [bytearray(b"\xff" * (3 * side)) for _ in range(side)]
    for x, y, colour in cells:
        rows[y][3 * x : 3 * x + 3] = bytes(colour)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")
