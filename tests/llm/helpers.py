"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, k: int = 5) -> set:
    w = WORD.findall(lower(text or ""))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near(a: set, b: set, percent: int = 75) -> bool:
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def groups(ids: list, linked) -> dict:
    """Least id reachable, over linked(i, j) of positions."""
    head = list(range(len(ids)))

    def root(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if ids[i] == ids[j] or linked(i, j):
                head[root(i)] = root(j)
    least: dict = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(x, least.get(root(i), x))
    return {x: least[root(i)] for i, x in enumerate(ids)}


def kept_lines(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, str | None]:
    """Text of each (id, text) without lines that come after a near-equal one; lines without words stay."""
    lines = [(i, n, line) for i, t in sorted(rows, key=lambda r: r[0]) if t is not None for n, line in enumerate(t.split("\n"))]
    seen: list[set] = []
    out: dict[int, list[str]] = {i: [] for i, t in rows if t is not None}
    for i, _, line in lines:
        s = shingles(line)
        if not any(near(s, o, percent) for o in seen):
            out[i].append(line)
        if s:
            seen.append(s)
    return {i: None if t is None else "\n".join(out[i]) for i, t in rows}


def cut_spans(rows: list[tuple[int, str | None]], span: int = 50) -> dict[int, tuple[int, int, int, bytes]]:
    first: dict[bytes, int] = {}
    out = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        on, own = bytearray(len(b)), []
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            if first.get(w, i) < i:
                on[p : p + span] = b"\1" * span
            own.append(w)
        for w in own:
            first.setdefault(w, i)
        runs = sum(on[p] and not (p and on[p - 1]) for p in range(len(b)))
        out[i] = (len(b), sum(on), runs, bytes(x for x, o in zip(b, on) if not o))
    return out
