"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def measures(text):
    text = text or ""
    ws = words(text)
    seen = {}
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(5)}
    lines, dup, known = text.split("\n"), 0, set()
    for line in lines:
        if words(line):
            dup += line in known
            known.add(line)
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def substrings(rows, window):
    """rows: (doc_id, text); the first occurrence by (doc_id, start) stays."""
    last = float("inf")
    first = {}
    for doc_id, text in rows:
        ws = words(text)
        for i in range(len(ws) - window + 1):
            key, at = tuple(ws[i : i + window]), (last if doc_id is None else doc_id, i)
            first[key] = min(first.get(key, at), at)
    out = []
    for doc_id, text in rows:
        ws = words(text)
        gone = {i + j for i in range(len(ws) - window + 1) if first[tuple(ws[i : i + window])] != (last if doc_id is None else doc_id, i) for j in range(window)}
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc_id, len(ws), len(gone), sha(kept), kept))
    return out


def shingles(text):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def roots(vertices, links):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


def near_groups(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return {i: (i, len(sets[i]), root[i], root[i] == i) for i in sets}


BASE = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
]


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            if kind == "assign" and len(m[2]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24:
                out.append((m.start(), order, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]
