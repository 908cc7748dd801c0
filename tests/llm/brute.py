"""Plain versions of the operators, on lists, for small inputs."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash


def fingerprint(text: str, words: int = 3) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    parts = [p for p in re.split(r"[\x20\x09-\x0D]+", lowered) if p]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def components(nodes: dict[int, list[int]], linked) -> dict[int, int]:
    """Smallest member's value per node; `nodes` gives the values of each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    names = list(nodes)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if linked(a, b):
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for n, values in nodes.items():
        r = find(n)
        least[r] = min([least.get(r, 2**63), *values])
    return {n: least[find(n)] for n in nodes}


def units(text: str) -> list[tuple[int, int]]:
    """Spans: lines, cut behind sentences once five words are together."""
    out, at = [], 0
    for line in text.split("\n"):
        begin, i = 0, 0
        while i < len(line):
            end_mark = line[i] in ".!?" and (i + 1 == len(line) or line[i + 1].isspace())
            i += 1
            if not end_mark:
                continue
            while i < len(line) and line[i].isspace():
                i += 1
            if len(line[begin:i].split()) >= 5:
                out.append((at + begin, at + i))
                begin = i
        if line[begin:].split():
            out.append((at + begin, at + len(line)))
        at += len(line) + 1
    return out


def line_repeats(docs: list[tuple[int, str]], run_words: int = 20) -> dict[int, list[tuple[int, int]]]:
    """Removed spans per document id."""
    first: dict[str, tuple[int, int]] = {}
    spans = {i: units(t or "") for i, t in docs}
    norm = lambda t, s: " ".join(t[s[0] : s[1]].lower().split())
    for i, t in sorted(docs, key=lambda d: d[0]):
        for n, s in enumerate(spans[i]):
            first.setdefault(norm(t, s), (i, n))
    out = {}
    for i, t in docs:
        late = [first[norm(t, s)] != (i, n) for n, s in enumerate(spans[i])]
        gone, at = [], 0
        while at < len(late):
            end = at
            while end < len(late) and late[end]:
                end += 1
            run = spans[i][at:end]
            if sum(len(t[a:z].split()) for a, z in run) >= run_words:
                gone += range(at, end)
            at = max(end, at + 1)
        # A line goes if all its units are repeats.
        lines: dict[int, list[int]] = {}
        for n, s in enumerate(spans[i]):
            lines.setdefault(t.count("\n", 0, s[0]), []).append(n)
        gone = sorted({*gone, *(n for ns in lines.values() if all(late[n] for n in ns) for n in ns)})
        out[i] = []
        for n in gone:
            if n - 1 in gone:
                out[i][-1] = (out[i][-1][0], spans[i][n][1])
            else:
                out[i].append(spans[i][n])
    return out


def feistel(value: str, key: str, digits=(48, 10), letters: int = 26) -> str:
    """Letters and digits of a value, halves shifted in turns."""
    plain = re.sub("[^A-Za-z0-9]", "", value)
    moved, other = plain[: len(plain) // 2], plain[len(plain) // 2 :]
    for r in range(8):
        d = hashlib.sha256(f"{key}|{r}|{other}".encode()).hexdigest()
        new = ""
        for i, c in enumerate(moved):
            by = int(d[(i % 16) * 4 : (i % 16) * 4 + 4], 16)
            base, size = (
                digits if c.isdigit() else (97, letters) if c.islower() else (65, letters)
            )
            new += chr(base + (ord(c) - base + by) % size)
        moved, other = other, new
    left = iter(moved + other)
    return "".join(next(left) if re.match("[A-Za-z0-9]", c) else c for c in value)


def ssn(value: str, key: str) -> str:
    """The valid numbers as pairs of area with group and serial, shifted in turns."""
    areas = [a for a in range(1, 900) if a != 666]
    area, group, serial = map(int, value.split("-"))
    high, low = areas.index(area) * 99 + group - 1, serial - 1

    def shift(r: int, other: int) -> int:
        return int(hashlib.sha256(f"{key}|{r}|{other}".encode()).hexdigest()[:8], 16)

    for r in range(4):
        high = (high + shift(2 * r, low)) % (len(areas) * 99)
        low = (low + shift(2 * r + 1, high)) % 9999
    return f"{areas[high // 99]:03d}-{high % 99 + 1:02d}-{low + 1:04d}"


def luhn_valid(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", number))):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def nearest(ids: list[int], vectors: np.ndarray, query: int, k: int) -> list[tuple[int, float]]:
    far = np.sqrt(((vectors - vectors[ids.index(query)]) ** 2).sum(axis=1))
    return sorted(((float(d), i) for d, i in zip(far, ids) if i != query))[:k]
