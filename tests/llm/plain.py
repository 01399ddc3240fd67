"""Plain-Python versions of what the contracts ask for, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable

import numpy as np

_UPPER = {c: c + 32 for c in range(65, 91)}
_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text: str | None) -> str:
    return (text or "").translate(_UPPER)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shingles(text: str | None, width: int) -> frozenset[tuple[str, ...]]:
    words = _SPACED.findall(low(text))
    return frozenset([tuple(words)] if 0 < len(words) < width else [tuple(words[i : i + width]) for i in range(len(words) - width + 1)])


def components(docs: list[tuple[int, str | None]], width: int, percent: int = 80) -> dict[int, int]:
    """doc_id -> least doc_id that can be reached, from all pairs."""
    sets = [(d, shingles(t, width)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d, _ in docs}


def contamination(text: str | None, items: Iterable[tuple[str, str | None]]) -> tuple[int, int, list[str]]:
    words = _ALNUM.findall(low(text))
    hit, found = [False] * len(words), set()
    places: dict[tuple[str, ...], list[int]] = {}
    for item, body in items:
        own = _ALNUM.findall(low(body))
        for size in {min(10, len(own))} - {0}:
            if (size,) not in places:
                places[(size,)] = [1]
                for i in range(len(words) - size + 1):
                    places.setdefault((str(size), *words[i : i + size]), []).append(i)
            for i in range(len(own) - size + 1):
                for at in places.get((str(size), *own[i : i + size]), ()):
                    found.add(item)
                    hit[at : at + size] = [True] * size
    return len(words), sum(hit), sorted(found)


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    text = text or ""
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 8],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32],
    }


def span_text(spans: dict[str, list[tuple[int, int]]]) -> str:
    kinds = list(spans)
    rows = sorted((a, kinds.index(k), b) for k in kinds for a, b in spans[k])
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in rows)


def nearest(rows: dict[int, list[float]], query: int, k: int) -> list[tuple[int, float]]:
    q = np.array(rows[query], float)
    score = {i: float((np.array(v, float) * q).sum() / (np.sqrt((np.array(v, float) ** 2).sum()) * np.sqrt((q * q).sum()))) for i, v in rows.items() if i != query}
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


def token_rows(docs: list[tuple[int, str | None]], encode, end_id: int) -> list[tuple[int, int, int, int]]:
    out, start = [], 0
    for doc_id, text in sorted(docs):
        ids = [*encode(text or ""), end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def entropy_spans(text: str | None) -> list[tuple[int, int]]:
    """Candidates that stay random once base matches, placeholders and repeats are blanked, by direct counting."""
    covered = re.compile(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}|(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,})")
    bare = covered.sub(lambda m: " " * len(m[0]), text or "")
    allowed = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}|(?:sha1|sha256|sha384|sha512|md5)[-=_][A-Za-z0-9+/]+={0,2}|(?:[A-Za-z0-9]{1,12}[-_/]){3,}[A-Za-z0-9]{0,12}")
    placeholder = re.compile("example|sample|dummy|placeholder|changeme|xxxx|0000000|1234567", re.I)
    mixed = lambda s: re.search("[0-9]", s) and re.search("[A-Za-z]", s)
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", bare):
        if not mixed(m[0]) or allowed.fullmatch(m[0]):
            continue
        parts = re.findall("[A-Za-z0-9+]+|[/_=-]+", m[0])
        rest = re.sub(r"(.)\1{7,}", " ", "".join(" " if placeholder.search(p) else p for p in parts))
        for piece in rest.split(" "):
            if len(piece) < 20 or not mixed(piece):
                continue
            least = 3.0 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", piece) else 3.5 if piece.isalnum() else 3.6
            windows = (piece[i : i + 20] for i in range(len(piece) - 19))
            if any(-sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) >= least - 1e-12 for w in windows):
                out.append(m.span())
                break
    return out
