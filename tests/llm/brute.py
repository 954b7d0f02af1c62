"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text: str | None) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def jaccard_components(rows: list[tuple]) -> dict[int, int]:
    """Row number -> row number of its component's first row, for ``(doc_id, text)`` rows."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(rows))}


def jaccard_answer(rows: list[tuple]) -> list[tuple]:
    """``(doc_id, n_shingles, component_id)`` of every row."""
    comp = jaccard_components(rows)
    smallest: dict[int, int | None] = {}
    for i, r in comp.items():
        ids = [x for x in (smallest.get(r), rows[i][0]) if x is not None]
        smallest[r] = min(ids, default=None)
    return [(rows[i][0], len(shingle_set(rows[i][1])), smallest[comp[i]]) for i in range(len(rows))]


def repeated_windows(words: list[str]) -> int:
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    return len(covered)


def base_quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = repeated_windows(words)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, failed,
    )


def dedup(rows: list[tuple]) -> list[str | None]:
    """Texts of ``(doc_id, text)`` rows (ids distinct) without later three-line windows."""
    first: dict[tuple, tuple] = {}
    windows = []
    for doc, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate(text.split("\n"))]
        lines = [x for x in lines if x[1]]
        for a, b, c in zip(lines, lines[1:], lines[2:], strict=False):
            key = (a[1], b[1], c[1])
            first.setdefault(key, (doc, a[0]))
            windows.append((doc, a[0], c[0], key))
    gone: dict = {}
    for doc, low, high, key in windows:
        if first[key] != (doc, low):
            gone.setdefault(doc, set()).update(range(low, high + 1))
    return [
        None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows
    ]


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_personal(text: str) -> list[tuple]:
    def digits(s: str) -> str:
        return re.sub("[^0-9]", "", s)

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn_ok(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out
