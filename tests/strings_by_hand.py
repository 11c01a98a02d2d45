"""String similarities by their definitions, one letter after the other."""

from __future__ import annotations

import re


def jaro_value(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken: set[int] = set()
    pairs: list[tuple[int, int]] = []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == ch and j not in taken), None)
        if j is not None:
            taken.add(j)
            pairs.append((i, j))
    if not pairs:
        return 0.0
    m = len(pairs)
    crossed = sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(taken), strict=True))
    return (m / len(a) + m / len(b) + (m - crossed / 2) / m) / 3


def jaro_winkler_value(a: str, b: str, scale: float = 0.1) -> float:
    base = jaro_value(a, b)
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return base + same * scale * (1 - base) if base else 0.0


def common_value(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio_value(a: str, b: str) -> int:
    return int(200 * common_value(a, b) / (len(a) + len(b)) + 0.5) if a and b else 0


def token_set_value(a: str, b: str) -> int:
    ta, tb = ({t for t in re.split(r"[ \t\n\r\f\v]+", x.lower()) if t} for x in (a, b))
    if not ta or not tb:
        return 0
    common = " ".join(sorted(ta & tb))
    with_a = f"{common} {' '.join(sorted(ta - tb))}".strip()
    with_b = f"{common} {' '.join(sorted(tb - ta))}".strip()
    return max(ratio_value(common, with_a), ratio_value(common, with_b), ratio_value(with_a, with_b))
