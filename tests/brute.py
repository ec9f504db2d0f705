"""Plain loops over the standard library, independent of the package."""

import lzma
import random


def csize(x):
    return len(lzma.compress(x))


def ncd(x, y):
    cx, cy = csize(x), csize(y)
    return (csize(x + y) - min(cx, cy)) / max(cx, cy)


def matrix(items, distance=ncd):
    n = len(items)
    m = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            m[i][j] = m[j][i] = distance(items[i], items[j])
    return m


def fpf(m, k, first):
    chosen = [first]
    while len(chosen) < k:
        rest = [i for i in range(len(m)) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (min(m[i][c] for c in chosen), -i)))
    return chosen


def variance(values):
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values) / len(values)


def clusters(m, most=4, gain=0.001):
    n = len(m)
    means = [sum(row) / n for row in m]
    centres = [means.index(max(means))]
    for _ in range(2, most + 1):
        near = [min(m[c][i] for c in centres) for i in range(n)]
        new = near.index(max(near))
        after = [min(near[i], m[new][i]) for i in range(n)]
        if variance(near) - variance(after) < gain:
            break
        centres.append(new)
    return centres, [min(range(len(centres)), key=lambda c: m[i][centres[c]]) for i in range(n)]


def insert_or_replace(rows, unique_url=True):
    """rows: (phish_id, url, payload) in order; deletes what collides, then inserts."""
    table = []
    for row in rows:
        table = [r for r in table if r[0] != row[0] and not (unique_url and r[1] == row[1])]
        table.append(row)
    return sorted(table)


def tag_texts(n, seed=1, words=("html", "head", "body", "div", "span", "p", "a", "ul", "li", "form", "input")):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))).encode() for _ in range(n)]
