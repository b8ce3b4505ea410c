"""Cover-tree links against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from rowaccord.llm.near_vectors import near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, n string"


def brute(rows):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            ok[k] = x / np.sqrt((x * x).sum())
    links = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.98:
                links[a].append(b)
    out, root = [], {}
    for k in range(len(rows)):
        if k in root:
            continue
        stack, seen = [k], {k}
        while stack:
            for b in links[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        root.update(dict.fromkeys(seen, min(rows[i][0] for i in seen)))
    for k, (i, _, _) in enumerate(rows):
        out.append((i, len(links[k]), root[k], root[k] == i))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in near_vectors(df, **options).collect())


def vectors(seed, dim):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(150)]
    for spread in (0.02, 0.1, 0.15, 0.2):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        out += [centre * rng.uniform(0.1, 5) + rng.normal(size=dim) * spread / np.sqrt(dim) for _ in range(60)]
    out += [out[3]] * 5 + [out[-1] * 2.0]
    rows = [(int(i), [float(np.float32(c)) for c in v], int(rng.integers(0, 2))) for i, v in enumerate(out)]
    # A walk of small steps: links in a chain.
    for k in range(40):
        a = k * 0.15
        rows.append((900 - k, [float(np.float32(c)) for c in [np.cos(a), np.sin(a)] + [0.0] * (dim - 2)], 1))
    return rows


@pytest.mark.parametrize(("seed", "dim", "tile"), [(1, 16, 2048), (2, 3, 2048), (3, 16, 20), (4, 4, 33)])
def test_all_pairs(spark, seed, dim, tile):
    rows = vectors(seed, dim)
    assert run(spark, rows, tile_rows=tile, pivots=16) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (9, [1.0, 0.0], 2), (10, [2.0, 0.0], 2),
        (11, [1.0, 0.0, 0.0], 2), (12, [1e-30, 0.0], 2), (13, [-1.0, 0.0], 2),
    ]
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [0.0, 1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    got = sorted((tuple(r) for r in near_vectors(df).collect()), key=str)
    assert got == [(5, 0, 5, True), (None, 1, None, False), (None, 1, None, False)]
    assert near_vectors(df.limit(0)).collect() == []
