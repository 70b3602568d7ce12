"""Windows around anchors: what a task decides, and what it passes on, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from dossier.llm import suffixes as s


def anchors(rng):
    """Rows ``h, no, place, around`` in order, many with equal or partly equal surroundings."""
    pool = [rng.integers(97, 100, size=s.AROUND, dtype=np.uint8) for _ in range(4)]
    rows = []
    for h in range(6):
        seed = rng.integers(97, 123, size=s.SEED, dtype=np.uint8)
        for _ in range(int(rng.integers(1, 40))):
            left, right = pool[rng.integers(4)].copy(), pool[rng.integers(4)]
            left[s.WINDOW - 1 :] = right[s.WINDOW - 1 :]
            left[s.WINDOW - 1 : s.WINDOW - 1 + s.SEED] = seed
            lo = int(rng.integers(0, s.WINDOW))
            hi = int(rng.integers(lo, s.WINDOW))
            left[:lo], left[hi + s.LENGTH :] = 0, 0
            rows.append((h, int(rng.integers(0, 20)), (1000 * len(rows) + 200) << 12 | lo << 6 | hi, left))
    return sorted(rows, key=lambda r: r[:3])


def spread(batches):
    """Every window start of packed runs."""
    return sorted(
        (no, (p >> 6) + k)
        for b in batches
        for no, p in zip(b.column("no").to_pylist(), b.column("place").to_pylist())
        for k in range((p & 63) + 1)
    )


@pytest.mark.parametrize("limit", [1, 5, 1000])
@pytest.mark.parametrize("size", [1, 7, 500])
def test_later_windows(limit, size):
    rows = anchors(np.random.default_rng(limit + size))
    want, seen = [], set()
    for h, no, place, around in rows:
        for j in range(place >> 6 & 63, (place & 63) + 1):
            key = (j, around[j : j + s.LENGTH].tobytes())
            if key in seen:
                want.append((no, (place >> 12) - s.WINDOW + 1 + j))
            seen.add(key)
    cols = [np.array(c) for c in list(zip(*rows))[:3]] + [np.stack([r[3] for r in rows])]
    given = [s._rows(*[c[k : k + size] for c in cols]) for k in range(0, len(rows), size)]
    # Decided runs that come along are passed on as they are.
    given.insert(len(given) // 2, s._rows(np.array([3]), np.array([99]), np.array([5 << 6 | 2])))
    out = pa.Table.from_batches(s._compare(iter(given), limit)).combine_chunks().to_batches()
    parts = [(b.filter(b.column(3).is_null()), b.filter(b.column(3).is_valid())) for b in out]
    single = pa.Table.from_batches(s._single_windows(iter([p[1] for p in parts]))).sort_by("h")
    assert (single.num_rows > 0) == (limit < 1000)
    again = list(s._again(iter(single.to_batches(max_chunksize=50))))
    assert spread([p[0] for p in parts] + again) == sorted([*want, *((99, 5 + k) for k in range(3))])
