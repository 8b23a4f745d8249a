"""K-means of one image's colours, for tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Colours that meet the centres at a time, and the move that counts as one.
BLOCK, STILL = 1 << 18, 1e-6


def owners(at: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each place by distances to six places, the lowest on ties."""
    blocks = [at[k:k + BLOCK] for k in range(0, len(at), BLOCK)]
    return np.concatenate([np.rint(np.sqrt(((b[:, None] - centres) ** 2).sum(axis=2)) * 1e6).argmin(axis=1) for b in blocks])


def lloyd(at: np.ndarray, weight: np.ndarray, k: int, rounds: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, places and weights of the centres: rounds from k seeds, evenly spaced by lightness, until none moves. A centre without colours goes.

    Rounds end: sums of squares only fall, but for ties of rounded distances, and owners that come again end them too."""
    number = np.arange(k)
    centres, own = at[np.lexsort(at.T[::-1])][(2 * number + 1) * len(at) // max(2 * k, 1)], np.zeros(k, dtype=weight.dtype)
    seen: set[bytes] = set()
    while k and (rounds is None or len(seen) < rounds):
        of = owners(at, centres)
        total = np.bincount(of, weight, len(centres))
        some = total > 0
        new = np.stack([np.bincount(of, at[:, x] * weight, len(centres))[some] / total[some] for x in range(3)], axis=1)
        moved = np.sqrt(((new - centres[some]) ** 2).sum(axis=1)) > STILL
        number, centres, own = number[some], new, total[some].astype(weight.dtype)
        mark = number[np.cumsum(some)[of] - 1].astype(np.int32).tobytes()
        if not moved.any() or mark in seen:
            break
        seen.add(mark)
    return number, centres, own


def centre_rows(key: tuple[pa.Scalar, ...], colours: pa.Table, k: int, rounds: int | None) -> pa.Table:
    """image_id, centre, L, A, B, weight of the colours (L, A, B, weight) of one image."""
    colours = colours.drop_null()
    at = np.stack([colours.column(x).to_numpy() for x in "LAB"], axis=1)
    number, centres, own = lloyd(at, colours.column("weight").to_numpy(), k if len(at) else 0, rounds)
    places = {x: pa.array(centres[:, i]) for i, x in enumerate("LAB")}
    return pa.table({"image_id": pa.array([key[0].as_py()] * len(number), key[0].type), "centre": pa.array(number.astype(np.int32))} | places | {"weight": pa.array(own.astype(np.int64))})
