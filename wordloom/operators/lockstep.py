"""The sequential order for many independent parts at once.

Parts of a super-step share no row: each has its own copy.  So the first focus
tokens of all parts can be trained together, then the second ones, and so on,
one vector operation for all parts where a loop over one part would touch a
row at a time.  Every part gets what the loop alone would give it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The curvature of the logistic loss is taken as no less than this share of the gradient.
LEAST_CURVE = 0.25
#: Focus tokens that are put in order at once, over all parts.
CHUNK_TOKENS = 32_768


@dataclass(frozen=True)
class Part:
    """Focus tokens of one part: ``ids`` are the input rows of all of them, ``n_ids``
    of each; ``outputs`` has a row per context, ``sizes`` of each; and a rate each."""

    ids: np.ndarray
    n_ids: np.ndarray
    outputs: np.ndarray
    sizes: np.ndarray
    rates: np.ndarray

    def __len__(self) -> int:
        return len(self.sizes)

    def examples(self) -> list[tuple[np.ndarray, np.ndarray]]:
        a, b = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_ids, self.sizes))
        return [(self.ids[a[i] : a[i + 1]], self.outputs[b[i] : b[i + 1]]) for i in range(len(self))]


def begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def runs(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...`` of each length ``sizes[i]``."""
    return np.arange(int(sizes.sum())) + np.repeat(start - begins(sizes), sizes)


def _logistic(a: np.ndarray) -> np.ndarray:
    y = 1 / (1 + np.exp(-np.clip(a, -10, 10)))
    y[a > 10] = 1.0
    y[a < -10] = 0.0
    return y


def _in_order(live: list[Part], at: int, to: int) -> tuple[np.ndarray, ...]:
    """The focus tokens ``at`` to ``to`` of all parts, by place and then part:
    their places, rates, input rows and output rows, each with its numbers."""
    place, rates, n_ids, ids, sizes, outputs = [], [], [], [], [], []
    for p in live:
        end = min(to, len(p))
        a, b, c, d = (int(n[k].sum()) for n in (p.n_ids, p.sizes) for k in (slice(at), slice(at, end)))
        place.append(np.arange(end - at, dtype=np.int16))
        rates.append(p.rates[at:end])
        n_ids.append(p.n_ids[at:end])
        ids.append(p.ids[a : a + b])
        sizes.append(p.sizes[at:end] * p.outputs.shape[1])
        outputs.append(p.outputs[c : c + d].ravel())
    place, rates, n_ids, ids, sizes, outputs = (np.concatenate(x) for x in (place, rates, n_ids, ids, sizes, outputs))
    order = np.argsort(place, kind="stable")
    ids = ids[runs(begins(n_ids)[order], n_ids[order])]
    outputs = outputs[runs(begins(sizes)[order], sizes[order])]
    return place[order], rates[order], n_ids[order], ids, sizes[order], outputs


def lockstep_pass(parts: list[Part], rows_in: np.ndarray, rows_out: np.ndarray, curve_in: np.ndarray, curve_out: np.ndarray) -> float:
    """``sequential_pass`` of each part; no two parts may name the same row.

    Within one focus, an output row that occurs again sees what its earlier
    occurrences changed: first occurrences are one vector step, second ones
    the next, and so on.
    """
    filled = []
    for p in parts:  # focus tokens without any output change nothing
        some = p.sizes > 0
        if some.all():
            filled.append(p)
        elif some.any():
            filled.append(Part(p.ids[np.repeat(some, p.n_ids)], p.n_ids[some], p.outputs, p.sizes[some], p.rates[some]))
    filled.sort(key=len, reverse=True)
    total, at = 0.0, 0
    while filled:
        to = at + min(max(1, CHUNK_TOKENS // len(filled)), 32_767)
        total += _lockstep_chunk(filled, at, to, rows_in, rows_out, curve_in, curve_out)
        at = to
        filled = [p for p in filled if len(p) > at]
    return total


def _lockstep_chunk(live: list[Part], at: int, to: int, rows_in: np.ndarray, rows_out: np.ndarray, curve_in: np.ndarray, curve_out: np.ndarray) -> float:
    width = live[0].outputs.shape[1]
    place, rates, n_ids, ids, sizes, outputs = _in_order(live, at, to)
    steps = int(place[-1]) + 1
    focus = np.repeat(np.arange(len(sizes)), sizes)
    positive = (runs(np.zeros(len(sizes), int), sizes) % width == 0).astype(np.float64)
    # which occurrence of its row within the focus each output is, and where the first one stands
    key = focus * np.int64(len(rows_out)) + outputs
    by_key = np.argsort(key, kind="stable")
    same = np.flatnonzero(np.diff(key[by_key]) == 0) + 1
    again, start = np.zeros(len(key), bool), np.arange(len(key))
    start[same] = 0
    start = np.maximum.accumulate(start)
    again[by_key[same]] = True
    slots = np.cumsum(~again) - 1
    late, late_slot = by_key[same], slots[by_key[start[same]]]
    nth = same - start[same]
    order = np.lexsort((late, nth, place[focus[late]]))
    late, late_slot, nth = late[order], late_slot[order], nth[order]
    late_focus, late_place = focus[late], place[focus[late]]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(late_place) != 0) | (np.diff(nth) != 0)])) if len(late) else np.zeros(0, int)
    waves: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(late)]):
        waves.setdefault(int(late_place[a]), []).append((a, b))
    first = ~again
    row, of, label = outputs[first], focus[first], positive[first]
    late_label, late_rate = positive[late], rates[late_focus]
    rate = rates[of]
    each = np.bincount(of, minlength=len(sizes))
    begin = begins(each)
    ends = np.searchsorted(place, np.arange(steps + 1)).tolist()
    cut = np.append(begin, len(row))[ends].tolist()
    single = len(ids) == len(n_ids) and bool((n_ids == 1).all())
    id_begin = begins(n_ids)
    id_cut = np.append(id_begin, len(ids))[ends].tolist()
    gaps, late_gaps = np.empty(len(row)), np.empty(len(late))
    curve, squares, lengths = np.empty(len(row)), np.empty(len(row)), np.empty(len(sizes))
    for t in range(steps):
        a, b, c, d = ends[t], ends[t + 1], cut[t], cut[t + 1]
        if single:
            mine = ids[a:b]
            old = rows_in.take(mine, axis=0).astype(np.float64)
            u = old
        else:
            mine = ids[id_cut[t] : id_cut[t + 1]]
            u = np.add.reduceat(rows_in.take(mine, axis=0).astype(np.float64), id_begin[a:b] - id_cut[t]) / n_ids[a:b, None]
        to_row, seg, heads = row[c:d], of[c:d] - a, begin[a:b] - c
        w, along_u = rows_out.take(to_row, axis=0).astype(np.float64), u.take(seg, axis=0)
        activation = np.einsum("ij,ij->i", w, along_u)
        length = np.einsum("ij,ij->i", u, u)
        g = label[c:d] - _logistic(activation)
        gap = np.abs(g)
        gaps[c:d] = gap
        bend = gap * np.maximum(1 - gap, LEAST_CURVE)
        moved = g * rate[c:d]
        along = None
        for x, y in waves.get(t, ()):
            slot, who = late_slot[x:y] - c, late_focus[x:y] - a
            before = moved[slot]
            g = late_label[x:y] - _logistic(activation[slot] + before * length[who])
            gap = np.abs(g)
            late_gaps[x:y] = gap
            bend[slot] += gap * np.maximum(1 - gap, LEAST_CURVE)
            g *= late_rate[x:y]
            pulled = np.bincount(who, g * before, b - a)  # the old row is w + before * u
            along = pulled if along is None else along + pulled
            moved[slot] = before + g
        delta = np.add.reduceat(moved[:, None] * w, heads)
        if along is not None:
            delta += along[:, None] * u
        curve[c:d], lengths[a:b] = bend, length
        squares[c:d] = np.einsum("ij,ij->i", w, w)
        along_u *= moved[:, None]
        along_u += w
        rows_out[to_row] = along_u
        if single:
            rows_in[mine] = old + delta
        else:
            np.add.at(rows_in, mine, np.repeat(delta.astype(rows_in.dtype), n_ids[a:b], axis=0))
    curve *= rate
    np.add.at(curve_out, row, curve * lengths[of])
    np.add.at(curve_in, ids, np.repeat(np.add.reduceat(curve * squares, begin), n_ids))
    return -float(np.log(1 - gaps + 1e-5).sum() + np.log(1 - late_gaps + 1e-5).sum())
