"""Sorting one bucket of suffixes with a difference cover.

A bucket holds short byte strings (contexts). Its suffixes of a fixed depth are ordered by their first ``PERIOD`` bytes; suffixes
that tie there are told apart by ranks computed beforehand for a sample of the positions, those whose residue modulo
``PERIOD`` is in a difference cover. For any two positions some shift below ``PERIOD`` takes both into the sample, so ties of any
length cost one look-up per cover element, and memory is a fixed number of words per suffix.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set modulo 31: each residue but 0 is the difference of exactly one pair.
PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
#: SHIFT[a, b] takes positions of residues a and b into the cover, both by the same number of bytes.
SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
                   for b in range(PERIOD)] for a in range(PERIOD)])
#: Rounds of comparing a group of ties with its first member, before all cover elements are looked up at once.
ROUNDS = 6


def _word(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``size`` bytes from each position as a number in byte order."""
    word = np.zeros(len(at), np.uint64)
    for k in range(size):
        word = (word << np.uint64(8)) | data[at + k]
    return word


def _ranks(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Dense ranks of the ``depth`` bytes from each position, in byte order."""
    if not len(at):
        return np.empty(0, np.int64)
    by = np.arange(len(at))
    new = np.zeros(len(at), bool)
    new[0] = True
    for first in range(0, depth, 8):
        word = _word(data, at + first, min(8, depth - first))
        w = word[by]
        if (~new[1:] & (w[1:] < w[:-1])).any():  # sort on within the groups that are not in order
            group = np.cumsum(new) - 1
            wrong = np.zeros(group[-1] + 1, bool)
            wrong[group[1:][~new[1:] & (w[1:] < w[:-1])]] = True
            part = np.flatnonzero(wrong[group])
            by[part] = by[part][np.lexsort([w[part], group[part]]) if first else np.argsort(w[part], kind="stable")]
            w = word[by]
        new[1:] |= w[1:] != w[:-1]
    rank = np.empty(len(at), np.int64)
    rank[by] = np.cumsum(new) - 1
    return rank


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def earliest_equal(data: np.ndarray, windows: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each window (its position in ``data``) the least ``order`` of all windows with the same ``depth`` bytes.

    ``depth`` must exceed 2 * PERIOD; orders differ. Two suffixes are equal if their first PERIOD and last PERIOD - 1 bytes are, and
    the ranks, to depth - PERIOD + 1, at a shift that takes both into the sample: together these cover every byte.
    """
    least = order.copy()
    head = _ranks(data, windows, PERIOD)
    tied = np.flatnonzero(np.bincount(head)[head] > 1) if len(head) else head
    if not len(tied):
        return least
    # long ties: the far ends first, then the ranks of the sample
    group = head[tied] * np.int64(len(tied) + 1) + _ranks(data, windows[tied] + (depth - PERIOD + 1), PERIOD - 1)
    reach = depth - PERIOD + 1
    places = np.arange(max(0, len(data) - reach + 1))
    sample = places[np.isin(places % PERIOD, COVER)]
    rank = np.full(len(data), -1, np.int64)
    rank[sample] = _ranks(data, sample, reach)
    for _ in range(ROUNDS):
        by = np.lexsort([order[tied], group])
        tied, group = tied[by], group[by]
        starts = _runs(group)
        first = np.repeat(tied[starts], np.diff(np.append(starts, len(tied))))
        a, b = windows[tied], windows[first]
        shift = SHIFT[a % PERIOD, b % PERIOD]
        equal = rank[a + shift] == rank[b + shift]
        least[tied[equal]] = order[first[equal]]
        tied, group = tied[~equal], group[~equal]
        if not len(tied):
            return least
    # groups of many different strings between equal ends: every cover element of every suffix at once
    at = windows[tied]
    shift = (COVER[None, :] - at[:, None]) % PERIOD
    key = np.stack([np.repeat(group, len(COVER)), shift.reshape(-1), rank[at[:, None] + shift].reshape(-1)])
    own = np.repeat(order[tied], len(COVER))
    by = np.lexsort([own, *key])
    new = np.concatenate([[True], (key[:, by][:, 1:] != key[:, by][:, :-1]).any(axis=0)])
    starts = np.flatnonzero(new)
    best = np.empty_like(own)
    best[by] = np.repeat(own[by][starts], np.diff(np.append(starts, len(own))))
    least[tied] = best.reshape(-1, len(COVER)).min(axis=1)
    return least
