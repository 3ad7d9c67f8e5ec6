"""Weighted string ratio for short titles, and its best match among many.

All ratios come from the longest common subsequence (insertions and deletions
only) and run from 0 to 100.  The weighted ratio of two titles is the best of

* their plain ratio,
* 0.95 of the better of two word ratios: words in sorted order, and word sets
  (what both share against what each has besides),

if the longer has less than 1.5 times the characters of the shorter, and else of

* 0.9 of the best ratio of the shorter with a stretch of the longer,
* 0.95 * 0.9 of the same for sorted words; a shared word counts as 100,

with 0.6 instead of 0.9 beyond 8 times.  An empty title scores 0.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the weighted ratio.
WORDS_WEIGHT, PART_WEIGHT, FAR_PART_WEIGHT = 0.95, 0.9, 0.6
PART_FROM, FAR_FROM = 1.5, 8.0


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation for each character of ``b``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def similarity(distance, total):
    """100 for no insertions and deletions, 0 if nothing is common."""
    return 100.0 - 100.0 * distance / total


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return similarity(total - 2 * common_length(a, b), total) if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a stretch of the longer, no longer than itself."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if a in b:
        return 100.0
    found = max(ratio(a, b[max(0, i):min(m, i + n)]) for i in range(1 - n, m))
    return max(found, max(ratio(b, a[max(0, i):min(n, i + m)]) for i in range(1 - m, n))) if n == m else found


def _word_sets(a: str, b: str) -> tuple[list[str], str, str]:
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_ratio(a: str, b: str) -> float:
    """The better of the ratios of sorted words and of word sets."""
    both, only_a, only_b = _word_sets(a, b)
    if both and not (only_a and only_b):
        return 100.0
    shared = " ".join(both)
    gap = 1 if both else 0
    la, lb = (len(shared) + gap + len(x) for x in (only_a, only_b))
    best = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if la + lb:
        best = max(best, similarity(len(only_a) + len(only_b) - 2 * common_length(only_a, only_b), la + lb))
    if both:
        best = max(best, similarity(gap + len(only_a), len(shared) + la), similarity(gap + len(only_b), len(shared) + lb))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    """100 if a word is shared, else the partial ratio of the sorted words or word sets."""
    both, only_a, only_b = _word_sets(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(only_a, only_b))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < PART_FROM:
        return max(ratio(a, b), token_ratio(a, b) * WORDS_WEIGHT)
    weight = PART_WEIGHT if longer <= FAR_FROM else FAR_PART_WEIGHT
    return max(ratio(a, b), partial_ratio(a, b) * weight, partial_token_ratio(a, b) * WORDS_WEIGHT * weight)


# ------------------------------------------------------------ many with many
def _counts(texts: list[str], alphabet: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(alphabet)), np.int16)
    for i, t in enumerate(texts):
        for c in t:
            out[i, alphabet[c]] += 1
    return out


def _common_counts(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in common whatever their order: no common subsequence is longer."""
    alphabet = {c: k for k, c in enumerate(sorted(set("".join(a)) & set("".join(b))))}
    x, y = (_counts(["".join(c for c in t if c in alphabet) for t in side], alphabet) for side in (a, b))
    total = np.zeros((len(a), len(b)), np.int16)
    for c in range(len(alphabet)):
        total += np.minimum(x[:, c, None], y[None, :, c])
    return total.astype(float)


def _shared_words(a: list[list[str]], b: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of shared distinct words and their characters with the spaces between them."""
    at: dict[str, tuple[list[int], list[int]]] = {}
    for side, titles in enumerate((a, b)):
        for i, words in enumerate(titles):
            for w in words:
                at.setdefault(w, ([], []))[side].append(i)
    count, chars = np.zeros((len(a), len(b)), np.int16), np.zeros((len(a), len(b)), np.int16)
    for w, (i, j) in at.items():
        if i and j:
            place = np.ix_(i, j)
            count[place] += 1
            chars[place] += len(w)
    return count, np.where(count > 0, chars + count - 1, 0).astype(float)


class Columns:
    """Texts of up to 64 characters as bits: common lengths with one text, for all of them at once."""

    def __init__(self, texts: list[str]):
        self.full = np.array([(1 << len(t)) - 1 for t in texts], np.uint64)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.masks: dict[str, np.ndarray] = {}
        for j, t in enumerate(texts):
            for i, c in enumerate(t):
                if c not in self.masks:
                    self.masks[c] = np.zeros(len(texts), np.uint64)
                self.masks[c][j] |= np.uint64(1 << i)

    def common_lengths(self, text: str) -> np.ndarray:
        state = self.full.copy()
        for c in text:
            mask = self.masks.get(c)
            if mask is not None:
                hit = state & mask
                state = ((state + hit) | (state - hit)) & self.full
        return self.length - np.bitwise_count(state).astype(np.int64)


def best_matches(left: list[str], right: list[str], order: np.ndarray, threshold: float) -> list[tuple[int, float, int]]:
    """(left place, score, order) of the best right title of each left one: the highest
    weighted ratio from ``threshold`` on, the smallest order among equals.

    Plain and sorted-word ratios of a left title with all right ones come from
    one pass over its characters, what the word sets are worth from the shared
    words.  What is left (differing words, stretches of much longer titles) has
    an upper bound from character counts and common lengths; only pairs that
    could beat the best so far are compared as texts, most promising first.
    """
    if not len(right):
        return []
    x, y = ([sorted(set(t.split())) for t in side] for side in (left, right))
    count, shared = _shared_words(x, y)
    common, letters = _common_counts(left, right), _common_counts(*(["".join(w) for w in side] for side in (x, y)))
    short = np.array([len(t) <= 64 for t in right])
    cut = lambda texts: Columns([t if len(t) <= 64 else "" for t in texts])
    plain, in_order, distinct = cut(right), cut([" ".join(sorted(t.split())) for t in right]), cut([" ".join(w) for w in y])
    m, lb, words = np.array([len(t) for t in right], float), np.array([len(" ".join(w)) for w in y], float), np.array([len(w) for w in y])
    out = []
    for i, text in enumerate(left):
        if not text:
            continue
        n, la = float(len(text)), float(len(" ".join(x[i])))
        some, both = count[i] > 0, shared[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            longer = np.maximum(n, m) / np.minimum(n, m)
            near = longer < PART_FROM
            weight = np.where(longer <= FAR_FROM, PART_WEIGHT, FAR_PART_WEIGHT)
            only_a, only_b = (np.where(some, np.maximum(0.0, whole - both - 1), whole) for whole in (la, lb))
            inside = some & ((count[i] == len(x[i])) | (count[i] == words))
            of_sets = np.where(inside, 100.0, np.where(some, np.maximum(
                similarity(1 + only_a, 2 * both + 1 + only_a), similarity(1 + only_b, 2 * both + 1 + only_b)), 0.0))
            whole = similarity(n + m - 2 * plain.common_lengths(text), n + m)
            of_order = similarity(n + m - 2 * in_order.common_lengths(" ".join(sorted(text.split()))), n + m)
            known = np.where(near, np.maximum(np.where(short, np.maximum(whole, WORDS_WEIGHT * of_order), 0.0), WORDS_WEIGHT * of_sets),
                             np.where(some, 100.0 * WORDS_WEIGHT * weight, 0.0))
            # differing words have no more in common than all distinct words have, or than the letters besides the shared words
            rest = letters[i] - (both - np.maximum(0, count[i] - 1)) + np.maximum(0, np.minimum(len(x[i]), words) - count[i] - 1)
            rest = np.minimum(rest, np.where(short, distinct.common_lengths(" ".join(x[i])), np.inf))
            of_rest = WORDS_WEIGHT * similarity(only_a + only_b - 2 * rest, 2 * (both + some) + only_a + only_b)
            of_parts = weight * 200.0 * common[i] / (np.minimum(n, m) + common[i])
            most = np.where(near, np.maximum(of_rest, np.where(short, 0.0, 200.0 * np.minimum(n, m) / (n + m))), of_parts)
        known, most = (np.where(m > 0, np.nan_to_num(v, posinf=100.0), 0.0) for v in (known, most))
        score = float(known.max())
        place = int(order[known == score].min())
        could = np.flatnonzero(most >= max(threshold, score) - 1e-9)
        for j in could[np.argsort(-most[could], kind="stable")]:
            if most[j] < score - 1e-9:
                break
            s = weighted_ratio(text, right[j])
            if (s, -int(order[j])) > (score, -place):
                score, place = s, int(order[j])
        if score >= threshold:
            out.append((i, score, place))
    return out
