"""Title similarity inside one bounded block of titles.

Similarity is ``difflib.SequenceMatcher(None, later, earlier).ratio()`` on normalised
titles. Matching blocks form a common subsequence, so ``2 * LCS / (len + len)`` bounds the
ratio from above; that bound is computed for a whole block at once and only the survivors
reach difflib. Blocks are sized by the caller; nothing here sees more than one block.
"""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher

import numpy as np

from straitline import constants as K

WINDOW_MICROS = K.STORY_WINDOW_DAYS * 86_400_000_000
_WORD = 64
_PAIRS_AT_ONCE = 1 << 13
_PAD = 37  # after blank, digits and letters: matches nothing
_CODES = np.zeros(128, dtype=np.uint8)
_CODES[48:58] = np.arange(1, 11)
_CODES[97:123] = np.arange(11, 37)


class TitleBlock:
    """Distinct titles of one block with, per character, a bit for each position it fills."""

    def __init__(self, titles):
        distinct, self.code = np.unique(np.asarray(titles, dtype=object), return_inverse=True)
        self.titles = distinct.tolist()
        self.lengths = np.array([len(t) for t in self.titles], dtype=np.int64)
        longest = int(self.lengths.max()) if len(self.titles) else 1
        self.words = -(-longest // _WORD)
        self.chars = np.full((len(self.titles), longest), _PAD, dtype=np.uint8)
        self.masks = np.zeros((len(self.titles), _PAD + 1, self.words), dtype=np.uint64)
        for i, title in enumerate(self.titles):
            at = np.arange(len(title))
            self.chars[i, : len(title)] = _CODES[np.frombuffer(title.encode("ascii"), dtype=np.uint8)]
            bits = np.uint64(1) << (at % _WORD).astype(np.uint64)
            np.bitwise_or.at(self.masks, (i, self.chars[i, : len(title)], at // _WORD), bits)
        self.counts = np.bitwise_count(self.masks).sum(axis=2, dtype=np.int16)
        self._matchers = {}

    def _common_subsequence(self, left, right):
        """Length of the longest common subsequence of each (left, right) pair of titles."""
        words = int(-(-self.lengths[right].max() // _WORD))
        state = [np.full(len(left), np.iinfo(np.uint64).max, dtype=np.uint64) for _ in range(words)]
        for step in range(int(self.lengths[left].max())):
            masks = self.masks[right, self.chars[left, step]]
            carry = None
            for w in range(words):
                row, mask = state[w], masks[:, w]
                total = row + (row & mask)
                over = total < row if w + 1 < words else None
                if carry is not None:
                    total += carry
                    if over is not None:
                        over |= total < carry
                carry = over.astype(np.uint64) if over is not None else None
                state[w] = total | (row & ~mask)
        common = np.zeros(len(left), dtype=np.int64)
        for w in range(words):
            inside = np.clip(self.lengths[right] - w * _WORD, 0, _WORD).astype(np.uint64)
            full = np.where(inside == _WORD, np.iinfo(np.uint64).max,
                            (np.uint64(1) << (inside % np.uint64(_WORD))) - np.uint64(1))
            common += np.bitwise_count(~state[w] & full)
        return common

    def may_match(self, left, right, threshold):
        """Whether the bounds leave room for each pair to be similar."""
        totals = self.lengths[left] + self.lengths[right]
        keep = 2.0 * np.minimum(self.lengths[left], self.lengths[right]) / totals >= threshold
        open_pairs = np.flatnonzero(keep & (left != right))
        # Characters in common, whatever their order, bound the subsequence and cost far less.
        for start in range(0, len(open_pairs), _PAIRS_AT_ONCE):
            part = open_pairs[start : start + _PAIRS_AT_ONCE]
            shared = np.minimum(self.counts[left[part]], self.counts[right[part]]).sum(axis=1)
            keep[part] = 2.0 * shared / totals[part] >= threshold
        open_pairs = open_pairs[keep[open_pairs]]
        # Pairs of like size together: a block takes as many words and steps as its longest titles.
        order = np.lexsort((self.lengths[left[open_pairs]], -(-self.lengths[right[open_pairs]] // _WORD)))
        open_pairs = open_pairs[order]
        for start in range(0, len(open_pairs), _PAIRS_AT_ONCE):
            part = open_pairs[start : start + _PAIRS_AT_ONCE]
            common = self._common_subsequence(left[part], right[part])
            keep[part] = 2.0 * common / totals[part] >= threshold
        return keep

    def similar(self, later, earlier, threshold):
        """The exact test of one pair; equal titles are always similar."""
        if later == earlier:
            return True
        matcher = self._matchers.get(earlier)
        if matcher is None:
            matcher = self._matchers[earlier] = SequenceMatcher(None, "", self.titles[earlier])
        matcher.set_seq1(self.titles[later])
        return matcher.ratio() >= threshold


class SimilarPairs:
    """The pairs (row, col) of titles whose bounds leave room for similarity, bounded in slices."""

    def __init__(self, titles, rows, cols, threshold=K.STORY_SIMILARITY):
        self.block, self.threshold, self.told = TitleBlock(titles), threshold, {}
        kept = [np.zeros(0, np.int64)]
        for start in range(0, len(rows), _PAIRS_AT_ONCE * 16):
            at = slice(start, start + _PAIRS_AT_ONCE * 16)
            kept.append(start + np.flatnonzero(self.block.may_match(self.block.code[rows[at]], self.block.code[cols[at]], threshold)))
        kept = np.concatenate(kept)
        self.rows, self.cols = rows[kept], cols[kept]

    def ordered(self, chosen):
        """(later, earlier) of the chosen pairs (a mask over ``rows``) in each order in which they are similar."""
        for row, col in zip(self.rows[chosen].tolist(), self.cols[chosen].tolist()):
            for later, earlier in ((row, col), (col, row)):
                told = self.told.get((later, earlier))
                if told is None:
                    told = self.told[later, earlier] = self.block.similar(self.block.code[later], self.block.code[earlier], self.threshold)
                if told:
                    yield later, earlier

    def _similar(self, row, col):
        """The exact test in either order, taken once."""
        told = self.told.get((row, col))
        if told is None:
            a, b = self.block.code[row], self.block.code[col]
            told = self.told[row, col] = self.block.similar(a, b, self.threshold) or self.block.similar(b, a, self.threshold)
        return told

    def forest(self, chosen):
        """Pairs that connect the titles similar in either order: a spanning forest of the chosen pairs (a mask over ``rows``).

        The exact ratio is only taken between titles that are not connected yet.
        """
        root, links = {}, []

        def find(i):
            while (up := root.setdefault(i, i)) != i:
                root[i] = i = root[up]
            return i

        for row, col in zip(self.rows[chosen].tolist(), self.cols[chosen].tolist()):
            a, b = find(row), find(col)
            if a != b and self._similar(row, col):
                root[max(a, b)] = min(a, b)
                links.append((row, col))
        return links


def _window_pairs(times, first, last):
    """(row, column) pairs with first[row] <= column < last[row]."""
    counts = np.maximum(last - first, 0)
    rows = np.repeat(np.arange(len(times)), counts)
    starts = np.cumsum(counts) - counts
    return rows, np.arange(len(rows)) - np.repeat(starts - first, counts)


def resolve_batch(times, titles, threshold=K.STORY_SIMILARITY):
    """Leader position of each row of one ordered batch: the earliest leader it resembles, or itself."""
    block = TitleBlock(titles)
    first = np.searchsorted(times, times - WINDOW_MICROS, side="left")
    rows, cols = _window_pairs(times, first, np.arange(len(times)))
    keep = block.may_match(block.code[rows], block.code[cols], threshold) if len(rows) else np.zeros(0, bool)
    rows, cols = rows[keep], cols[keep]
    bounds = np.searchsorted(rows, np.arange(len(times) + 1))
    leader_of = np.arange(len(times))
    for row in range(len(times)):
        for col in cols[bounds[row] : bounds[row + 1]]:
            if leader_of[col] == col and block.similar(block.code[row], block.code[col], threshold):
                leader_of[row] = col
                break
    return leader_of


def first_leaders(times, titles, leader_times, leader_titles, threshold=K.STORY_SIMILARITY):
    """For each row the position of the first leader it resembles, or -1.

    Leaders are given in time order and count only within the story window of the row.
    """
    block = TitleBlock(list(titles) + list(leader_titles))
    mine, theirs = block.code[: len(times)], block.code[len(times) :]
    first = np.searchsorted(leader_times, times - WINDOW_MICROS, side="left")
    last = np.searchsorted(leader_times, times + WINDOW_MICROS, side="right")
    # Copies of a title that see the same leaders are asked once.
    asked, copy_of = np.unique(np.stack([mine, first, last]), axis=1, return_inverse=True)
    rows, cols = _window_pairs(asked[0], asked[1], asked[2])
    answer = np.full(asked.shape[1], -1, dtype=np.int64)
    if len(rows):
        keep = block.may_match(asked[0][rows], theirs[cols], threshold)
        for row, col in zip(rows[keep], cols[keep]):
            if answer[row] < 0 and block.similar(asked[0][row], theirs[col], threshold):
                answer[row] = col
    return answer[np.ravel(copy_of)]


def resolve_titles(times, code, titles, threshold=K.STORY_SIMILARITY):
    """Leader position of each row of one ordered list, as ``resolve_batch`` gives it, by distinct titles (``titles[code]``)."""
    block, count = TitleBlock(titles), len(titles)

    def near(t):
        maybe = np.flatnonzero(block.may_match(block.code, np.full(count, block.code[t]), threshold))
        return np.array([u for u in maybe.tolist() if block.similar(block.code[u], block.code[t], threshold)])

    return resolve_near(times, code, count, near)


def resolve_near(times, code, count, near_of):
    """The same where ``near_of(t)`` gives the numbers of the titles that resemble title ``t`` as their leader, itself included.

    Between two leaders nothing happens to a title: the first of its rows that no leader reaches is looked up, and the earliest of
    those of all titles leads. Work follows leaders times similar titles; rows are only searched and, at the end, told their leader.
    """
    rows = np.split(np.argsort(code, kind="stable"), np.cumsum(np.bincount(code, minlength=count))[:-1])
    at = [times[r] for r in rows]
    near, until = {}, np.full(count, np.iinfo(np.int64).min)
    leaders = [[] for _ in range(count)]  # of each title those that it resembles
    ahead = [(int(r[0]), t) for t, r in enumerate(rows) if len(r)]
    heapq.heapify(ahead)
    while ahead:
        row, t = heapq.heappop(ahead)
        if times[row] > until[t]:
            if t not in near:
                near[t] = near_of(t)
            until[near[t]] = times[row] + WINDOW_MICROS
            for u in near[t].tolist():
                leaders[u].append(row)
        after = np.searchsorted(at[t], until[t], side="right")
        if after < len(at[t]):
            heapq.heappush(ahead, (int(rows[t][after]), t))
    leader_of = np.empty(len(times), dtype=np.int64)
    for mine, when, found in zip(rows, at, leaders):
        if len(mine):
            found = np.array(found)
            leader_of[mine] = found[np.searchsorted(times[found], when - WINDOW_MICROS, side="left")]
    return leader_of


def first_titles(later, earlier, threshold=K.STORY_SIMILARITY):
    """For each distinct later title: a mask of the distinct earlier ones that may be similar, and the exact test of one of them."""
    block = TitleBlock(list(later) + list(earlier))
    theirs = block.code[len(later):]
    for mine in block.code[: len(later)]:
        yield block.may_match(np.full(len(theirs), mine), theirs, threshold), lambda t, mine=mine: block.similar(mine, theirs[t], threshold)
