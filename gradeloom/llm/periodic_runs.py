"""Periodic runs of words, found on a grammar of the text (operator 12).

A run is a stretch of words with smallest period q (words q apart are equal) and a length of at
least max(6, 4 q) that no neighbouring word extends. The steps, for all texts of an Arrow batch
at once:

1. A run holds each of its words four times or more, so words that occur less often in their stretch
   cut it, until nothing is cut any more. No run goes over such a word.
2. Re-Pair over the word ids left: a pair of neighbours that is more frequent than the pairs it
   overlaps becomes a nonterminal, again and again, until no pair repeats. What is left of a stretch is
   paired up evenly, so that it derives from one nonterminal.
3. Each nonterminal is looked at once for runs over its middle. A run of length 4 q over a
   place reaches 2 q to its right or left, so a period counts only if the q words next to
   the middle are repeated there. The run is then followed to both sides inside the
   nonterminal.
4. Runs of a nonterminal are written to every place where it is derived. Each run of the text lies over
   the middle of the smallest nonterminal that holds it whole, so it is among them; the
   others are parts of one with the same period, and go.

Null texts count as empty; a text without words has no runs. Words are split at the six ASCII white
space characters only. Rows come back one for one, in any number, whatever their ids; other
columns are not read. A row's memory is linear in its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.batches import text_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# A run is this many words long at least, and this many times its period.
LEAST_WORDS = 6
LEAST_PERIODS = 4
# (nonterminal, period) pairs tried at once.
TRIED_AT_ONCE = 4_000_000

RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)


def _stretches(wanted: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the wanted rows and the stretch each lies in, without stretches too short for a run."""
    at = np.flatnonzero(wanted)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (part[at[1:]] != part[at[:-1]])
    stretch = np.cumsum(new) - 1
    long = np.bincount(stretch)[stretch] >= LEAST_WORDS
    return at[long], stretch[long]


def possible(codes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words that a run may hold, and their stretch. `part` rises from text to text."""
    at, stretch = _stretches(np.ones(len(codes), bool), part)
    while len(at):
        key = stretch.astype("int64") * (int(codes.max()) + 1) + codes[at]
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        often = counts[which] >= LEAST_PERIODS
        if often.all():
            break
        kept, cut = _stretches(often, stretch)
        at, stretch = at[kept], cut
    return at, stretch


class Grammar:
    """Nonterminals over concatenated stretches: `left`, `right`, `size`, and `at`, where each one stands once.

    Symbols below `words` are word ids. `roots` has one symbol per stretch and `starts` its place.
    """

    def __init__(self, codes: np.ndarray, stretch: np.ndarray):
        self.words = int(codes.max()) + 1
        self.left, self.right = [], []
        self.at, self.size = [np.zeros(self.words, "int64")], [np.ones(self.words, "int64")]
        self.rounds: list[tuple[int, int]] = []
        self._next = self.words
        symbols, stretch, places = codes.astype("int64"), stretch, np.arange(len(codes))
        sizes = np.ones(len(codes), "int64")
        while True:
            taken, which = self._frequent(symbols, stretch)
            if not len(taken):
                break
            symbols, stretch, places, sizes = self._replace(symbols, stretch, places, sizes, taken, which)
        while True:
            first = np.ones(len(symbols), bool)
            first[1:] = stretch[1:] != stretch[:-1]
            begin = np.flatnonzero(first)
            offset = np.arange(len(symbols)) - begin[np.cumsum(first) - 1]
            paired = np.zeros(len(symbols), bool)
            paired[:-1] = ~first[1:] & (offset[:-1] % 2 == 0)
            taken = np.flatnonzero(paired)
            if not len(taken):
                break
            symbols, stretch, places, sizes = self._replace(
                symbols, stretch, places, sizes, taken, np.arange(len(taken)))
        self.roots, self.starts = symbols, places
        empty = np.zeros(0, "int64")
        self.left = np.concatenate([empty, *self.left])
        self.right = np.concatenate([empty, *self.right])
        self.at, self.size = np.concatenate(self.at), np.concatenate(self.size)

    def _frequent(self, symbols, stretch) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs more frequent than those they overlap begin, and a number for each pair."""
        none = np.zeros(0, "int64")
        if len(symbols) < 2:
            return none, none
        inside = stretch[1:] == stretch[:-1]
        key = np.where(inside, symbols[:-1] * self._next + symbols[1:], -1)
        pairs, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        counts[pairs < 0] = 0
        order = np.lexsort((pairs, counts))
        rank = np.empty(len(pairs), "int64")
        rank[order] = np.arange(len(pairs))
        rank[counts < 2] = -1
        # Equal neighbours are one symbol again and again: every second of them is taken.
        value = rank[which]
        change = np.ones(len(value), bool)
        change[1:] = value[1:] != value[:-1]
        begin = np.flatnonzero(change)
        level = value[begin]
        before, after = np.concatenate([[-1], level[:-1]]), np.concatenate([level[1:], [-1]])
        best = (level >= 0) & (level > before) & (level > after)
        group = np.cumsum(change) - 1
        taken = np.flatnonzero(best[group] & ((np.arange(len(value)) - begin[group]) % 2 == 0))
        return taken, which[taken]

    def _replace(self, symbols, stretch, places, sizes, taken, which):
        """The sequence with a new symbol for each of the taken pairs."""
        _, one, number = np.unique(which, return_index=True, return_inverse=True)
        first = taken[one]
        made = sizes[first] + sizes[first + 1]
        self.left.append(symbols[first])
        self.right.append(symbols[first + 1])
        self.at.append(places[first])
        self.size.append(made)
        self.rounds.append((self._next, self._next + len(first)))
        symbols, sizes = symbols.copy(), sizes.copy()
        symbols[taken] = self._next + number
        sizes[taken] += sizes[taken + 1]
        self._next += len(first)
        stays = np.ones(len(symbols), bool)
        stays[taken + 1] = False
        return symbols[stays], stretch[stays], places[stays], sizes[stays]


def _equal_ahead(codes: np.ndarray, i: int, j: int, most: int) -> int:
    """How many words from places i and j on are equal, `most` at most."""
    done, step = 0, 16
    while done < most:
        n = min(step, most - done)
        differ = codes[i + done : i + done + n] != codes[j + done : j + done + n]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + n, step * 2
    return done


def _equal_behind(codes: np.ndarray, i: int, j: int, most: int) -> int:
    """How many words before places i and j are equal, `most` at most."""
    done, step = 0, 16
    while done < most:
        n = min(step, most - done)
        differ = codes[i - done - n : i - done] != codes[j - done - n : j - done]
        if differ.any():
            return done + int(differ[::-1].argmax())
        done, step = done + n, step * 2
    return done


def _trials(grammar: Grammar, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(nonterminal, periods to its right, periods to its left) that some words around the middle agree with."""
    sizes = grammar.size[grammar.words:]
    rules = np.flatnonzero(sizes >= LEAST_WORDS)
    most = np.maximum(sizes[rules] // LEAST_PERIODS, 1)
    ends = np.cumsum(most)
    begin = 0
    while begin < len(rules):
        upto = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, upto + TRIED_AT_ONCE, "right")))
        own, n = rules[begin:end], most[begin:end]
        rule = np.repeat(own, n)
        q = np.arange(1, int(n.sum()) + 1) - np.repeat(np.cumsum(n) - n, n)
        low = grammar.at[grammar.words + rule]
        middle = low + grammar.size[grammar.left[rule]]
        high = low + sizes[rule]

        def agree(first, q, fits):
            kept = np.flatnonzero(fits)
            for point in (lambda p: 0 * p, lambda p: p - 1, lambda p: p // 2, lambda p: p // 4, lambda p: p - 1 - p // 4):
                a = first[kept] + point(q[kept])
                kept = kept[codes[a] == codes[a + q[kept]]]
            return kept

        right = agree(middle, q, middle + 2 * q <= high)
        left = agree(middle - 2 * q, q, middle - 2 * q >= low)
        found = np.union1d(rule[right], rule[left])
        r0, r1 = np.searchsorted(rule[right], found, "left"), np.searchsorted(rule[right], found, "right")
        l0, l1 = np.searchsorted(rule[left], found, "left"), np.searchsorted(rule[left], found, "right")
        for i, x in enumerate(found.tolist()):
            yield x, q[right[r0[i] : r1[i]]], q[left[l0[i] : l1[i]]]
        begin = end


def _over_middle(codes: np.ndarray, low: int, middle: int, high: int, right: np.ndarray,
                 left: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs inside [low, high) that lie over the middle."""
    found: dict[tuple[int, int], int] = {}
    while len(right) or len(left):
        on_right = not len(left) or (len(right) > 0 and right[0] <= left[0])
        q = int(right[0] if on_right else left[0])
        first = middle if on_right else middle - 2 * q
        if on_right:
            right = right[1:]
        else:
            left = left[1:]
        ahead = _equal_ahead(codes, first, first + q, high - first - q)
        if ahead < q:
            continue
        start = first - _equal_behind(codes, first, first + q, first - low)
        end = first + q + ahead
        if start < middle < end and end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
            found.setdefault((start, end), q)
            # A multiple of the period whose words all lie in this run has the same run.
            right = right[(right % q != 0) | (middle + 2 * right > end)]
            left = left[(left % q != 0) | (middle - 2 * left < start)]
    return [(s, e, q) for (s, e), q in found.items()]


def runs_of(codes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts one after another, by start, then period."""
    none = np.zeros(0, "int64")
    at, stretch = possible(codes, part)
    if not len(at):
        return none, none, none
    inside = codes[at]
    grammar = Grammar(inside, stretch)
    rows = []
    for rule, right, left in _trials(grammar, inside):
        low = int(grammar.at[grammar.words + rule])
        middle = low + int(grammar.size[grammar.left[rule]])
        high = low + int(grammar.size[grammar.words + rule])
        for start, end, q in _over_middle(inside, low, middle, high, right, left):
            rows.append((grammar.words + rule, start - low, end - low, q))
    if not rows:
        return none, none, none
    start, end, q = _derived(grammar, np.array(rows, "int64"))
    start, end, q = _widest(start, end, q)
    return at[start], at[end - 1] + 1, q


def _derived(grammar: Grammar, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of nonterminals (symbol, start, end, period) at every place the symbol derives to."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    holds = np.zeros(len(grammar.size), bool)
    holds[rows[:, 0]] = True
    for low, high in grammar.rounds:
        a, b = low - grammar.words, high - grammar.words
        holds[low:high] |= holds[grammar.left[a:b]] | holds[grammar.right[a:b]]
    symbol, place = grammar.roots, grammar.starts
    made = []
    while True:
        kept = holds[symbol]
        symbol, place = symbol[kept], place[kept]
        if not len(symbol):
            break
        first = np.searchsorted(rows[:, 0], symbol, "left")
        n = np.searchsorted(rows[:, 0], symbol, "right") - first
        row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        shift = np.repeat(place, n)
        made.append((rows[row, 1] + shift, rows[row, 2] + shift, rows[row, 3]))
        left = grammar.left[symbol - grammar.words]
        right = grammar.right[symbol - grammar.words]
        symbol, place = np.concatenate([left, right]), np.concatenate([place, place + grammar.size[left]])
    return tuple(np.concatenate(c) for c in zip(*made))


def _widest(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that no other of the same period holds, by start, then period."""
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    _, number = np.unique(q, return_inverse=True)
    reach = end + number * (int(end.max()) + 1)
    wide = np.ones(len(reach), bool)
    wide[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    start, end, q = start[wide], end[wide], q[wide]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _candidates(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that occur often enough in their text, and their ids among a batch's such words."""
    own: dict[str, int] = {}
    codes = np.array([own.setdefault(w, len(own)) for w in words], dtype="int64")
    often = np.bincount(codes, minlength=1)[codes] >= LEAST_PERIODS if len(codes) else codes.astype(bool)
    at, _ = _stretches(often, np.zeros(len(codes), "int64"))
    if not len(at):
        return at, at
    used = np.unique(codes[at])
    number = np.zeros(len(own), "int64")
    names = list(own)
    number[used] = [known.setdefault(names[c], len(known)) for c in used.tolist()]
    return at, number[codes[at]]


def runs_of_texts(texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per list of words (start, end, period) of its runs."""
    known: dict[str, int] = {}
    found = [_candidates(words, known) for words in texts]
    counts = [len(at) for at, _ in found]
    if not sum(counts):
        return [(np.zeros(0, "int64"),) * 3] * len(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    at, codes = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    # Another part begins with each text and behind each word left out.
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (np.diff(at) != 1)
    start, end, q = runs_of(codes, np.cumsum(new))
    owner = text[start]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    first, last = at[start], at[end - 1] + 1
    return [tuple(x[a:b] for x in (first, last, q)) for a, b in zip(cuts[:-1], cuts[1:])]


def collapsed(words: list[str], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> str:
    """The words joined by one space, each run cut to its first period."""
    if not len(runs[0]):
        return " ".join(words)
    change = np.zeros(len(words) + 1, "int64")
    np.add.at(change, runs[0] + runs[2], 1)
    np.add.at(change, runs[1], -1)
    dropped = np.cumsum(change[:-1]) > 0
    return " ".join([words[i] for i in np.flatnonzero(~dropped).tolist()])


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, `runs` (start, length, period, in words) by start, then period, and the `collapsed` text."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = T.StructType([rows.schema["id"], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for b in batches:
            for part, texts in text_groups(b, "text"):
                words = [WORD.findall(t or "") for t in texts]
                runs = runs_of_texts(words)
                ends = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])]).astype("int32")
                start, end, q = (np.concatenate([r[i] for r in runs]) for i in (0, 1, 2))
                fields = [pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]
                values = pa.StructArray.from_arrays([pa.array(x) for x in (start, end - start, q)], fields=fields)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(ends), values),
                     pa.array([collapsed(w, r) for w, r in zip(words, runs)], type=pa.string())],
                    names=["id", "runs", "collapsed"],
                )

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_column)
