"""Spelling variants: a vocabulary acceptor composed with a one-edit transducer and itself.

Words are runs of letters, counted over all texts. Two words are near if one inserted, deleted or
replaced code point makes one of the other. The pairs are the accepted paths of V o E o V, where V
accepts the vocabulary and E copies but for one edit.

* ``partitions`` deals the words out by initial state. A pair's edit stands at its *place*, the
  length of the longest common prefix. For a pair whose shorter word has ``m`` letters the places
  ``0 .. m`` are cut into stretches ``[lo, hi)``: words that are near with a place in one share
  their first ``lo`` and their last ``m - hi`` letters. These letters are the initial state, and
  every word goes to the partition of its state, once for each stretch and for ``m`` its own length
  and one less. Two stretches do at first; a state with too many words has its stretch halved,
  which makes the shared letters more, until a partition fits. A stretch of one place leaves no
  more than two words for each letter of the alphabet, so this always ends.
* ``_near_words`` takes sorted partitions, some thousand words at a time, and works by layers of
  equal remaining length on flat arrays. It builds the minimal acceptor from the last letters up
  (states with equal right languages are one), composes it with the edit from the initial states
  down, trims pairs of states that accept nothing together, and enumerates the words along what is
  left. Offsets on the arcs number the words. Each task adds up a word's near words and its largest
  one, so pairs never leave it.

Words hold letters up to U+00FF only, one byte each. Nulls: a null text has no words, a null
``doc_id`` counts as an empty one. Empty texts and tables give no rows. Long texts and long runs
are words like others, of any length. Ties between near words of equal count go to the smaller
word. Repeated rows count again. Further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import Scratch, mix

# The letters of a word, the least length and count, how much larger a form must be,
# and the share of runs that lose a letter.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES, SLIP = 7, 2, 10, 31

#: Letters of a partition (words times width) above which its stretch is halved.
PARTITION_LETTERS = 1 << 21
#: Letters that one composition takes at a time.
CHUNK_LETTERS = 1 << 20
#: 10 to the power 19 passes any count, and 2 to the power 5 steps pass 19.
MOST_ROUNDS = 5

_ITEM = "m int, lo int, hi int, state string, word string, n long"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all texts: letter runs, of which one in 31 loses a letter by its hash."""
    runs = F.regexp_extract_all(text_col, F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")
    ).select("id", F.translate("run", upper, upper.lower()).alias("run"))
    hashed = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % SLIP == 0, less).otherwise(F.col("run"))
    kept = hashed.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return kept.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _state(m: Column, lo: Column, hi: Column) -> Column:
    """The letters that words with a place in the stretch share."""
    tail = F.greatest(m - hi, F.lit(0))
    word = F.col("word")
    return F.concat(
        F.substr(word, F.lit(1), lo), F.lit("|"), F.substr(word, F.length(word) - tail + 1, tail)
    )


def _dealt(items: DataFrame) -> DataFrame:
    """Items ``(m, lo, hi, word, n)`` with their initial state."""
    m, lo, hi = F.col("m"), F.col("lo"), F.col("hi")
    return items.select("m", "lo", "hi", _state(m, lo, hi).alias("state"), "word", "n")


def partitions(vocabulary: DataFrame, scratch: Scratch, letters: int = PARTITION_LETTERS) -> DataFrame:
    """Items ``(m, lo, hi, state, word, n)``; no state has more letters than ``letters`` unless it
    has a single place."""
    length = F.length("word")
    middle = F.call_function("div", F.col("m") + 1, F.lit(2)).cast("int")
    stretches = lambda lo, mid, hi: F.explode(F.array(
        F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi"))
    ))
    items = (
        vocabulary.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
        .filter(F.col("m") >= LEAST_LENGTH)
        .select("word", "n", "m", stretches(F.lit(0), middle, F.col("m") + 1).alias("s"))
        .select("word", "n", "m", "s.lo", "s.hi")
    )
    items, done, turn = _dealt(items), None, 0
    while True:
        # By hash, which can only make a state look larger than it is.
        key = F.xxhash64("m", "lo", "hi", "state").alias("key")
        wide = F.col("hi") - F.col("lo") > 1
        sizes = items.filter(wide).groupBy(key, "m").agg(F.count("*").alias("words"))
        large = sizes.filter(F.col("words") * (F.col("m") + 1) > letters).select("key")
        large = scratch.keep(large, f"large-{turn}")
        if large.isEmpty():
            return items if done is None else done.unionByName(items)
        keyed = items.withColumn("key", key)
        fits = keyed.join(large, "key", "left_anti").drop("key")
        split = keyed.join(large, "key", "left_semi").select(
            "word", "n", "m",
            stretches(F.col("lo"), F.call_function("div", F.col("lo") + F.col("hi"), F.lit(2)).cast("int"), F.col("hi")).alias("s"),
        ).select("word", "n", "m", "s.lo", "s.hi")
        done = fits if done is None else done.unionByName(fits)
        done = scratch.keep(done, f"fits-{turn}")
        items = scratch.keep(_dealt(split), f"split-{turn}")
        turn += 1


class Acceptor:
    """The minimal acceptor of sorted words, by layers of equal remaining length.

    ``letters`` holds a word a row from the left, ``first`` tells where words of another root begin;
    rows are sorted by root (one for each partition and length) and word. ``nodes[r]`` are the rows
    that start a new prefix with ``r`` letters to come, ``states[r]`` the state of each. Arcs of
    layer ``r`` lead to states of layer ``r - 1``; ``offset`` counts the words of smaller letters.
    """

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, first: np.ndarray):
        self.letters, self.lengths = letters, lengths
        same = np.full(len(letters), -1)
        if len(letters) > 1:
            same[1:] = (letters[1:] != letters[:-1]).argmax(axis=1)
        same[first] = -1
        depth = int(lengths.max(initial=0))
        self.nodes, self.states, self.arcs, self.number = [], [], [], []
        for r in range(depth + 1):
            starts = (lengths >= r) & (same < lengths - r)
            rows = np.flatnonzero(starts)
            if r == 0:
                self._add(rows, np.zeros(len(rows), np.int64), None, 1)
                continue
            child = np.flatnonzero(lengths[self.nodes[-1]] >= r)
            at = self.nodes[-1][child]
            parent = (np.cumsum(starts) - 1)[at]
            label = letters[at, lengths[at] - r].astype(np.int64)
            self._merge(rows, parent, label, self.states[-1][child], at)

    def _add(self, rows, states, arcs, number):
        self.nodes.append(rows), self.states.append(states)
        self.arcs.append(arcs), self.number.append(number)

    def _merge(self, rows, parent, label, target, at):
        """Nodes with equal arcs are one state: found by hash, then compared arc by arc."""
        code = target * 256 + label
        begin = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else parent
        degree = np.diff(np.append(begin, len(parent)))
        place = np.arange(len(parent)) - begin[parent]
        sign = np.add.reduceat(mix(code.astype(np.uint64) + np.uint64(1)), begin) if len(parent) else begin
        _, chosen, state = np.unique(sign, return_index=True, return_inverse=True)
        like = chosen[state]
        alike = degree == degree[like]
        inside = alike[parent]
        other = begin[like[parent[inside]]] + place[inside]
        differ = parent[inside][code[other] != code[inside]]
        alike[differ] = False
        lone = np.flatnonzero(~alike)  # equal hashes, other arcs: a state of its own
        state[lone] = len(chosen) + np.arange(len(lone))
        chosen = np.concatenate([chosen, lone])
        size = degree[chosen]
        arc = np.repeat(begin[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())
        arcs = {
            "begin": np.cumsum(size) - size, "degree": size, "label": label[arc],
            "target": target[arc], "offset": at[arc] - rows[parent[arc]],
            "key": np.repeat(np.arange(len(chosen)), size) * 256 + label[arc],
        }
        self._add(rows, state, arcs, len(chosen))

    def steps(self, r: int, one: np.ndarray, s: int, two: np.ndarray):
        """Arcs of equal letters of states ``one`` of layer ``r`` and ``two`` of layer ``s``.

        ``(which, arc of one, arc of two)``.
        """
        which, arc = self.out(r, one)
        key = two[which] * 256 + self.arcs[r]["label"][arc]
        known = self.arcs[s]["key"]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        met = known[at] == key
        return which[met], arc[met], at[met]

    def out(self, r: int, states: np.ndarray):
        """All arcs of states: ``(which, arc)``."""
        arcs = self.arcs[r]
        size = arcs["degree"][states]
        which = np.repeat(np.arange(len(states)), size)
        arc = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + arcs["begin"][states][which]
        return which, arc


def _edits(v: Acceptor, root: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Right behind the edit: ``layer -> [(row, state, row, state, depth, dropped)]``.

    ``root`` is the partition of each row. A replaced letter leads to two arcs of one node of the
    shorter length ``m``. A dropped one leads along an arc of the longer words' node, while the
    shorter words stay at the node of the same prefix.
    """
    found = [[] for _ in v.nodes]
    lengths = v.lengths
    for r in range(1, len(v.nodes)):  # replaced
        child = np.flatnonzero(lengths[v.nodes[r - 1]] >= r)
        at = v.nodes[r - 1][child]
        state = v.states[r - 1][child]
        depth = lengths[at] - r
        inside = (lengths[at] == m[at]) & (depth >= lo[at]) & (depth < hi[at])
        parent = np.searchsorted(v.nodes[r], at, side="right") - 1
        at, state, parent, depth = at[inside], state[inside], parent[inside], depth[inside]
        if len(at) < 2:
            continue
        begin = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        two = np.repeat(np.arange(len(at)), place)
        one = np.arange(len(two)) - np.repeat(np.cumsum(place) - place, place) + (two - place[two])
        found[r - 1].append((at[one], state[one], at[two], state[two], depth[one], np.zeros(len(one), bool)))

    heads = np.flatnonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (lengths[1:] != lengths[:-1])]))
    pair = np.flatnonzero((root[heads[1:]] == root[heads[:-1]]))
    shorter, longer = heads[pair], heads[pair + 1]
    state_of = lambda r, row: v.states[r][np.searchsorted(v.nodes[r], row)]
    empty = np.empty(0, np.int64)
    a, sa, b, sb = empty, empty, empty, empty
    for r in range(len(v.nodes) - 1, 0, -1):  # dropped: longer words at r, shorter ones at r - 1
        new = lengths[longer] == r
        if new.any():
            x, y = longer[new], shorter[new]
            a, sa = np.concatenate([a, x]), np.concatenate([sa, state_of(r, x)])
            b, sb = np.concatenate([b, y]), np.concatenate([sb, state_of(r - 1, y)])
        if not len(a):
            continue
        depth = lengths[a] - r
        inside = np.flatnonzero((depth >= lo[a]) & (depth < hi[a]))
        which, arc = v.out(r, sa[inside])
        which = inside[which]
        arcs = v.arcs[r]
        found[r - 1].append((
            a[which] + arcs["offset"][arc], arcs["target"][arc], b[which], sb[which], depth[which],
            np.ones(len(which), bool),
        ))
        on = np.flatnonzero(depth + 1 < hi[a])
        if r == 1 or not len(on):
            a, sa, b, sb = empty, empty, empty, empty
            continue
        which, arc, other = v.steps(r, sa[on], r - 1, sb[on])
        which, below = on[which], v.arcs[r - 1]
        a, sa = a[which] + arcs["offset"][arc], arcs["target"][arc]
        b, sb = b[which] + below["offset"][other], below["target"][other]
    return [
        tuple(np.concatenate(part) for part in zip(*f)) if f else tuple([empty] * 5 + [np.empty(0, bool)])
        for f in found
    ]


def near_pairs(v: Acceptor, root: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Rows ``(one, two)`` one edit apart, its depth, and whether ``one`` has the letter more."""
    starts = _edits(v, root, m, lo, hi)
    top = len(v.nodes)
    pairs, moves = [None] * top, [None] * top
    carried = np.empty(0, np.int64)
    for r in range(top - 1, -1, -1):  # states reachable together, from the edits down
        codes = np.concatenate([starts[r][1] * v.number[r] + starts[r][3], carried])
        pairs[r] = np.unique(codes)
        if r:
            one, two = pairs[r] // v.number[r], pairs[r] % v.number[r]
            arcs = v.arcs[r]
            which, arc, other = v.steps(r, one, r, two)
            carried = arcs["target"][arc] * v.number[r - 1] + arcs["target"][other]
            moves[r] = (which, carried, arcs["offset"][arc], arcs["offset"][other])
    alive = [np.ones(len(pairs[0]), bool)]
    for r in range(1, top):  # trimmed from the end up
        which, code, off1, off2 = moves[r]
        to = np.searchsorted(pairs[r - 1], code)
        lives = alive[r - 1][to]
        which, to, off1, off2 = which[lives], to[lives], off1[lives], off2[lives]
        count = np.bincount(which, minlength=len(pairs[r]))
        alive.append(count > 0)
        moves[r] = (np.cumsum(count) - count, count, to, off1, off2)
    empty = np.empty(0, np.int64)
    a, b, at, d, more = empty, empty, empty, empty, np.empty(0, bool)
    for r in range(top - 1, -1, -1):
        x, sx, y, sy, depth, dropped = starts[r]
        where = np.searchsorted(pairs[r], sx * v.number[r] + sy)
        lives = alive[r][where]
        a, b = np.concatenate([a, x[lives]]), np.concatenate([b, y[lives]])
        at, d = np.concatenate([at, where[lives]]), np.concatenate([d, depth[lives]])
        more = np.concatenate([more, dropped[lives]])
        if r:
            begin, count, to, off1, off2 = moves[r]
            size = count[at]
            which = np.repeat(np.arange(len(at)), size)
            step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[at][which]
            a, b = a[which] + off1[step], b[which] + off2[step]
            at, d, more = to[step], d[which], more[which]
    return a, b, d, more


def _chunk(words: list[bytes], n: np.ndarray, state: np.ndarray, m, lo, hi):
    """``(number of near words, row of the best or -1)`` for each row of some whole partitions."""
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max())
    # The side with more shared letters comes first, so that few states are open at the edit.
    tail = np.maximum(m - hi, 0)
    turned = lo < tail
    oriented = np.array([w[::-1] if t else w for w, t in zip(words, turned)], f"S{width}")
    order = np.lexsort((oriented, lengths, state))
    root, length = state[order], lengths[order]
    letters = np.ascontiguousarray(oriented[order]).view(np.uint8).reshape(len(words), width)
    first = np.concatenate([[True], (root[1:] != root[:-1]) | (length[1:] != length[:-1])])
    m, lo, hi, tail, turned = m[order], lo[order], hi[order], tail[order], turned[order]
    begin, end = np.where(turned, tail, lo), np.where(turned, m + 1, hi)
    a, b, depth, dropped = near_pairs(Acceptor(letters, length, first), root, m, begin, end)

    # A letter dropped from a run of equal ones counts at the end of the common prefix only, and in
    # the stretch that holds its place in the word as it is read.
    check = np.flatnonzero(dropped)
    if len(check):
        x, y = a[check], b[check]
        good = (letters[x] != letters[y]).argmax(axis=1) == depth[check]
        back = np.flatnonzero(turned[x] & good)
        x, y = x[back], y[back]
        equal = np.ones(len(back), bool)
        for j in range(int(hi[x].max(initial=0))):
            near = hi[x] > j
            same = letters[x, np.maximum(length[x] - 1 - j, 0)] == letters[y, np.maximum(length[y] - 1 - j, 0)]
            equal &= same | ~near
        good[back[equal]] = False
        kept = ~dropped
        kept[check[good]] = True
        a, b = a[kept], b[kept]

    straight = np.array(words, f"S{width}")[order]
    ranked = np.lexsort((straight, -n[order]))
    rank = np.empty(len(words), np.int64)
    rank[ranked] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, a, rank[b])
    np.minimum.at(best, b, rank[a])
    count = np.bincount(a, minlength=len(words)) + np.bincount(b, minlength=len(words))
    number, chosen = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    number[order] = count
    chosen[order] = np.where(count > 0, order[ranked[np.minimum(best, len(words) - 1)]], -1)
    return number, chosen


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items sorted by partition to ``(word, n_near, best_n, best)``: whole partitions at a time."""

    def settle(table: pa.Table, last: bool):
        """What is complete, and the rows of a partition that may go on."""
        m = table.column("m").to_numpy()
        state = pa.chunked_array(table.column("state")).combine_chunks()
        lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
        codes = state.dictionary_encode().indices.to_numpy()
        change = (codes[1:] != codes[:-1]) | (m[1:] != m[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [len(m)]])
        if not last:
            bounds = bounds[:-1]
        group = np.cumsum(np.concatenate([[0], change]))
        at = 0
        while at < len(bounds) - 1:
            # As many partitions as fit, one at least.
            to = at + 1
            while to < len(bounds) - 1 and (bounds[to + 1] - bounds[at]) * (m[bounds[to]] + 1) <= CHUNK_LETTERS:
                to += 1
            cut = slice(bounds[at], bounds[to])
            part = table.slice(cut.start, cut.stop - cut.start)
            words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
            n = part.column("n").to_numpy()
            number, best = _chunk(
                words, n, group[cut], m[cut].astype(np.int64), lo[cut].astype(np.int64), hi[cut].astype(np.int64)
            )
            rows = np.flatnonzero(number)
            spelt = part.column("word").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [spelt.take(pa.array(rows)), pa.array(number[rows]), pa.array(n[best[rows]]),
                 spelt.take(pa.array(best[rows]))],
                ["word", "n_near", "best_n", "best"],
            )
            at = to
        rest[:] = table.slice(bounds[-1]).to_batches()

    rest: list[pa.RecordBatch] = []
    letters = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        letters += batch.num_rows * (batch.column(0)[batch.num_rows - 1].as_py() + 1)
        if letters >= 2 * CHUNK_LETTERS:
            yield from settle(pa.Table.from_batches(rest), False)
            letters = 0
    if rest:
        yield from settle(pa.Table.from_batches(rest), True)


def near_words(vocabulary: DataFrame, scratch: Scratch, letters: int = PARTITION_LETTERS) -> DataFrame:
    """``(word, n_near, best_n, best)`` for the words of ``(word, n)`` that have near words."""
    items = partitions(vocabulary, scratch, letters)
    key = ["m", "lo", "hi", "state"]
    sorted_items = items.repartition(*key).sortWithinPartitions(*key)
    found = sorted_items.mapInArrow(_near_words, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best")
    )


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, root)``: where the forms of ``(word, form)`` lead in the end.

    Every round doubles the steps. A form is ten times as frequent as its word, so no chain has 20.
    """
    hops = scratch.keep(forms.select("word", F.col("form").alias("root")), "hops-0")
    for turn in range(1, MOST_ROUNDS + 1):
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = hops.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        hops = scratch.keep(moved, f"hops-{turn}")
        if hops.filter("moved").isEmpty():
            break
        hops = hops.drop("moved")
    return hops.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: one row per word of all texts."""
    scratch = Scratch(docs.sparkSession, "variants")
    vocabulary = scratch.keep(words(docs, id_col, text_col), "words")
    near = near_words(vocabulary, scratch)
    enough = F.col("best_n") >= FORM_TIMES * F.col("n")
    formed = scratch.keep(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"),
        ),
        "formed",
    )
    ends = roots(formed.filter("form is not null"), scratch)
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
