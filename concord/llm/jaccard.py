"""Jaccard join of word shingle sets with prefix trees, and the components of its links.

The width of a shingle in words and the least similarity in percent are parameters. A shingle is a 64-bit hash; hash order is the global order of all sets. Equal sets collapse into one node first.

Candidates. The smallest `SKETCH` shingles of a set are its sketch. Of the smallest SKETCH shingles of a union, each is
in both sets with probability J, and if it is, it is in both sketches. So linked pairs of large sets share
at least `usually_shared` sketch shingles (8 at 85 %, 6 at 80 %) but for a chance under `MISSED` (binomial tail), and sets of at most
SKETCH shingles share `least_shared` of them with certainty (about the percentage asked for, less what a larger partner's sketch
leaves out). By the prefix principle, with a set's sketch shingles in the order of their frequency, two such sets meet in one of the
first (size - shared + 1), so the most common shingles (boilerplate) are never keys, and sets with too few shingles known to any other
set drop out at once.

Verification. Sets that meet are stored in a prefix tree over the global order. A probe walks it once: sets with a
common beginning share the overlap counted so far, and a subtree is cut off when what remains, of the probe or of the
subtree's longest set, cannot reach the overlap that its shortest set asks for.

Order of work. Round A merges sets that meet in one of two keys of each set; as only components are asked for, sets of
one component are not compared again. Round B takes every other key whose sets are still in two or more components:
pairs from small groups, and large groups in blocks, the minority's against all. No group has to fit into one task,
no pairs within a component are made, nothing is capped.

Blocks of round A share one set of their group, so a large group of copies of one text is whole after it. Keys, sets and copies
with most rows are joined by broadcast (the HEAVY largest), so no task gets all rows of one.

Null and empty texts and texts without words have empty sets and are their own components; a text of any length is one set; equal
rows are one node; a null id counts as larger than all others; other columns are passed on (`one_of_each`) or not looked at,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH, PERCENT = 4, 85
#: Shingles of a sketch, and the chance that a linked pair of larger sets is missed.
SKETCH, MISSED = 32, 1e-14
#: Groups of at most so many sets are compared as pairs (one comparison for all keys that a pair shares).
PAIRS_UP_TO = 16
#: Tokens of a segment before the bound is tested.
HEAD = 64
#: Shingles that a block of a large group has, about; a task holds two blocks.
BLOCK = 400_000


def shingle_sets(text: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, at = C.split_words(pc.ascii_lower(text))
    codes, words = C.encode(flat)
    word = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[codes] if len(words) else np.zeros(0, np.uint64)
    n = len(word)
    h = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(h)])
    out = []
    for a, b in itertools.pairwise(at.tolist()):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in word[a:b]:
                x = C.mix(np.array([x ^ w]))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Forest:
    """Prefix trees over the sorted sets of several groups, walked for one probe of each group at a time.

    A tree is kept as segments: in lexicographic order, a set adds the tokens after what it has in common with the set
    before, and hangs on the segment that this common part ends in. A walk goes down level by level, all trees at once:
    a segment starts with the overlap counted at its place on its parent, so common beginnings are counted once. After
    a segment's first tokens the bound is tested: if what is left of the probe, or of the longest set below, cannot
    reach the overlap that the shortest set below asks for, the rest of the segment and all that hangs on it is cut."""

    def __init__(self, groups: list[list[np.ndarray]], percent: int = PERCENT):
        self.percent = percent
        self.first = np.cumsum([0, *map(len, groups)])  # of each group's sets, which are numbered through
        self.group = np.repeat(np.arange(len(groups)), np.diff(self.first))
        n = len(self.group)
        self.n = np.array([len(s) for g in groups for s in g], np.int64)
        codes, base = [], [0]
        for g in groups:  # tokens as their ranks within the group
            kinds, code = np.unique(np.concatenate(g), return_inverse=True)
            codes.append(code + base[-1])
            base.append(base[-1] + len(kinds))
        self.base, flat = np.array(base), np.concatenate(codes)
        at = np.r_[0, np.cumsum(self.n)]
        self.sets = [flat[a:b] for a, b in itertools.pairwise(at.tolist())]
        self.shared, self.parent, self.level = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        self.least, self.most = self.n.copy(), self.n.copy()
        order = []
        for g in range(len(groups)):
            own = sorted(range(self.first[g], self.first[g + 1]), key=lambda i: self.sets[i].astype(">u4").tobytes())
            stack: list[int] = []
            for k, i in enumerate(own):
                if k:
                    x, y = self.sets[own[k - 1]], self.sets[i]
                    m = min(len(x), len(y))
                    differ = x[:m] != y[:m]
                    d = int(differ.argmax())
                    self.shared[i] = common = d if m and differ[d] else m
                    while stack and self.shared[stack[-1]] >= common:
                        stack.pop()
                    if stack:
                        self.parent[i], self.level[i] = stack[-1], self.level[stack[-1]] + 1
                stack.append(i)
            order += own
        for i in reversed(order):
            if (q := self.parent[i]) >= 0:
                self.least[q], self.most[q] = min(self.least[q], self.least[i]), max(self.most[q], self.most[i])
        own = self.n - self.shared
        self.head = np.minimum(own, HEAD)  # tokens before the bound is tested, and after
        self.tail = own - self.head
        self.head_at, self.tail_at = np.r_[0, np.cumsum(self.head)], np.r_[0, np.cumsum(self.tail)]
        self.head_tokens = flat[C.ragged(at[:-1] + self.shared, self.head)]
        self.tail_tokens = flat[C.ragged(at[:-1] + self.shared + self.head, self.tail)]
        self.levels = [np.flatnonzero(self.level == k) for k in range(int(self.level.max(initial=0)) + 1)]

    def walk(self, probes: np.ndarray) -> np.ndarray:
        """probes: for each group the number of its probe or -1. True for the sets that are linked with their group's."""
        use = probes[probes >= 0]
        mask = np.zeros(int(self.base[-1]), bool)
        mask[np.concatenate([self.sets[i] for i in use])] = True
        upto = np.r_[0, np.cumsum(mask)]
        probe = probes[self.group]
        on = probe >= 0
        size = np.where(on, self.n[probe], 0)
        head = np.r_[0, np.cumsum(mask[self.head_tokens])]
        tail = np.zeros(max(1, len(self.tail_tokens)), np.int64)  # counts from the beginning of each tail
        start, total = np.zeros(len(self.n), np.int64), np.full(len(self.n), -1)
        walked = np.zeros(len(self.n), bool)  # the tail was counted
        p = self.percent
        least = np.maximum(self.least, -(-p * size // 100))
        need = -(-p * (size + least) // (100 + p))
        fits = on & (100 * self.most >= p * size) & (100 * size >= p * self.least)
        for segments in self.levels:
            s = segments[fits[segments]]
            q = self.parent[s]
            deep = np.where(q >= 0, self.shared[s] - self.shared[q], 0)
            in_head = deep <= self.head[q]
            beyond = np.maximum(deep - self.head[q], 0)
            near = start[q] + head[self.head_at[q] + np.minimum(deep, self.head[q])] - head[self.head_at[q]]
            far = near + tail[np.clip(self.tail_at[q] + beyond - 1, 0, len(tail) - 1)]
            start[s] = np.where(q < 0, 0, np.where(in_head, near, far))
            lost = (q >= 0) & (~fits[q] | ~in_head & ~walked[q])
            fits[s[lost]] = False
            s = s[~lost]
            got = start[s] + head[self.head_at[s + 1]] - head[self.head_at[s]]
            depth = self.shared[s] + self.head[s]
            last = np.where(self.head[s] > 0, self.head_tokens[np.maximum(self.head_at[s + 1] - 1, 0)] if len(self.head_tokens) else 0, self.base[self.group[s]] - 1)
            left = size[s] - (upto[last + 1] - upto[self.base[self.group[s]]])
            ok = (got + np.minimum(left, self.most[s] - depth) >= need[s]) | (self.head[s] == 0)
            ok &= self.tail[s] > 0
            more = s[ok]
            if len(more):
                at = C.ragged(self.tail_at[more], self.tail[more])
                hit = np.cumsum(mask[self.tail_tokens[at]])
                ends = np.cumsum(self.tail[more]) - 1
                tail[at] = run = hit - np.repeat(np.r_[0, hit[ends[:-1]]], self.tail[more])
                walked[more] = True
                total[more] = got[ok] + run[ends]
            done = self.tail[s] == 0
            total[s[done]] = got[done]
        return on & (total >= 0) & (100 * total >= p * (size + self.n - total)) & (probe != np.arange(len(self.n)))


class Merger:
    """Which set of a group probes next. The component with the fewest open sets probes all others with each of its sets
    and is then done: whatever it links with is known, and is merged. The last component has nothing left to probe."""

    def __init__(self, component: list[int], runs: int | None = None):
        self.home = dict(enumerate(component))
        self.open: dict[int, list[int]] = {}
        for i, c in self.home.items():
            self.open.setdefault(c, []).append(i)
        self.heap = [(len(v), c) for c, v in self.open.items()]
        heapq.heapify(self.heap)
        self.mine: list[int] = []
        self.met: dict[int, None] = {}
        self.runs = runs

    def next(self) -> tuple[int | None, list[int]]:
        """The next probe (None: all is known), and the sets that are no longer to be found."""
        if self.mine and len(self.met) < len(self.open):  # else all others are met, and one component is left
            return self.mine.pop(), []
        self.mine = []
        if len(self.met) > 1:
            first, *rest = sorted(self.met, key=lambda k: (-len(self.open[k]), k))
            for k in rest:
                for j in self.open[k]:
                    self.home[j] = first
                self.open[first] += self.open.pop(k)
            heapq.heappush(self.heap, (len(self.open[first]), first))
        self.met = {}
        if self.runs == 0:
            return None, []
        while len(self.open) > 1:
            size, c = heapq.heappop(self.heap)
            if c in self.open and len(self.open[c]) == size:
                gone = self.open.pop(c)
                self.mine = gone[:]
                self.runs = self.runs and self.runs - 1
                return self.mine.pop(), gone
        return None, []

    def hit(self, j: int) -> bool:
        """Whether the link to j is news."""
        new = self.home[j] not in self.met
        self.met[self.home[j]] = None
        return new


def links(groups: list[list[np.ndarray]], components: list[list[int]], runs: int | None = None, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(group, i, j): links between sets of different components, one for each merger that they bring about.

    runs: stop after so many components have probed."""
    out = []
    mergers = [Merger(c, runs) for c in components]
    active = [g for g, c in enumerate(components) if len(set(c)) > 1]
    if not active:
        return out
    forest, number = Forest(groups, percent), None
    live = np.ones(len(forest.group), bool)
    while active:
        probes = np.full(len(groups), -1)
        still = []
        for g in active:
            i, gone = mergers[g].next()
            at = forest.first[g] if number is None else 0
            place = (lambda k: number[k]) if number is not None else (lambda k, at=at: at + k)
            for k in gone:
                live[place(k)] = False
            if i is not None:
                probes[g] = place(i)
                still.append(g)
        active = still
        if not active:
            break
        found = np.flatnonzero(forest.walk(probes) & live)
        for g, j in zip(forest.group[found].tolist(), found.tolist(), strict=True):
            own, other = probes[g], j
            a, b = (back[own], back[other]) if number is not None else (own - forest.first[g], other - forest.first[g])
            if mergers[g].hit(int(b)):
                out.append((g, int(a), int(b)))
        if len(groups) == 1 and not mergers[0].mine and 64 < 2 * live.sum() < len(live):  # the done sets leave the tree
            old = back if number is not None else np.arange(len(live))
            back = old[live]
            number = dict(zip(back.tolist(), range(len(back)), strict=True))
            forest = Forest([[groups[0][k] for k in back.tolist()]], percent)
            live = np.ones(len(back), bool)
    return out


EDGE = "a bigint, b bigint"
#: So many edges are joined up by one task; more of them in rounds over all executors.
EDGES_IN_A_TASK = 500_000


def components(edges: DataFrame, one_task: int = EDGES_IN_A_TASK) -> DataFrame:
    """(node, comp) of every node of the stored edges (a, b): the least node that it reaches."""
    return _in_one_task(edges) if edges.limit(one_task + 1).count() <= one_task else _in_rounds(edges)


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            above.setdefault(x, x)
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                a, b = top(a), top(b)
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "comp"])

    return C.stored(edges.coalesce(1).mapInArrow(run, "node bigint, comp bigint"), "labels")


def _in_rounds(edges: DataFrame) -> DataFrame:
    """Labels spread along edges and jump to their label's label, so the rounds grow with the logarithm of a chain's
    length; each round is stored."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = C.stored(both.distinct(), "edges", few=True)
    now = C.stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), "labels", few=True)
    while True:
        near = both.join(now.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        jump = now.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        after = now.join(near, "node").join(jump, "comp", "left")
        after = after.select("node", F.least("near", F.coalesce("next", "comp"), "comp").alias("comp"), F.col("comp").alias("was"))
        after = C.stored(after, "labels", few=True)
        if after.where("comp != was").isEmpty():
            return after.select("node", "comp")
        now = after.select("node", "comp")


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, __file, __row, n (size of the set), digest (of the set, null if empty), sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(C.texts_of(batch), width)
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        heads = [s[:SKETCH].view(np.int64) for s in sets]
        sketch = pa.ListArray.from_arrays(np.cumsum([0, *map(len, heads)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *heads]))
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["__file"], batch["__row"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), sketch], ["doc_id", "__file", "__row", "n", "digest", "sketch"])

    return C.map_arrow(C.located(docs, "doc_id", "text"), sign, f"doc_id {kind}, __file bigint, __row bigint, n bigint, digest binary, sketch array<bigint>", C.SMALL_SLICE)


def _raw(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, set) for the nodes; their texts are read again at the stored places."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["node"], batch["n"], pa.array([_raw(s) for s in shingle_sets(C.texts_of(batch), width)], pa.binary())], ["node", "n", "set"])

    rows = C.by_place(C.located(docs, "text"), nodes)
    return C.stored(C.map_arrow(rows.select("node", "n", "text"), compute, "node bigint, n bigint, set binary", C.SMALL_SLICE), "sets")


def _edges(tables: list[pa.Table], components: list[list[int]], percent: int, runs: int | None = None) -> pa.Table:
    nodes = [t["node"].to_pylist() for t in tables]
    sets = [[np.frombuffer(x, "<u8") for x in t["set"].to_pylist()] for t in tables]
    found = links(sets, components, runs, percent)
    return pa.table({"a": pa.array([nodes[g][i] for g, i, _ in found], pa.int64()), "b": pa.array([nodes[g][j] for g, _, j in found], pa.int64())})


def _join(tables: list[pa.Table], percent: int) -> pa.Table:
    """Links between the components of the sets of each group."""
    tables = [t for t in tables if t.num_rows > 1]
    return _edges(tables, [t["comp"].to_pylist() for t in tables], percent)


def _verify(tables: list[pa.Table], percent: int) -> pa.Table:
    """Links of one set of each group, whose node is the group's key, with the others."""
    return _edges(tables, [[-1 if x == t["a"][0].as_py() else x for x in t["node"].to_pylist()] for t in tables], percent, runs=1)


def usually_shared(percent: int = PERCENT) -> int:
    """The most sketch shingles that a pair at the least similarity shares but for a chance under MISSED."""
    p, chance = percent / 100, 0.0
    for k in range(SKETCH + 1):
        chance += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if chance >= MISSED:
            return k
    return SKETCH


def least_shared(n: int, percent: int = PERCENT) -> int:
    """The least number of sketch shingles that a set of n <= SKETCH shingles shares with a set that it is linked with: the
    least overlap that their sizes ask for, less what the partner's sketch leaves out."""
    sizes = range(-(-percent * n // 100), 100 * n // percent + 1)
    return min(-(-percent * (n + m) // (100 + percent)) - max(0, m - SKETCH) for m in sizes)


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, df): the keys of each set that can have a link at all."""
    tokens = classes.select("node", "n", F.explode("sketch").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    small = F.array(*(F.lit(least_shared(n, percent)) for n in range(1, SKETCH + 1)))
    need = F.when(F.col("n") <= SKETCH, F.get(small, F.col("n") - 1)).otherwise(F.lit(usually_shared(percent))).cast("int")
    ordered = C.skew_join(tokens, C.stored(common, "common"), "token", "df").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))  # at most SKETCH entries
    keys = ordered.where(F.size("t") >= need).select("node", "n", F.inline(F.slice("t", F.lit(1), F.size("t") - need + 1)))
    return C.stored(keys, "keys", few=True)


def _blocks(keys: DataFrame, known: DataFrame | None) -> DataFrame:
    """(token, part, node): large groups in blocks of bounded size, so that any two sets of different components meet."""
    members = keys.select("token", "node", "n")
    if known is None:
        members = C.stored(members, "members", few=True)
        totals = members.groupBy("token").agg(F.count(F.lit(1)).alias("g"), F.ceil(F.sum("n") / BLOCK).alias("parts"), F.min("node").alias("pivot")).where("g > 1")
        dealt = C.skew_join(members, C.stored(totals, "groups", few=True), "token", "g")
        part = F.explode(F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts")))))
        return dealt.select("token", part.alias("part"), "node").select("token", F.col("part").cast("string").alias("part"), "node")
    members = C.stored(members.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "members", few=True)
    per = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("total"))
    most = per.groupBy("token").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("total", "comp")).alias("major"), F.sum("total").alias("total")).where(f"comps > 1 and g > {PAIRS_UP_TO}")
    cut = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    most = most.select("token", "g", F.col("major.comp").alias("major"), cut(F.col("major.total")).alias("k"), cut(F.col("total") - F.col("major.total")).alias("m"))
    dealt = C.skew_join(members, C.stored(most, "groups", few=True), "token", "g")
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    name = lambda kind, i, j: F.concat_ws(":", F.lit(kind), i.cast("string"), j.cast("string"))
    major = F.transform(upto("m"), lambda i: name("g", i, own("k")))
    against = F.transform(upto("k"), lambda j: name("g", own("m"), j))
    among = F.when(F.col("m") > 1, F.transform(upto("m"), lambda i: name("m", F.least(i, own("m")), F.greatest(i, own("m"))))).otherwise(F.array().cast("array<string>"))
    return dealt.select("token", F.explode(F.when(F.col("comp") == F.col("major"), major).otherwise(F.concat(against, among))).alias("part"), "node", "comp")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and __file, __row, digest."""
    if width < 1 or percent > 100 or not usually_shared(percent):
        raise ValueError("shingles have one word or more, and sketches find links from 64 % to 100 %")
    C.ready(docs.sparkSession)
    docs = C.plain(docs)
    signed = C.stored(signatures(docs, width), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row")).alias("first")
    classes = signed.where("n > 0").groupBy("digest").agg(least, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = C.stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # stored, so the number stays

    keys = _candidates(classes, percent)
    nodes = keys.select("node").distinct().join(classes.select("node", "n", "first"), "node").select("node", "n", "first.__file", "first.__row")
    sets = _sets_of(docs, C.stored(nodes, "nodes", few=True), width).select("node", "set")

    two = keys.groupBy("node", "n").agg(F.min("token").alias("x"), F.max(F.struct("df", "token")).alias("y"))
    two = two.select("node", "n", F.explode(F.array_distinct(F.array("x", "y.token"))).alias("token"))
    a = C.grouped(_blocks(two, None).withColumn("comp", F.col("node")).join(sets, "node"), ["token", "part"], partial(_join, percent=percent), EDGE)
    a = C.stored(a, "edges-a", few=True)
    known = components(a)

    small = keys.join(known, "node", "left").select("token", "node", "n", F.coalesce("comp", "node").alias("comp"))
    size = small.groupBy("token").agg(F.count(F.lit(1)).alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(f"lo != hi and g <= {PAIRS_UP_TO}").select("token")
    small = C.stored(small.join(size, "token", "left_semi"), "small-groups", few=True)  # at most PAIRS_UP_TO rows a key
    other = small.select("token", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    near = (F.col("node") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
    pairs = C.stored(small.join(other, "token").where(near).select(F.col("node").alias("a"), "b").distinct(), "pairs", few=True)  # groups of PAIRS_UP_TO at most
    shipped = pairs.select("a", F.col("b").alias("node")).unionByName(pairs.select("a", F.col("a").alias("node")).distinct())
    b = C.grouped(shipped.join(sets, "node"), ["a"], partial(_verify, percent=percent), EDGE)
    c = C.grouped(_blocks(keys, known).join(sets, "node"), ["token", "part"], partial(_join, percent=percent), EDGE)
    found = components(C.stored(a.unionByName(b).unionByName(c), "edges-b", few=False))

    own = classes.join(found, "node", "left").select("digest", "copies", F.coalesce("comp", "node").alias("comp"), "first")
    own = C.stored(own, "named")
    heads = own.groupBy("comp").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("sets"))
    ids = C.skew_join(own, C.stored(heads, "heads"), "comp", "sets").select("digest", "copies", "head")
    every = signed.select("doc_id", "n", "digest", "__file", "__row")
    out = C.skew_join(every.where("n > 0"), C.stored(ids, "ids"), "digest", "copies").drop("copies")
    out = out.unionByName(every.where("n = 0"), allowMissingColumns=True)
    mine = (F.col("head.__file") == F.col("__file")) & (F.col("head.__row") == F.col("__row"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), F.coalesce(mine, F.lit(True)).alias("first"), "digest", "__file", "__row")


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns."""
    docs = C.plain(docs)
    gone = C.stored(join(docs, width, percent).where("not first").select("__file", "__row"), "jaccard-gone")
    return C.by_place(C.whole(docs), gone, "left_anti").select("__all.*")
