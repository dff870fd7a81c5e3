"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words sums, over all common subsequences of `ORDER` bytes, a decay for every byte that their
occurrences span, so a word with inserted characters or with gaps still resembles the insult in it. Landmarks are
the words that labelled texts tie to toxicity, and common other words that come near them; the Nyström map turns a word's kernel values at the landmarks into a vector.
A word is tied by a share of the toxic texts, or in any number of them that chance does not explain. Each toxic text with
a tied word has one that is a landmark or resembles one.
A sentence is as toxic as its worst word, so no friendly word makes up for an insult; single characters in a row (as in
"i d i o t") are read as one word too. The machine is trained on labelled sentences: the worst words of all clean ones
against, for each toxic text, the word that the machine itself finds worst. A text scores as its worst sentence.

The kernel is zero unless the longest common subsequence has ORDER bytes; that is tested first, for all landmarks at
once in the bits of machine words, so most words of a text never reach the kernel.

Null and empty texts have no sentence and score as the machine's bias says; without labels of both kinds all score
0.0, with none that words tell apart the share of toxic ones; equal rows are scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality import sampled_labels

FOLDS, HELD_OUT = 5, 0
#: Labelled texts that the machine is fitted on, at most, and words kept of each.
TRAIN_ROWS, KEPT = 8_000, 8
ORDER, DECAY = 5, 0.6
#: Toxic landmarks before those that are left to cover all toxic texts.
TOXIC_LANDMARKS, OTHER_LANDMARKS = 40, 8
#: How much words are alike that count as one kind, landmarks of a kind among the first, and common clean words that may become landmarks.
ALIKE, KIN, USUAL = 0.3, 3, 2400
#: Bytes of words whose values a worker remembers.
MEMORY = 64 << 20
WINDOW = 48  # longer words are read in overlapping windows
#: Pairs of a word and a landmark whose kernel is computed in one go.
PAIRS = 2048
#: ASCII other than letters, which is dropped from words.
MARKS = bytes(b for b in range(128) if not chr(b).isalpha())
ENDS = np.zeros(256, bool)
ENDS[list(b".!?")] = True


def units(text: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Codes of words, distinct words (their letters), the sentence of each word (numbered through all texts) and the text
    of each sentence.

    Runs of three or more single characters add the word that they spell, at the place of their first."""
    flat, at = C.split_words(pc.utf8_lower(text))
    codes, words = C.encode(flat)
    place = np.repeat(np.arange(len(text)), np.diff(at))
    if not len(codes):
        return codes, words, codes, codes
    last = np.array([bool(ENDS[w[-1]]) for w in words])[codes]
    begins = np.r_[True, last[:-1] | (place[1:] != place[:-1])]
    sentence = np.cumsum(begins) - 1
    texts = place[begins]
    single = np.array([len(w) <= 4 and len(w.decode()) == 1 for w in words])[codes]
    edge = np.flatnonzero(np.diff(np.r_[0, single.astype(np.int8), 0]))
    extra_codes, extra_sentences = [], []
    for a, b in edge.reshape(-1, 2):
        for p in range(a, b):  # a run is cut where a text ends
            if p == a or place[p] != place[p - 1]:
                q = p
                while q < b and place[q] == place[p]:
                    q += 1
                if q - p >= 3:
                    extra_codes.append(len(words))
                    words.append(b"".join(words[c] for c in codes[p:q]))
                    extra_sentences.append(sentence[p])
    if extra_codes:
        codes, sentence = np.r_[codes, extra_codes], np.r_[sentence, extra_sentences]
    letters: dict[bytes, int] = {}
    same = np.array([letters.setdefault(w.translate(None, MARKS), len(letters)) for w in words], np.int64)
    return same[codes], list(letters), sentence, texts


class Kernel:
    """Values of the kernel at fixed landmarks, scaled to 1 where a word is the landmark itself."""

    def __init__(self, landmarks: list[bytes]):
        self.words, self.landmarks = landmarks, (landmarks := [b"^" + w + b"$" for w in landmarks])
        self.packs: list[tuple[np.ndarray, np.uint64, list[tuple[int, np.uint64]]]] = []
        self.long = [k for k, w in enumerate(landmarks) if len(w) > 63]  # read without the test in bits
        todo = [(k, w) for k, w in enumerate(landmarks) if len(w) <= 63]
        while todo:  # landmarks side by side in 64 bits, a spare bit after each
            table, mask, own, at = np.zeros(256, np.uint64), 0, [], 0
            while todo and at + len(todo[0][1]) + 1 <= 64:
                k, w = todo.pop(0)
                for j, x in enumerate(w):
                    table[x] |= np.uint64(1 << (at + j))
                bits = ((1 << len(w)) - 1) << at
                mask |= bits
                own.append((k, np.uint64(bits)))
                at += len(w) + 1
            self.packs.append((table, np.uint64(mask), own))
        self.letters = np.zeros((len(landmarks), max(map(len, landmarks), default=0)), np.uint8)
        for k, w in enumerate(landmarks):
            self.letters[k, : len(w)] = np.frombuffer(w, np.uint8)
        self.scale = np.array([self._values(x[None], x[:, None])[0] for x in (np.frombuffer(w, np.uint8) for w in landmarks)]) if landmarks else np.zeros(0)

    @staticmethod
    def _values(s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The kernel of each row of s (zero bytes fill it up) with its column of t (or the only one)."""
        n, m = len(s), len(t)
        s = np.ascontiguousarray(s.T)
        before = np.zeros((m + 1, ORDER, n), np.float32)  # subsequences of each length in the prefixes so far, and of t
        before[:, 0] = 1
        total = np.zeros(n, np.float32)
        for letter in s:
            same = (t == letter).astype(np.float32) * DECAY**2
            total += np.einsum("jn,jn->n", same, before[:-1, ORDER - 1])
            run = same[:, None] * before[:-1, :-1]  # all lengths at once, each from the one below it
            for j in range(1, m):
                run[j] += DECAY * run[j - 1]
            before[1:, 1:] *= DECAY
            before[1:, 1:] += run
        return total

    def _some(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros((len(s), len(self.landmarks)), np.float32)
        todo: dict[int, list[tuple[np.ndarray, int]]] = {}  # rows for each landmark, by its length
        for table, mask, own in self.packs:
            v = np.full(len(s), mask, np.uint64)
            for k in range(s.shape[1]):  # bit-parallel longest common subsequence: a zero bit for each byte of it
                m = table[s[:, k]]
                v = ((v + (v & m)) | (v & ~m)) & mask
            for k, bits in own:
                rows = np.flatnonzero(np.bitwise_count(~v & bits) >= ORDER)
                if len(rows):
                    todo.setdefault(len(self.landmarks[k]), []).append((rows, k))
        for k in self.long:
            todo.setdefault(len(self.landmarks[k]), []).append((np.arange(len(s)), k))
        size = s.shape[1] - (s[:, ::-1] != 0).argmax(1)
        for m, some in todo.items():
            rows = np.concatenate([r for r, _ in some])
            mark = np.repeat([k for _, k in some], [len(r) for r, _ in some])
            order = np.argsort(size[rows], kind="stable")
            for at in range(0, len(order), PAIRS):
                r, k = rows[order[at : at + PAIRS]], mark[order[at : at + PAIRS]]
                out[r, k] = self._values(s[r, : size[r].max()], np.ascontiguousarray(self.letters[k, :m].T)) / self.scale[k]
        return out

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Values of all words at all landmarks (the largest over the windows of a long word). A mark at either end of a
        word is read like a letter of it."""
        words = [b"^" + w + b"$" for w in words]
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not self.landmarks:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((ORDER - 1, 8), (8, 16), (16, WINDOW)):
            at = np.flatnonzero((size > low) & (size <= high))
            for some in np.array_split(at, max(1, -(-len(at) // 50_000))):
                if len(some):
                    s = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in some), np.uint8).reshape(-1, high)
                    out[some] = self._some(s)
        for i in np.flatnonzero(size > WINDOW):
            parts = [words[i][k : k + WINDOW].ljust(WINDOW, b"\0") for k in range(0, size[i] - WINDOW // 2, WINDOW // 2)]
            for some in itertools.batched(parts, 20_000):
                out[i] = np.maximum(out[i], self._some(np.frombuffer(b"".join(some), np.uint8).reshape(-1, WINDOW)).max(0))
        return out


def worst_of(value: np.ndarray, codes: np.ndarray, place: np.ndarray, n: int, floor: float) -> np.ndarray:
    """The largest value of the words of each sentence or text, no less than floor."""
    out = np.full(n, floor)
    np.maximum.at(out, place, value[codes])
    return out


class Machine:
    def __init__(self, kernel: Kernel, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.kernel, self.weight, self.bias, self.slope, self.shift = kernel, weight, bias, slope, shift
        self.known: dict[bytes, float] = {}
        self.held = 0

    def value(self, words: list[bytes]) -> np.ndarray:
        """Values of words, remembered from batch to batch in bounded memory: a full one is emptied."""
        out = np.array([self.known.get(w, np.nan) for w in words], np.float64)
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            out[new] = spread(self.kernel([words[i] for i in new])) @ self.weight + self.bias
            for i in new.tolist():
                size = len(words[i]) + 160  # with the entry and its number
                if self.held + size > MEMORY:
                    self.known, self.held = {}, 0
                if size <= MEMORY:
                    self.known[words[i]] = float(out[i])
                    self.held += size
        return out

    def score(self, text: pa.Array) -> np.ndarray:
        worst = np.full(len(text), self.bias)
        if len(self.weight):
            codes, words, sentence, texts = units(text)
            bad = worst_of(self.value(words), codes, sentence, len(texts), self.bias)
            np.maximum.at(worst, texts, bad)
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))


def spread(k: np.ndarray) -> np.ndarray:
    """Values of two kernels: the string kernel, and its cube (a product of kernels is one), which tells near words apart."""
    return np.c_[k, k**3]


def nystrom(kernel: Kernel) -> np.ndarray:
    """The inverse roots of the landmarks' own matrices under both kernels, as one block matrix."""
    k = kernel(kernel.words).astype(np.float64) * np.sqrt(kernel.scale[None, :] / kernel.scale[:, None])  # to a symmetric scale
    k, n = (k + k.T) / 2, len(k)
    out = np.zeros((2 * n, 2 * n))
    for at, m in ((0, k), (n, k**3)):
        value, vector = np.linalg.eigh(m)
        out[at : at + n, at : at + n] = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    return out


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 400, c: float = 100.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and balanced classes, by accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    a = np.c_[x, np.ones(len(x))]
    rate = 1 / (1 / c + 2 * np.linalg.norm((a * weight[:, None]).T @ a, 2))
    w = v = np.zeros(a.shape[1])
    for k in range(rounds):
        short = np.maximum(0, 1 - y * (a @ v))
        grad = np.r_[v[:-1], 0] / c - 2 * a.T @ (weight * y * short)
        new = v - rate * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def bent_forms(word: bytes) -> list[bytes]:
    """The word with one more letter at each inner place, by rule."""
    return [word[:k] + bytes([97 + (7 * k + len(word)) % 26]) + word[k:] for k in range(1, len(word))]


def spread_out(words: list[bytes], most: int) -> list[bytes]:
    """The first words of the list, all of which are considered, but at most KIN that resemble one another."""
    own = Kernel(words).scale
    near = np.zeros(len(words), np.int64)  # chosen words that each resembles
    chosen: list[bytes] = []
    for i, w in enumerate(words):
        if len(chosen) < most and near[i] < KIN:
            chosen.append(w)
            near += Kernel([w])(words)[:, 0] * own[i] / np.maximum(own, own[i]) > ALIKE
    return chosen


def covering(words: list[bytes], chosen: list[bytes], texts: list[list[int]]) -> list[bytes]:
    """The chosen words, and the first words of the list that texts (places of their words in it) without a word like a chosen
    one still need."""
    near = Kernel(chosen)(words).max(1, initial=0) > ALIKE
    bare = [set(t) for t in texts if t and not near[t].any()]
    out = list(chosen)
    while bare:
        first = min(min(t) for t in bare)
        out.append(words[first])
        bare = [t for t in bare if first not in t]
    return out


def unlikely(words: DataFrame, pos: int, neg: int) -> Column:
    """Whether a word is in so many toxic texts that less than one word is expected to be by chance: Chernoff's bound on the
    binomial tail, times the number of words that are in as many texts (rarer ones cannot reach the bound)."""
    n, rate = F.col("clean") + F.col("toxic"), pos / (pos + neg)
    seen = sorted((r["n"], r["k"]) for r in words.groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("k")).collect())  # at most a row for each number of texts
    upto = np.cumsum([k for _, k in seen[::-1]])[::-1].tolist()
    tests = F.element_at(F.create_map(*(F.lit(x) for (size, _), k in zip(seen, upto, strict=True) for x in (size, float(k)))), n) if seen else F.lit(1.0)
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    return (F.col("toxic") > n * rate) & (part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate) > F.log(tests))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    spark = C.ready(docs.sparkSession)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sampled_labels(labels, "toxic", HELD_OUT, FOLDS, rows)), "doc_id")  # at most `rows` rows
    chosen = C.stored(chosen.select("text", "__label").distinct(), "toxic-sample")  # copies of a text are one example
    if chosen.count() > rows:  # ids repeat: the first by hash
        order = F.xxhash64("text", "__label")
        chosen = C.stored(chosen.withColumn("__h", order).join(F.broadcast(chosen.select(order.alias("__h")).orderBy("__h").limit(rows)), "__h", "left_semi").drop("__h"), "toxic-sample")

    def distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = C.split_words(pc.utf8_lower(C.texts_of(batch)))
        codes, words = C.encode(flat)
        words = [w.translate(None, MARKS) for w in words]
        place = np.repeat(np.arange(len(batch)), np.diff(at))
        label = batch["__label"].to_numpy(zero_copy_only=False)
        seen = {(int(p), words[c]) for p, c in set(zip(place.tolist(), codes.tolist(), strict=True))}
        toxic: dict[bytes, list[int]] = {}
        for p, w in seen:
            if ORDER <= len(w) + 2:
                toxic.setdefault(w, [0, 0])[int(label[p] == 1)] += 1
        return pa.RecordBatch.from_arrays([pa.array(list(toxic), pa.binary()), pa.array([x[0] for x in toxic.values()], pa.int64()), pa.array([x[1] for x in toxic.values()], pa.int64())], ["word", "clean", "toxic"])

    n = {r["__label"]: r["n"] for r in chosen.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Machine(Kernel([]), np.zeros(0), 0.0, 0.0, -30.0)
    words = C.map_arrow(chosen, distinct, "word binary, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    words = C.stored(words, "toxic-words")
    p, q = (F.col("toxic") + 0.5) / (pos + 1), (F.col("clean") + 0.5) / (neg + 1)
    often = (F.col("toxic") >= max(2, min(6, pos // 8), pos // 58)) | (F.col("toxic") >= 2) & unlikely(words, pos, neg)
    tied = words.where(often).where(p > 8 * q).orderBy((F.col("toxic") * F.log(p / q)).desc(), "word").collect()
    names = [bytes(r["word"]) for r in tied]
    number = {w: i for i, w in enumerate(names)}

    def ties(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = C.split_words(pc.utf8_lower(C.texts_of(batch)))
        codes, words = C.encode(flat)
        code = np.array([number.get(w.translate(None, MARKS), -1) for w in words], np.int64)[codes]
        place = np.repeat(np.arange(len(batch)), np.diff(at))
        own: list[set[int]] = [set() for _ in range(len(batch))]
        for p, c in zip(place[code >= 0].tolist(), code[code >= 0].tolist(), strict=True):
            own[p].add(c)
        return pa.RecordBatch.from_arrays([pa.array([sorted(x) for x in own], pa.list_(pa.int32()))], ["tied"])

    texts = [r["tied"] for r in C.map_arrow(chosen.where("__label = 1"), ties, "tied array<int>").collect()]  # at most `rows` rows
    bad = covering(names, spread_out(names, TOXIC_LANDMARKS), texts)
    usual = [bytes(r["word"]) for r in words.where("clean > 0").where(p < q).orderBy(F.desc("clean"), "word").limit(USUAL).collect()]
    close = Kernel(bad)(usual).max(1, initial=0)
    good = [usual[i] for i in np.argsort(-close, kind="stable")[:OTHER_LANDMARKS]]  # common clean words that come nearest
    kernel = Kernel(bad + good)
    few = len(bad)
    sure = {bytes(r["word"]) for r in tied if r["toxic"] >= 20 * r["clean"] * pos / neg}  # in toxic texts nearly alone

    def worst(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, words, sentence, texts = units(C.texts_of(batch))
        x = kernel(words)
        near = x[:, :few].max(1, initial=0)
        pairs = np.unique(texts[sentence] * max(1, len(words)) + codes) if len(codes) else np.zeros(0, np.int64)
        of, code = pairs // max(1, len(words)), pairs % max(1, len(words))
        use = near[code] > 0
        of, code = of[use], code[use]
        alphabetic = np.zeros(max(1, len(words)), np.int64)
        alphabetic[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((alphabetic[code], -near[code], of))
        rank = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        keep = order[rank < KEPT]
        label = batch["__label"].to_numpy(zero_copy_only=False)
        key = [xxhash.xxh64_hexdigest(t or "") for t in batch["text"].to_pylist()]  # equal texts are one example
        return pa.RecordBatch.from_arrays([pa.array([key[i] for i in of[keep]], pa.string()), pa.array(label[of[keep]].astype(np.int32)), pa.array([words[i] in sure for i in code[keep]], pa.bool_()), pa.array(list(x[code[keep]]), pa.list_(pa.float32()))], ["id", "label", "sure", "x"])

    got = C.map_arrow(chosen, worst, "id string, label int, sure boolean, x array<float>").toArrow()  # KEPT words of each text at most
    if len({*got["label"].to_pylist()}) < 2:  # no word that tells the kinds apart: the share of toxic texts
        return Machine(Kernel([]), np.zeros(0), 0.0, 0.0, float(np.log(pos / neg)))
    root = nystrom(kernel)
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(kernel.landmarks))
    known = got["sure"].to_numpy(zero_copy_only=False)
    y, ids = got["label"].to_numpy(), np.unique(got["id"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.lexsort((known, ids, *x.T, y))  # the fit doesn't depend on the order of arrival
    x, y, ids, known = x[order], y[order], ids[order], known[order]
    bent = kernel([v for w in bad for v in bent_forms(w)])  # insults with a letter put in are insults
    z = spread(x) @ root
    width = np.maximum(z.std(0), 1e-6)
    z, bent = z / width, spread(bent) @ root / width
    f = x[:, :few].max(1, initial=0)
    clean = np.flatnonzero(y == 0)
    for _ in range(4):
        top = np.lexsort((-f, ids))
        first = top[np.r_[True, ids[top][1:] != ids[top][:-1]]]
        use = np.r_[np.union1d(first[y[first] == 1], np.flatnonzero(known & (y == 1))), clean]
        w, b = svm(np.r_[z[use], bent, bent, bent], np.r_[np.where(y[use] == 1, 1.0, -1.0), np.ones(3 * len(bent))])
        f = z @ w + b
    weight = root @ (w / width)
    per = np.full(ids.max(initial=-1) + 1, b)
    np.maximum.at(per, ids, f)
    mark = np.zeros(len(per))
    mark[ids] = y
    slope, shift = _logistic(per, mark)
    return Machine(kernel, weight, b, slope, shift)


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scores to probabilities: a lightly held logistic fit."""
    a = np.c_[f, np.ones(len(f))]
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 0.01 * np.eye(2)
        w = w - np.linalg.solve(h, a.T @ (p - y) + 0.01 * (w - np.array([1.0, 0.0])))
    return float(w[0]), float(w[1])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    spark = C.ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(machine)  # some kilobytes
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shared.value.score(C.texts_of(batch)))], ["doc_id", "score"])

    return C.map_arrow(docs.select("doc_id", "text"), apply, f"doc_id {kind}, score double")
