"""Language-model scoring with a log-frequency Bloom filter.

Counts of all training tokens and bigrams are gathered exactly, then quantised: a count of level q is stored as the
q items (key, 1) ... (key, q) of a Bloom filter, and read back by membership probes for rising levels until one fails.
A bigram's probability is (count + MU * p(word)) / (count of the history + MU), all counts from probes; p(word) is the
share of the word's count in all counts that the filter holds, with half a count for unknown words. MU comes from the training
counts: it makes the mass that is left to unseen words, on average over all tokens, the share of bigrams that were seen once (Good and Turing).

A distribution, nearly: the probabilities of all words after a history sum to (sum of its bigrams' read counts + MU) /
(its own read count + MU). Quantised counts are within 25 % of the true ones, to either side alike; the tests measure the
sums over a whole vocabulary (0.95 to 1.05 on average, each within 0.75 and 1.3). A false positive (one in 70,000 keys) raises
a count by a level, so V distinct words add V / 70,000 to the counts that one history's sum would read, mostly at words too rare to be asked for.

Order of work. The filter has as many bits as distinct n-grams ask for, so no bound holds for its size and it is not
broadcast as a whole: it stays in the shared folder in `part`s, by ranges of the key, and each part meets the probes for its keys in one
task. Scoring reads the texts once, into stored chunks (word hashes and codes); a chunk asks every part
for its distinct keys, one blob each, and gets a byte per key back. A frequent word or pair is one key for each chunk
wherever it goes, nothing is quadratic, and the driver sees a few numbers.

Null and empty texts consist of the end token alone; a text of any length lies in one chunk; equal rows are scored one by
one; with no training rows each token has probability 1 under either model; columns but doc_id and text are not looked
at; an empty table gives no rows. Words are told apart by 64-bit hashes, and so are pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FOLDS, HELD_OUT = 5, 1
BITS, HASHES = 24, 12  # a false positive in 70,000 keys
#: Distinct keys that a task gathers before it sends them on, and tokens of a chunk (or those of one text).
GATHERED, CHUNK = 3_000_000, 2_000_000
#: No word has a space.
END = xxhash.xxh64_intdigest(b" end")
#: Level q stands for counts from STEPS[q - 1] up to the next: exact up to 4, then two steps for each doubling.
STEPS = np.array([1, 2, 3, *(x << k for k in range(58) for x in (4, 6))], np.int64)
VALUES = np.r_[0.0, np.where(STEPS < 4, STEPS, np.sqrt(STEPS * np.r_[STEPS[1:] - 1, STEPS[-1]].astype(np.float64)))]


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens (ends included), hashes by code, and where each text's tokens begin."""
    flat, at = C.split_words(pc.ascii_lower(text))
    codes, words = C.encode(flat)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    out = np.full(len(codes) + len(text), len(words), np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(text)), np.diff(at))] = codes
    return out, np.append(hashes, np.uint64(END)), at + np.arange(len(at))


def bigram_keys(h: np.ndarray) -> np.ndarray:
    """A key for each token and the one before. Before the first token stands the end of another text."""
    before = np.r_[np.uint64(END), h[:-1]] if len(h) else h
    return C.mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def level_of(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, count, side="right")


def _hashes(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Probe k of an item is the bit first + k * step."""
    first = C.mix(key ^ np.uint64(0x9E3779B97F4A7C15 * level % (1 << 64)))
    return first, C.mix(first) | np.uint64(1)


def filter_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bytes of one part of the filter."""
    levels = level_of(counts)
    bits = max(64, (int(levels.sum()) * BITS + 63) // 64 * 64)
    out = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        keys = keys[levels >= level]
        levels = levels[levels >= level]
        first, step = _hashes(keys, level)
        for k in range(HASHES):
            out[(first + np.uint64(k) * step) % np.uint64(bits)] = True
    return np.packbits(out, bitorder="little")


def levels_in(data: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The level of each key by probes of one part of the filter."""
    out = np.zeros(len(key), np.uint8)
    alive, bits = np.arange(len(key)), np.uint64(8 * len(data))
    for level in range(1, len(STEPS) + 1):
        left = np.arange(len(key))
        first, step = _hashes(key, level)
        for k in range(HASHES):
            at = (first[left] + np.uint64(k) * step[left]) % bits
            left = left[(data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        key, alive = key[left], alive[left]
        if not len(alive):
            break
        out[alive] = level
    return out


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, without planes of zeros at the top."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    most = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([most]) + planes[:, :most].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    most = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(most, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :most] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def packed_keys(x: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def cuts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys; parts, a power of two, are ranges of keys."""
    at = (keys >> np.uint64(65 - parts.bit_length())).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
    ends = np.searchsorted(at, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(ends)).tolist():
        yield p, int(ends[p]), int(ends[p + 1])


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, count = key[order], count[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _gather(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: distinct words and bigrams of the texts with counts, in a blob for each part. Bigrams have the parts after
    those of words."""

    def send(held: list[list[tuple]]) -> pa.RecordBatch:
        part, keys, counts = [], [], []
        for kind, got in enumerate(held):
            key, count = _summed(*(np.concatenate(x) for x in zip(*got, strict=True)))
            for p, a, b in cuts(key, parts):
                part.append(kind * parts + p)
                keys.append(packed_keys(key[a:b]))
                counts.append(packed(count[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["part", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[], []], 0
        for batch in batches:
            for piece in C.slices(batch):
                codes, hashes, _ = words_of(C.texts_of(piece))
                seen = np.unique(codes, return_counts=True)
                held[0].append((hashes[seen[0]], seen[1]))
                held[1].append(np.unique(bigram_keys(hashes[codes]), return_counts=True))
                n += len(held[0][-1][0]) + len(held[1][-1][0])
                if n >= GATHERED:
                    yield send(held)
                    held, n = [[], []], 0
        if held[0]:
            yield send(held)

    return run


MODEL = "part bigint, keys binary, counts binary, filter binary, n bigint, v bigint, once bigint, held double, by_level array<bigint>"


@dataclass
class Model:
    """The stored parts (one row each), how many there are of either kind, and the numbers of all of them: tokens, distinct
    tokens, the counts that the filter holds, and MU."""

    rows: DataFrame
    parts: int
    n: int
    v: int
    held: float
    mu: float


def prior(by_level: np.ndarray, unseen: float) -> float:
    """MU: by_level tokens have a history of each level's count, and `unseen` of them (a share) follow it for the first time."""
    n = by_level.sum()
    low, high = 1e-3, 1e9
    for _ in range(80):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if (by_level * mid / (VALUES + mid)).sum() < unseen * n else (low, mid)
    return low


def train(docs: DataFrame, parts: int | None = None) -> Model:
    """Count all texts of docs."""
    C.ready(docs.sparkSession)
    parts = parts or max(64, 1 << (2 * docs.rdd.getNumPartitions() - 1).bit_length())

    def build(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        key, count = _summed(np.concatenate([unpacked_keys(x) for x in table["keys"].to_pylist()]), np.concatenate([unpacked(x) for x in table["counts"].to_pylist()]).astype(np.int64))
        level = level_of(count)
        word = part < parts
        by_level = np.bincount(level, count, len(VALUES)).astype(np.int64) if word else np.zeros(len(VALUES), np.int64)
        row = {"part": part, "keys": packed_keys(key) if word else None, "counts": packed(count) if word else None, "filter": filter_of(key, count).tobytes()}
        row |= {"n": int(count.sum()) if word else 0, "v": len(key) if word else 0, "once": 0 if word else int((count == 1).sum()), "held": float(VALUES[level].sum()) if word else 0.0, "by_level": by_level.tolist()}
        kinds = [pa.int64(), *[pa.binary()] * 3, *[pa.int64()] * 3, pa.float64(), pa.list_(pa.int64())]
        return pa.Table.from_pylist([row], pa.schema(list(zip(row, kinds, strict=True))))

    sent = docs.select("text").mapInArrow(C.trimmed(_gather(parts)), "part bigint, keys binary, counts binary")
    rows = C.stored(sent.groupBy("part").applyInArrow(build, MODEL), "lm-model")
    got = rows.agg(*(F.sum(c).alias(c) for c in ("n", "v", "once")), F.sum(F.col("held").cast("decimal(38,6)")).cast("double").alias("held"), *(F.sum(F.col("by_level")[i]) for i in range(len(VALUES)))).first()
    n, v, once, held, *by_level = (x or 0 for x in got)
    return Model(rows, parts, n, v, held, prior(np.array(by_level, np.float64), once / n) if n else 1.0)


def chunks(docs: DataFrame) -> DataFrame:
    """Stored rows (chunk, ids, at, words, codes): doc_ids, where each text's tokens begin, the sorted hashes of the chunk's
    words, and the place of each token's word among them."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            hashes = np.unique(np.concatenate([x[2] for x in held]))
            codes = np.concatenate([np.searchsorted(hashes, h)[c] for _, c, h, _ in held])
            at = np.cumsum(np.r_[0, np.concatenate([np.diff(x[3]) for x in held])])
            own = [pa.array([part << 32 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([packed(at)], pa.binary()), pa.array([packed_keys(hashes)], pa.binary()), pa.array([packed(codes)], pa.binary())]
            return pa.RecordBatch.from_arrays(own, ["chunk", "ids", "at", "words", "codes"])

        for batch in batches:
            for piece in C.slices(batch, C.SMALL_SLICE):
                if not len(piece):
                    continue
                codes, hashes, at = words_of(C.texts_of(piece))
                held.append((piece["doc_id"], codes, hashes, at))
                n += len(codes)
                if n >= CHUNK:
                    yield row()
                    number, held, n = number + 1, [], 0
        if held:
            yield row()

    return C.stored(docs.select("doc_id", "text").mapInArrow(C.trimmed(run), f"chunk bigint, ids array<{kind.simpleString()}>, at binary, words binary, codes binary"), "lm-chunks")


def _asked(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: what each chunk wants to know of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, codes in zip(batch["chunk"].to_pylist(), batch["words"], batch["codes"], strict=True):
                words = unpacked_keys(raw.as_py())
                part, keys = [], []
                for kind, key in enumerate((words, np.unique(bigram_keys(words[unpacked(codes.as_py())])))):
                    for p, a, b in cuts(key, parts):
                        part.append(kind * parts + p)
                        keys.append(packed_keys(key[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([chunk] * len(part), pa.int64()), pa.array(keys, pa.binary())], ["part", "chunk", "keys"])

    return run


REPLY = "part bigint, chunk bigint, levels binary, counts binary"


def _answer(asked: pa.Table, part: pa.Table) -> pa.Table:
    """Levels of the keys by probes, and for words their exact counts."""
    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("levels", pa.binary()), ("counts", pa.binary())])
    if not asked.num_rows:
        return schema.empty_table()
    wanted = [unpacked_keys(x) for x in asked["keys"].to_pylist()]
    ends = np.cumsum([0, *map(len, wanted)])
    key, back = np.unique(np.concatenate(wanted), return_inverse=True)
    levels, counts = np.zeros(len(key), np.uint8), None
    if part.num_rows:
        row = part.slice(0, 1)
        levels = levels_in(np.frombuffer(row["filter"][0].as_buffer(), np.uint8), key)
        if row["keys"][0].is_valid:
            counts = lookup(unpacked_keys(row["keys"][0].as_py()), unpacked(row["counts"][0].as_py()).astype(np.int64), key)
    levels = levels[back]
    counts = counts[back] if counts is not None else None
    own = [levels[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
    exact = [packed(counts[a:b]) if counts is not None else None for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table([asked["part"], asked["chunk"], pa.array(own, pa.binary()), pa.array(exact, pa.binary())], schema)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values at the wanted keys (sorted keys; 0 where there is none)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def bigram_p(pair: np.ndarray, history: np.ndarray, word: np.ndarray, single: np.ndarray, mu: float) -> np.ndarray:
    """From the counts that probes give for a bigram, its history and its word, and the word's own probability."""
    return (np.minimum(pair, np.minimum(history, word)) + mu * single) / (history + mu)  # a bigram is no more frequent than its words


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    C.ready(docs.sparkSession)
    parts, n, v, held, mu = model.parts, model.n, model.v, model.held, model.mu
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = chunks(docs)
    asked = own.select("chunk", "words", "codes").mapInArrow(C.trimmed(_asked(parts)), "part bigint, chunk bigint, keys binary")
    replies = C.stored(asked.groupBy("part").cogroup(model.rows.select("part", "keys", "counts", "filter").groupBy("part")).applyInArrow(_answer, REPLY), "lm-replies")

    def finish(chunk: pa.Table, got: pa.Table) -> pa.Table:
        row = chunk.slice(0, 1)
        ids, at = row["ids"].combine_chunks().flatten(), unpacked(row["at"][0].as_py()).astype(np.int64)
        words, codes = unpacked_keys(row["words"][0].as_py()), unpacked(row["codes"][0].as_py()).astype(np.int64)
        got = got.sort_by("part")  # in the order of the parts, keys are sorted
        of_word = (got["part"].to_numpy() < parts).tolist()
        levels, counts = got["levels"].to_pylist(), got["counts"].to_pylist()
        about = VALUES[np.frombuffer(b"".join(x for x, w in zip(levels, of_word, strict=True) if w), np.uint8)]
        exact = np.concatenate([np.zeros(len(x), np.int64) if c is None else unpacked(c).astype(np.int64) for x, c, w in zip(levels, counts, of_word, strict=True) if w])
        key, back = np.unique(bigram_keys(words[codes]), return_inverse=True)
        pair = VALUES[np.frombuffer(b"".join(x for x, w in zip(levels, of_word, strict=True) if not w), np.uint8)][back]
        assert len(about) == len(words) and len(exact) == len(words) and len(back) == len(codes) and len(key)
        before = np.r_[np.searchsorted(words, np.uint64(END)), codes[:-1]]
        single = (about + 0.5) / (held + 0.5 * (v + 1))
        model_score = np.log10(bigram_p(pair, about[before], about[codes], single[codes], mu))
        base = np.log10((exact + 0.5) / (n + 0.5 * (v + 1)))
        cols = [ids, pa.array(np.diff(at), pa.int64()), pa.array(C.sums((exact > 0)[codes], at), pa.int64()), pa.array(np.full(len(ids), n), pa.int64()), pa.array(C.sums(base[codes], at)), pa.array(C.sums(model_score, at))]
        return pa.table(cols, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return own.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
