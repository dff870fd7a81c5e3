"""Language identification of mixed text: script ranges, per-word scores and Viterbi spans.

Training counts, for every language, hashed byte n-grams of its words (fixed tables, so the model's size depends only
on the number of languages) and the scripts that its words are written in. A word's candidates are the languages
that use its script; its score under each is a naive Bayes log-likelihood, no more than `FLOOR` below the best. Viterbi
with a penalty for each switch labels runs of words; the document's language is the one with most letters.

Null texts and texts without a letter are `und` with score 0, as is everything if no language was learned; texts of any length are labelled whole; of
languages with equal scores or letters the first by code point is taken; equal rows are labelled one by one; columns but doc_id, text and (in training)
lang are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as C

FOLDS, HELD_OUT = 4, 2
TABLE_BITS = 16
GRAMS = (2, 3, 4)
SWITCH, FLOOR = 6.0, 8.0
#: A language uses a script if so much of its words is in it.
USES = 0.01
#: First and last code points of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)
OTHER = len(SCRIPTS)


def script_of(letter: str) -> int:
    x = ord(letter)
    return next((k for k, (_, ranges) in enumerate(SCRIPTS) if any(a <= x <= b for a, b in ranges)), OTHER)


ASCII_LETTERS = frozenset(range(97, 123))


def scripts_and_letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The script of each word's first letter (-1: it has no letter), and how many letters it has."""
    script, letters = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        if w.isascii():
            if w.isalpha():
                script[i], letters[i] = 0, len(w)
            elif n := sum(map(ASCII_LETTERS.__contains__, w)):
                script[i], letters[i] = 0, n
        elif own := [x for x in w.decode() if x.isalpha()]:
            script[i], letters[i] = script_of(own[0]), len(own)
    return script, letters


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table cells of the words' n-grams (ends marked) and the words that they belong to."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    space = data == 32
    word = np.cumsum(space) - 1
    cells, owner = [], []
    for n in GRAMS:
        last = len(data) - n + 1
        if last <= 0:
            continue
        h = np.full(last, n, np.uint64)
        ok = np.ones(last, bool)
        for k in range(n):
            h = (h << np.uint64(8)) | data[k : k + last]
            if 0 < k < n - 1:
                ok &= ~space[k : k + last]
        if n == 2:
            ok &= ~(space[:last] & space[1:])
        at = np.flatnonzero(ok)
        cells.append((C.mix(h[at]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
        owner.append(word[at])
    return np.concatenate([np.zeros(0, np.int64), *cells]), np.concatenate([np.zeros(0, np.int64), *owner])


def tokens(text: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    flat, at = C.split_words(pc.utf8_lower(text))
    codes, words = C.encode(flat)
    return codes, words, at


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: language x cell; scripts: language x script."""
        self.langs = langs
        self.table = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * counts.shape[1])).T.astype(np.float32) if langs else None
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        uses = share >= USES
        uses[:, ~uses.any(0)] = True  # an unknown script narrows nothing
        self.uses = uses

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of distinct words (0 for the best language), and their letters."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        script, letters = scripts_and_letters(words)
        cells, owner = grams(words)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, self.table[cells, k], len(words)) if len(words) else 0
        out = np.where(self.uses[:, script].T | (script < 0)[:, None], out, -np.inf)
        out = np.maximum(out - out.max(1, keepdims=True, initial=-1e30), -FLOOR)
        out[script < 0] = 0
        return out.astype(np.float32), letters


def viterbi(e: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of all words: e has their scores, at where each text begins. Texts advance side by side."""
    n, size = e.shape
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    start, length = at[:-1][order], length[order]
    small = np.min_scalar_type(max(1, size))  # the labels' type has room for all languages
    label = np.zeros(n, small)
    if not n:
        return label
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # texts with more than t words
    best = np.zeros((len(order), size), np.float32)
    moved = np.zeros((n, size), bool)  # the best way into a label comes from `source`
    source = np.zeros(n, small)
    for t, m in enumerate(active):
        row = start[:m] + t
        now = best[:m]
        top = now.argmax(1)
        jump = now[np.arange(m), top] - switch
        other = jump[:, None] > now
        moved[row], source[row] = other, top
        best[:m] = np.where(other, jump[:, None], now) + e[row]
    state = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        row = start[:m] + t
        label[row] = state[:m]
        state[:m] = np.where(moved[row, state[:m]], source[row], state[:m])
    return label


#: Languages that a model may have: it takes half a megabyte for each, on the driver and in every worker.
MOST_LANGUAGES = 256
TOO_MANY = f"more than {MOST_LANGUAGES} values of lang: too many for one model"
COUNTED = "lang string, counts binary, scripts binary"


def train(docs: DataFrame) -> Model:
    """Count over all rows of docs that have a text and a language; more than MOST_LANGUAGES languages are refused, in the task or the driver that meets them."""
    C.ready(docs.sparkSession)
    width = 1 << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for piece in C.slices(batch):
                langs = piece["lang"].to_numpy(zero_copy_only=False)
                for lang in set(langs):
                    codes, words, _ = tokens(C.texts_of(piece.filter(pa.array(langs == lang))))
                    if not words:
                        continue
                    times = np.bincount(codes, minlength=len(words))
                    script, _ = scripts_and_letters(words)
                    cells, owner = grams(words)
                    use = script[owner] >= 0
                    if len(held) == MOST_LANGUAGES and lang not in held:
                        raise ValueError(TOO_MANY)
                    a, b = held.setdefault(lang, (np.zeros(width, np.int64), np.zeros(OTHER + 1, np.int64)))
                    a += np.bincount(cells[use], times[owner[use]], width).astype(np.int64)
                    b += np.bincount(script[script >= 0], times[script >= 0], OTHER + 1).astype(np.int64)
        rows = [(k, a.tobytes(), b.tobytes()) for k, (a, b) in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "counts", "scripts"])

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(C.trimmed(count), COUNTED)
    got = sorted((r["lang"], bytes(r["counts"]), bytes(r["scripts"])) for r in rows.groupBy("lang").applyInArrow(_sum_group, COUNTED).limit(MOST_LANGUAGES + 1).collect())  # one row per language
    if len(got) > MOST_LANGUAGES:
        raise ValueError(TOO_MANY)
    return Model([r[0] for r in got], np.array([np.frombuffer(r[1], np.int64) for r in got]).reshape(-1, width), np.array([np.frombuffer(r[2], np.int64) for r in got]).reshape(-1, OTHER + 1))


def _sum_group(table: pa.Table) -> pa.Table:
    a = np.sum([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()], 0)
    b = np.sum([np.frombuffer(x, np.int64) for x in table["scripts"].to_pylist()], 0)
    return pa.table({"lang": [table["lang"][0].as_py()], "counts": [a.tobytes()], "scripts": [b.tobytes()]}, pa.schema([("lang", pa.string()), ("counts", pa.binary()), ("scripts", pa.binary())]))


def label(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (the share of letters in it) and spans [(start, end, lang)] of word positions."""
    spark = C.ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, n = shared.value, len(batch)
        langs = pa.array([*model.langs, "und"])
        codes, words, at = tokens(C.texts_of(batch))
        size, pred, share = len(model.langs), np.full(n, len(model.langs)), np.zeros(n)
        spans = [[] for _ in range(n)]
        if size and len(codes):
            e, letters = model.scores(words)
            labels = viterbi(e[codes], at)
            place = np.repeat(np.arange(n), np.diff(at))
            weight = np.bincount(place * size + labels, letters[codes], n * size).reshape(n, size)
            total = weight.sum(1)
            pred = np.where(total > 0, weight.argmax(1), size)
            share = np.where(total > 0, weight.max(1) / np.maximum(total, 1), 0.0)
            if with_spans:
                cut = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (place[1:] != place[:-1])])
                for a, b in zip(cut, [*cut[1:], len(labels)], strict=True):
                    if total[place[a]]:
                        spans[place[a]].append({"start": a - at[place[a]], "end": b - at[place[a]], "lang": model.langs[labels[a]]})
        cols = [batch["doc_id"], langs.take(pa.array(pred)), pa.array(share)] + ([pa.array(spans, pa.list_(span))] if with_spans else [])
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", *["spans"] * with_spans])

    return C.map_arrow(docs.select("doc_id", "text"), apply, f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:bigint,end:bigint,lang:string>>" * with_spans)
