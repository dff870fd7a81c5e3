"""Bounded-space online packing of token ids into fixed-length sequences.

A task keeps at most `OPEN` windows. What is left of a document after its full windows goes to the open window that
it fits best; when none has room, the fullest is completed with a cut of the document if the gap is worth a cut, and
emitted. At the end of a partition the open windows are its leftovers; those of `MERGED` partitions are then
merged into full sequences, and their last tokens into sequences of powers of two, which need no padding.

A task holds its open windows and one slice of texts; a merging task at most MERGED * OPEN windows. Null text is
empty and has the closing id alone; equal rows are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SEQUENCE, OPEN, MERGED, CLOSING_ID = 2048, 16, 32, 1
#: A window with at least so much room is completed with a cut; smaller gaps are padded.
WORTH_A_CUT = 16
VOCABULARY = "word_bpe_49k.json"
#: Bytes of words and their ids that a worker remembers; when there are more, only those of the slice at hand stay.
REMEMBERED = 16 << 20
#: Bytes of text that are encoded at a time.
PIECE_BYTES = 2 << 20
#: Words that go through the tokenizer in one call.
JOINTLY = 5_000
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: ASCII letters.
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_memory: dict[str, Memory] = {}


class Memory:
    """A tokenizer, and the ids of the words met lately: Arrow words, and their ids one after the other."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words, self.size, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: where the ids of each begin in an array of ids, how many they are, and that array."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        if len(new):
            size, ids = self._encoded(new)
            place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            place[place < 0] = len(self.words) + np.arange(len(new))
            self.words, self.size, self.ids = pa.concat_arrays([self.words, new]), np.r_[self.size, size], np.r_[self.ids, ids]
        else:
            place = at.to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(self.size) - self.size
        out = begin[place], self.size[place], self.ids
        if self.words.nbytes + self.size.nbytes + self.ids.nbytes > REMEMBERED:
            self.words, self.size, self.ids = words, out[1], self.ids[C.ragged(out[0], out[1])]
        return out

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids. Letters alone are one piece, whose last id has a word end; such words go
        through the tokenizer together, and one by one only if the ends don't add up (a letter may become several)."""
        letters = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        alone, order, sizes, ids = [np.flatnonzero(~letters)], [], [], []
        together = np.flatnonzero(letters)
        for i in range(0, len(together), JOINTLY):
            own = together[i : i + JOINTLY]
            got = np.array(self.tokenizer.encode_batch_fast(["\n".join(words.take(pa.array(own)).to_pylist())], add_special_tokens=False)[0].ids, "<u4")  # without offsets
            ends = np.flatnonzero(self.ends_word[got])
            if len(ends) == len(own) and len(got) == ends[-1] + 1:
                order.append(own)
                sizes.append(np.diff(np.r_[-1, ends]))
                ids.append(got)
            else:
                alone.append(own)
        alone = np.concatenate(alone)
        for some in np.array_split(alone, max(1, -(-len(alone) // JOINTLY))):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words.take(pa.array(some)).to_pylist(), add_special_tokens=False)]
            order.append(some)
            sizes.append(np.array(list(map(len, got)), np.int64))
            ids.append(np.fromiter(itertools.chain.from_iterable(got), "<u4"))
        order, size, flat = np.concatenate(order), np.concatenate(sizes), np.concatenate(ids)
        back = np.argsort(order)
        begin = np.cumsum(size) - size
        return size[back], flat[C.ragged(begin[back], size[back])]


def encode(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids (uint32) of all texts and where each text's begin.

    The vocabulary's rules drop white space and never join across it, so each distinct word is encoded once; marks after
    an ASCII letter are a piece of their own, so a word and the marks at its end are looked up apart. A text
    with the mark of a special token is encoded whole."""
    if path not in _memory:
        _memory[path] = Memory(path)
    memory = _memory[path]
    special = pc.match_substring(text, "<|").to_numpy(zero_copy_only=False)
    flat, at = C.split_words(pc.ascii_lower(text))
    coded = pc.dictionary_encode(flat)
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    core = pc.ascii_rtrim(words, MARKS)
    data, ends = C.bytes_of(core)
    last = data[np.maximum(ends[1:] - 1, 0)] if len(data) else np.zeros(len(words), np.uint8)
    cut = (np.diff(ends) > 0) & (last < 128) & _LETTER[last] & (np.diff(ends) < np.diff(C.bytes_of(words)[1]))
    whole = pc.dictionary_encode(pa.concat_arrays([pc.if_else(pa.array(cut), core, words), _tails(words, core, cut)]))
    of = whole.indices.to_numpy().astype(np.int64)
    first, size, ids = memory.of(whole.dictionary)
    tail = np.full(len(words), -1)
    tail[cut] = of[len(words) :]
    pieces = np.stack([of[: len(words)], tail], 1)[codes].ravel()  # a word's ids, then those of its marks
    pieces = pieces[pieces >= 0] if len(pieces) else pieces
    per_word = size[of[: len(words)]] + np.where(tail >= 0, size[tail] if len(size) else 0, 0)
    place = np.r_[0, np.cumsum(per_word[codes])][at]
    ids = ids[C.ragged(first[pieces], size[pieces])]
    if special.any():
        texts = [np.array(memory.tokenizer.encode(text[i].as_py(), add_special_tokens=False).ids, "<u4") if special[i] else ids[place[i] : place[i + 1]] for i in range(len(text))]
        ids, place = np.concatenate([np.zeros(0, "<u4"), *texts]), np.r_[0, np.cumsum([len(x) for x in texts])]
    return ids, place


def _tails(words: pa.Array, core: pa.Array, cut: np.ndarray) -> pa.Array:
    """What follows the core of the chosen words."""
    data, at = C.bytes_of(words)
    start = at[:-1][cut] + np.diff(C.bytes_of(core)[1])[cut]
    size = at[1:][cut] - start
    ends = np.r_[0, np.cumsum(size)].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data[C.ragged(start, size)].tobytes()))


class Windows:
    """Open windows, ordered by their room. A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open = length, most, []  # (room, number, pieces)
        self.number = 0

    def add(self, piece: tuple) -> list[list[tuple]]:
        """Place a piece; returns the windows that are complete."""
        doc, start, ids, total = piece
        done = []
        while len(ids) >= self.length:
            done.append([(doc, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length :]
        if not len(ids):
            return done
        i = bisect.bisect_left(self.open, (len(ids),))
        if i == len(self.open) and len(self.open) >= self.most:
            room, _, pieces = self.open.pop(0)
            if room >= WORTH_A_CUT:
                pieces.append((doc, start, ids[:room], total))
                start, ids = start + room, ids[room:]
            done.append(pieces)
            i = bisect.bisect_left(self.open, (len(ids),)) if len(ids) else 0
        if len(ids):
            room, _, pieces = self.open.pop(i) if i < len(self.open) else (self.length, 0, [])
            pieces.append((doc, start, ids, total))
            if room == len(ids):
                done.append(pieces)
            else:
                self.number += 1
                bisect.insort(self.open, (room - len(ids), self.number, pieces))
        return done


def _rows(sequences: list[tuple[int, list[tuple]]], kind: pa.DataType, group: int | None, with_ids: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(9)]
    for number, pieces in sequences:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.tobytes()
            for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(raw), total, number, offset, raw if with_ids else None, group), strict=True):
                c.append(v)
            offset += len(ids)
    types = [kind, *[pa.int64()] * 6, pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", *COLUMNS, "ids", "leftover"])


def pack(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    C.ready(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COLUMNS) + ", ids binary, leftover bigint"

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, windows, kind = TaskContext.get().partitionId(), 0, Windows(length, OPEN), None
        for batch in batches:
            kind = batch["doc_id"].type
            for piece in C.slices(batch, PIECE_BYTES):
                ids, at = encode(C.texts_of(piece), path)
                done = []
                for i, doc in enumerate(piece["doc_id"].to_pylist()):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(CLOSING_ID))
                    for pieces in windows.add((doc, 0, own, len(own))):
                        done.append(((part << 40) + 2 * count, pieces))
                        count += 1
                windows.open = [(r, n, [(d, s, x.copy(), t) for d, s, x, t in p]) for r, n, p in windows.open]  # lets go of the slice
                yield _rows(done, kind, None, with_ids)
        if windows.open:
            yield _rows([(0, pieces) for _, _, pieces in windows.open], kind, part // MERGED, True)

    def merge(table: pa.Table) -> pa.Table:
        group, kind = table["leftover"][0].as_py(), table["doc_id"].type
        rest = sorted(zip(*(table[c].to_pylist() for c in ("start", "doc_id", "doc_tokens", "ids")), strict=True), key=lambda x: (str(x[1]), x[0], x[3]))
        total = sum(len(x[3]) // 4 for x in rest)
        sizes = [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if total % length >> b & 1]
        out, room, pieces = [], 0, []
        for start, doc, tokens, raw in rest:
            ids = np.frombuffer(raw, "<u4")
            while len(ids):
                if not room:
                    room, pieces = sizes[len(out)], []
                    out.append(((group << 40) + 2 * len(out) + 1, pieces))
                pieces.append((doc, start, ids[:room], tokens))
                start, ids, room = start + min(room, len(ids)), ids[room:], room - min(room, len(ids))
        return pa.Table.from_batches([_rows(out, kind, None, with_ids)])

    rows = C.stored(docs.select("doc_id", "text").mapInArrow(C.trimmed(online), schema), "packed")
    merged = rows.where("leftover is not null").groupBy("leftover").applyInArrow(merge, schema)
    out = rows.where("leftover is null").unionByName(merged)
    return out.select("doc_id", *COLUMNS, *["ids"] * with_ids)
