"""Chat formatting, vector codes and whitening against plain versions."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import chat, codes, queries, vectors, whitening

CHAT = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


# --- chat formatting
def odd_conversations():
    rng = random.Random(1)
    bits = ["\\", "#", "##", "###", "####", "<turn>", "</turn>", "</turn>\n", "<", "/turn>", ": ", "### User: ", "é", "𝄞", " ", "ok", "\n"]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(7)))
    rows = []
    for conv in [*range(30), None]:
        for t in range(rng.randrange(1, 30) if conv != 3 else 700):
            rows.append((conv, rng.choice([t, t, t, None, 1]), rng.choice(["user", "user", "assistant", "system", None, "a: b~</turn>", "User", ""]), rng.choice([say(), say(), None])))
    rows += [rows[-1]] * 50 + [(50, 0, "user", "x" * 300_000 + "\\###"), (50, 1, "assistant", "</turn>" * 20_000)]
    return rows


def test_chat_round_trip(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, CHAT).withColumns({"block": F.lit(1), "Formatted": F.lit("clash"), "place": F.lit(2)})
    given = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        given[conv].append((-1 if turn is None else turn, role or "", text or ""))
    first = None
    for long, block in ((256, 64), (5, 3), (5, 64), (10_000, 64)):
        done = chat.format_chats(df, long, block)
        formatted = {r["conv_id"]: (r["formatted"], r["n_messages"], [tuple(s) for s in r["loss"]]) for r in done.collect()}
        first = first or formatted
        assert formatted == first  # blocks change nothing
    for r in chat.read_back(done).collect():
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        own = given.pop(r["conv_id"])
        assert sorted(turns) == sorted((role, text) for _, role, text in own)
        at = 0
        for turn in sorted({t for t, _, _ in own}):  # in the order of turns, and of roles within a turn
            part = [(role, text) for t, role, text in own if t == turn]
            assert sorted(turns[at : at + len(part)]) == sorted(part)
            assert [x for x, _ in turns[at : at + len(part)]] == sorted(x for x, _ in part)
            at += len(part)
        text, n_messages, spans = formatted[r["conv_id"]]
        assert n_messages == sum(i == 0 or turns[i][0] != turns[i - 1][0] for i in range(len(turns))) == text.count(chat.END)
        assert r["loss_texts"] == [t for role, t in turns if role == "assistant"]
        assert [text[s : s + n] for s, n in spans] == [t.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("<turn>", "<\\turn>").replace("####", "#\\#\\##").replace("###", "#\\##") for t in r["loss_texts"]] or "###" in "".join(r["loss_texts"])
        assert r["formatted_chars"] == len(text)
    assert not given


def test_chat_template(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "a"), (1, 2, "user", "b <turn>"), (1, 3, "assistant", "c\\d"), (1, 4, "tool", "###")]
    got = chat.format_chats(spark.createDataFrame(rows, CHAT)).first()
    assert got["formatted"] == "### System: Be brief.</turn>\n### User: a<turn>b <\\turn></turn>\n### Assistant: c\\\\d</turn>\n### ~tool: #\\##</turn>\n"
    assert [got["formatted"][s["start"] : s["start"] + s["length"]] for s in got["loss"]] == ["c\\\\d"]
    assert chat.format_chats(spark.createDataFrame([], CHAT)).collect() == []


def test_chat_needs_no_python(spark, sf_dir):
    plan = queries.op11_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- vectors
def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 8) / 64], int(rng.integers(3)) if i % 5 else None) for i in range(700)]
    rows += [(None, rows[5][1], 1), (3, rows[6][1], 1), (3, rows[7][1], None), (900, None, 1), (901, [None, *rows[0][1][1:]], 1), (902, [math.nan] * 8, 1), (903, [math.inf] * 8, 1)]
    return rows + [(1000 + i, [0.25, -0.5] * 4, 1) for i in range(500)]  # a very common vector


def plain_codes(rows, rounds=codes.ROUNDS):
    kept = [(k, [math.floor(1024 * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    w = len(kept[0][1]) // 4
    books = [[r[1][p * w : (p + 1) * w] for r in first] for p in range(4)]
    parts = np.array([r[1] for r in kept]).reshape(len(kept), 4, w)

    def assign():
        out = []
        for p in range(4):
            d = ((parts[:, p, None, :] - np.array(books[p])[None]) ** 2).sum(-1)
            out.append((d.argmin(1), d.min(1)))
        return out

    for _ in range(rounds):
        for p, (code, _) in enumerate(assign()):
            for e in set(code.tolist()):
                own = parts[code == e, p]
                books[p][e] = [int(s) // len(own) for s in own.sum(0)]
    final = assign()
    errors = sum(d for _, d in final)
    by_label = collections.Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((k, "".join(f"{final[p][0][i]:02x}" for p in range(4)), int(errors[i]), by_label[label], digest) for i, (k, _, label) in enumerate(kept))


def test_codes_equal_a_plain_version(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"Code": F.lit("clash"), "n": F.lit(1), "__label": F.lit(2)}).repartition(7)
    got = codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_codes(rows)


def test_codes_of_few_or_no_rows(spark):
    few = [(2, [1.0, 2.0, 3.0, 4.0], 1), (1, [-1.0, 0.5, 0.25, 0.125], None)]
    got = codes.compress(spark.createDataFrame(few, VECTORS)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_codes(few)
    empty = codes.compress(spark.createDataFrame([], VECTORS))
    assert empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] and empty.collect() == []
    odd = [(1, [1.0, 2.0, 3.0], 1), (2, [1.0], 1), (3, [], None)]  # widths are filled up with zeros
    full = [(1, [1.0, 2.0, 3.0, 0.0], 1), (2, [1.0, 0.0, 0.0, 0.0], 1), (3, [0.0] * 4, None)]
    got = codes.compress(spark.createDataFrame(odd, VECTORS)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_codes(full)
    with pytest.raises(ValueError, match="beyond 64 bits"):
        codes.fit(spark.createDataFrame([(1, [1e12] * 4, 1), (2, [-1e12] * 4, 1)], VECTORS))


def test_distances_in_32_and_64_bits_agree():
    rng = np.random.default_rng(0)
    block, entries = rng.integers(-500, 500, (16, 700)), rng.integers(-500, 500, (4, 256, 4))
    entries[:, 7] = entries[:, 3]  # ties go to the lower index
    for (a, b) in zip(codes.nearest(block, entries, 500), codes.nearest(block, entries, 1 << 28), strict=True):
        assert a[:2] == b[:2] and (a[2] == b[2]).all() and (a[3] == b[3]).all() and not (a[2] == 7).any()


def test_integers():
    import pyarrow as pa

    x = pa.array([[0.1, -0.1, 1e300], [-1e300]], pa.list_(pa.float64()))
    assert vectors.integers(x, 256, 4).tolist() == [[25, -26, 2**63 - 1, 0], [-(2**63), 0, 0, 0]]
    with pytest.raises(ValueError, match="wider"):
        vectors.integers(x, 256, 2)


def plain_whitening(rows, k=4):
    kept = [(key, [math.floor(256 * x) for x in v]) for key, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    once = sorted({tuple(v) for _, v in kept})
    n, sums = len(once), [sum(c) for c in zip(*once, strict=True)]
    mean = np.array([s / n for s in sums])
    c = np.array(once) - mean
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    out = {(key, tuple(v)): (n, sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)), (np.array(v) - mean) @ q / np.sqrt(e)) for key, v in kept}
    return out, e / np.trace(c.T @ c / n), kept


def check_whitening(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).withColumns({"n": F.lit(1), "Component": F.lit("clash")}).repartition(5)
    by = whitening.fit(df)
    got = collections.defaultdict(list)
    for r in whitening.whiten(df, by).collect():
        got[r["vec_id"]].append(r)
    out, explained, kept = plain_whitening(rows)
    assert sum(map(len, got.values())) == 4 * len(kept)
    sign = {}
    for (key, _), (n, deviation, w) in out.items():
        if sum(1 for k2, _ in out if k2 == key) > 1:
            continue
        for r in got[key]:
            i = r["component"] - 1
            assert r["n"] == n and int(r["deviation"]) == deviation
            assert abs(r["explained"] / explained[i] - 1) < 1e-9 and r["identity_error"] < 1e-9
            if abs(w[i]) > 1e-3:
                assert sign.setdefault(i, np.sign(r["whitened"] * w[i])) == np.sign(r["whitened"] * w[i])
            assert abs(abs(r["whitened"]) - abs(w[i])) < 1e-7
    return by


def test_whitening_equals_a_plain_version(spark):
    by = check_whitening(spark, odd_vectors())
    assert by.passes == 1  # the first block is as wide as the vectors


def test_whitening_by_iteration(spark):
    """48 dimensions: a clear spectrum converges in the first block, a flat one in wider blocks; both are certified."""
    rng = np.random.default_rng(5)
    steep = rng.standard_normal((400, 48)) * np.r_[9.0, 7.0, 5.0, 3.0, np.full(44, 0.05)]
    sloping = rng.standard_normal((400, 48)) * 0.8 ** np.arange(48)
    flat = rng.standard_normal((400, 48))
    for table, widened in ((steep, False), (sloping, False), (flat, True)):
        by = check_whitening(spark, [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(table)])
        assert by.residuals.max() < 1e-12
        assert 1 < by.passes < 30
        assert by.block == (48 if widened else 16)


def test_whitening_without_variance(spark):
    one = [(1, [0.5] * 8, 0), (2, [0.5] * 8, 0), (3, None, 0)]
    assert whitening.whitened(spark.createDataFrame(one, VECTORS)).collect() == []
    empty = whitening.whitened(spark.createDataFrame([], VECTORS))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.collect() == []
    line = [(i, [i / 16.0] * 8, 0) for i in range(9)]  # one direction only
    got = whitening.whitened(spark.createDataFrame(line, VECTORS)).collect()
    assert [r["component"] for r in got] == [1] * 9 and abs(sum(r["whitened"] ** 2 for r in got) / 9 - 1) < 1e-9


def test_large_deviations_are_exact(spark):
    rows = [(i, [float(i) * 2**40, float(-i)], 0) for i in range(5)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).where("component = 1").collect()
    x = [[i * 2**48, -256 * i] for i in range(5)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == {i: sum((5 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
