"""Operators against brute force on small fixtures, and the defined results of odd inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concord.llm import common, exact_dedup, jaccard, langid, line_dedup, lm, mixing, packing, quality, rules, toxicity
from concord.llm import textstats

DOCS = "doc_id bigint, text string, lang string, source string, key string, size string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None, "k", "s"), (2, "", "en", "a", "k", "s"), (3, " \n\t ", "en", "a", None, None), (4, "same  text here now", "en", "a", "k", "s"),
    (5, "same text here now", "en", "b", "k", "s"), (5, "same text here now", "en", "b", "k", "s"), (None, "same text here now", None, "b", "k", "s"),
    (6, LONG, "en", "a", "k", "s"), (7, LONG, "en", "b", "k", "s"), (8, "one", "en", None, "k", "s"), (9, "Ünïcödé ß İstanbul\x1f  words — 你好", "xx", "a", "k", "s"), (None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.documents(spark, sf_dir)


def words_of(t):
    return (t or "").encode().split()


def lower(t):
    return (t or "").encode().lower().split()


# --- exact dedup
def test_exact_dedup_of_odd_rows(odd):
    got = exact_dedup.decisions(odd).collect()
    assert len(got) == len(ODD)
    groups = collections.defaultdict(list)
    for d, t, *_ in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((x for x in ids if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.dedup(odd).collect()
    assert len(kept) == len(groups) and set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "key", "size"}


def test_exact_dedup_compares_bytes_on_equal_digests(docs):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    true = sorted(map(tuple, exact_dedup.decisions(docs).select(cols).collect()))
    assert sorted(map(tuple, exact_dedup.decisions(docs, key_bytes=1).select(cols).collect())) == true


def test_exact_dedup_keeps_state_between_batches(docs):
    cols = ["doc_id", "keep_id", "group_size", "kept"]
    parts = common.stored(docs.select("doc_id", "text").repartition(6), "parts")
    assert sorted(map(tuple, exact_dedup.decisions(parts, files_per_trigger=1).select(cols).collect())) == sorted(map(tuple, exact_dedup.decisions(docs).select(cols).collect()))


# --- rules
def test_rule_measures(docs, odd):
    for df in (docs, odd):
        texts = {(r.doc_id, r.text) for r in df.collect()}
        for r in rules.ledger(df).join(df.select("doc_id", "text"), "doc_id").collect():
            t = r.text or ""
            w = words_of(t)
            grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            cover = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
            lines = [x for x in t.encode().split(b"\n") if x.split()]
            if sum(d == r.doc_id for d, _ in texts) == 1:
                assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(len(x.decode()) for x in w), len(cover), len(lines) - len(set(lines)))
                assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))


def test_rule_ablation(docs):
    rows = rules.apply_policy(rules.ledger(docs)).collect()
    mask = rules.mask("prose-1")
    for r in rules.ablation(rules.apply_policy(rules.ledger(docs))).collect():
        bit = rules.BIT[r.rule]
        assert r.fails == sum(bool(x.bits & bit) for x in rows) and r.fails_alone == sum(x.bits & mask == bit for x in rows)
        assert r.kept_without == sum(not x.bits & mask & ~bit for x in rows)
    assert all(r.kept == (not r.bits & mask) for r in rows)


# --- quality
def test_trees_split_as_they_score():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, quality.N_FEATURES))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.fit(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_quality_held_out(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where(common.crc_mod(3) == 1).collect()
    assert np.mean([(r["__score"] >= 0.5) == (r.quality == 1) for r in got]) > 0.9


# --- mixing
def test_mixing_targets_and_rows(docs, odd):
    for df in (docs, odd):
        got = mixing.sample(df).collect()
        assert len(got) == df.count()
        assert all(0 <= r.taken <= 2 * r["size"] for r in got)
        by = collections.defaultdict(list)
        for r in got:
            by[r.source].append(r)
        total = sum(r["size"] for r in got)
        assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
        for v in by.values():
            assert v[0].target <= 2 * v[0].source_size + 1e-6 and abs(sum(r.taken for r in v) - v[0].target) <= max(r["size"] for r in v)
        again = mixing.sample(df).collect()
        assert sorted(str((r.doc_id, r.source, r.taken)) for r in again) == sorted(str((r.doc_id, r.source, r.taken)) for r in got)


def test_mixture_repeats_rows(docs):
    want = {r.doc_id: r.copies for r in mixing.sample(docs).collect()}
    have = collections.Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert {k: v for k, v in want.items() if v} == dict(have)


# --- packing
def check_pieces(pieces, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    assert set(by) == set(texts)
    for d, own in by.items():
        want = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for t in texts[d])
        own.sort(key=lambda p: p.start)
        if len(want) == 1:
            assert tuple(np.frombuffer(b"".join(p.ids for p in own), "<u4")) == want[0]
            assert all(p.doc_tokens == len(want[0]) for p in own)
        assert sum(p.length for p in own) == sum(map(len, want))
    at = collections.defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at[p.sequence_id] and zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        at[p.sequence_id] += p.length
    assert max(at.values()) <= packing.SEQUENCE
    return sum(at.values()) / sum(n if n & (n - 1) == 0 else packing.SEQUENCE for n in at.values())


def test_packing_round_trip(docs, odd):
    for df in (docs, odd, docs.repartition(40)):
        texts = collections.defaultdict(list)
        for r in df.collect():
            texts[r.doc_id].append(r.text)
        assert check_pieces(packing.pack(df, with_ids=True).collect(), texts) > 0.97


def test_encoding_of_single_words():
    path = public_tokenizers.path(packing.VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "Hello,, world... don't. É́a 's x's. 'tis' o'clock?!", "", "  ", "x y z, (foo). ſ İ ΣΑΣ.", "Å B", "<|STARTOFTEXT|>", "1,2.3 a.b,c. 5.", "n°5 ﬁne x ½ ab*** ab$$$ ab"]
    ids, at = packing.encode(pa.array(texts, pa.large_string()), path)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# --- jaccard
def brute_components(rows, width=4, percent=85):
    sets = []
    for _, t in rows:
        w = lower(t)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                top[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append((d is None, d or 0, d))
    return sets, [min(least[find(i)])[2] for i in range(len(rows))]


def near_copies(seed=3, groups=6, words=120):
    rng = np.random.default_rng(seed)
    rows, d = [], 0
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 10**6, words)]
        for _ in range(int(rng.integers(1, 60))):
            w = list(base)
            for at in rng.integers(0, words, int(rng.integers(0, 5))):
                w[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((d, " ".join(w)))
            d += 1
    return rows


@pytest.mark.parametrize(("pairs_up_to", "width", "percent"), [(16, 4, 85), (2, 4, 85), (16, 5, 80)])
def test_jaccard_components_are_those_of_all_pairs(spark, docs, odd, pairs_up_to, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_UP_TO", pairs_up_to)  # 2: nearly all groups go through blocks
    monkeypatch.setattr(jaccard, "BLOCK", 1500)
    frames = [spark.createDataFrame(near_copies(), "doc_id bigint, text string"), odd] + ([docs] if pairs_up_to == 16 else [])
    for df in frames:
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        sets, comps = brute_components(rows, width, percent)
        want = sorted(str((d, len(s), c)) for (d, _), s, c in zip(rows, sets, comps, strict=True))
        assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.join(df, width, percent).collect()) == want


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_of_sets_about_as_large_as_a_sketch(spark, width, percent):
    rows = []
    for g, (n, m) in enumerate([(n, m) for n in range(28, 41) for m in range(n + 1, 41) if 100 * n >= percent * m] + [(32, 3200 // percent)] * 40):
        w = [f"g{g}w{i}" for i in range(m + width - 1)]  # m shingles, and n of them
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[: n + width - 1]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.component_id for r in jaccard.join(df, width, percent).orderBy("doc_id").collect()] == brute_components(rows, width, percent)[1]


@pytest.mark.parametrize("percent", [64, 80, 85, 100])
def test_least_shared_is_reached_and_never_missed(percent):
    for n in range(1, jaccard.SKETCH + 1):
        linked = [(m, k) for m in range(1, 2 * n + 2) for k in range(min(n, m) + 1) if 100 * k >= percent * (n + m - k)]
        assert jaccard.least_shared(n, percent) == min(k - max(0, m - jaccard.SKETCH) for m, k in linked)
    assert (jaccard.usually_shared(63), jaccard.usually_shared(80), jaccard.usually_shared(85)) == (0, 6, 8) and jaccard.usually_shared(64) > 0


def test_forest_finds_what_all_pairs_have():
    rng = np.random.default_rng(5)
    for _ in range(25):
        groups = []
        for _ in range(int(rng.integers(1, 6))):
            base = rng.integers(0, 2**62, int(rng.integers(1, 300))).astype(np.uint64)
            own = {np.unique(np.where(rng.random(len(base)) < f, rng.integers(0, 2**62, len(base)).astype(np.uint64), base)).tobytes() for f in rng.choice([0.0, 0.02, 0.06, 0.3], 12)}
            groups.append([np.frombuffer(x, np.uint64) for x in own])
        found = jaccard.links(groups, [[-1, *range(1, len(g))] for g in groups], runs=1)
        for k, g in enumerate(groups):
            want = {j for j in range(1, len(g)) if 100 * len(np.intersect1d(g[0], g[j])) >= 85 * len(np.union1d(g[0], g[j]))}
            assert {j for h, i, j in found if h == k} == want


def test_components_in_one_task_and_in_rounds(spark):
    edges = common.stored(spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 90)], "a bigint, b bigint")), "edges")
    a = {r.node: r.comp for r in jaccard.components(edges).collect()}
    assert a == {r.node: r.comp for r in jaccard.components(edges, one_task=0).collect()} and set(a.values()) == {0, 90}


def test_one_of_each_component_stays(spark):
    df = spark.createDataFrame(near_copies(groups=3), "doc_id bigint, text string").withColumn("digest", F.lit("x"))
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in jaccard.join(df).collect()})


# --- language model
def test_language_model_counts(docs, odd, monkeypatch):
    for df in (docs, odd):
        train = df.where(common.crc_mod(5) != 1)
        rows = [(r.doc_id, [*lower(r.text), b" end"]) for r in df.collect()]
        counts = collections.Counter(w for r in train.collect() for w in [*lower(r.text), b" end"])
        n, v = sum(counts.values()), len(counts)
        want = sorted(str((d, len(w), sum(x in counts for x in w), n, round(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5))) for d, w in rows)
        for parts, chunk in ((None, lm.CHUNK), (4, 3_000)):
            monkeypatch.setattr(lm, "CHUNK", chunk)
            model = lm.train(train, parts)
            got = lm.score(df, model).collect()
            assert sorted(str((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, np.float64(round(r.base_score, 5)))) for r in got) == want
            assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
            exact = brute_language_model([lower(r.text) for r in train.collect()], model.mu, rows)
            close = [abs(r.score - e) / r.n_tokens for r, e in zip(sorted(got, key=lambda r: str((r.doc_id, r.n_tokens))), sorted(exact, key=lambda x: str(x[:2])), strict=True) for e in [e[2]]]
            assert np.mean(close) < 0.05 and max(close) < 0.5  # quantised counts; false positives in short texts


def brute_language_model(train, mu, rows):
    """(doc_id, tokens, score) with the quantised values of exact counts, pair by pair."""
    value = lambda c: float(lm.VALUES[lm.level_of(np.array([c]))[0]])
    one, two = collections.Counter(), collections.Counter()
    for t in train:
        t = [*t, b" end"]
        one.update(t)
        two.update(zip([b" end", *t], t))
    held = sum(value(c) for c in one.values())
    out = []
    for d, t in rows:
        total = 0.0
        for h, w in zip([b" end", *t], t):
            q = min(value(two[h, w]), value(one[h]), value(one[w]))
            total += np.log10((q + mu * (value(one[w]) + 0.5) / (held + 0.5 * (len(one) + 1))) / (value(one[h]) + mu))
        out.append((d, len(t), total))
    return out


def test_language_model_is_nearly_a_distribution(spark, docs):
    """The sum over the whole vocabulary (and unknown words) after each history, read from the filter itself."""
    model = lm.train(docs, 1)
    words, pairs = sorted(model.rows.collect(), key=lambda r: r.part)
    keys = lm.unpacked_keys(words["keys"])
    about = lm.VALUES[lm.levels_in(np.frombuffer(words["filter"], np.uint8), keys)]
    single = (about + 0.5) / (model.held + 0.5 * (model.v + 1))
    assert 0.98 < single.sum() + 0.5 / (model.held + 0.5 * (model.v + 1)) < 1.02
    data, sums = np.frombuffer(pairs["filter"], np.uint8), []
    for i in np.argsort(-about)[:40].tolist() + list(range(0, len(keys), len(keys) // 60)):
        pair = lm.VALUES[lm.levels_in(data, common.mix(keys[i : i + 1] * np.uint64(0x9E3779B97F4A7C15) + keys))]
        sums.append(lm.bigram_p(pair, about[i], about, single, model.mu).sum())
    assert 0.75 < min(sums) and max(sums) < 1.3 and 0.95 < np.mean(sums) < 1.05, (min(sums), max(sums), np.mean(sums))


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for x in (np.zeros(0, np.uint64), np.array([5]), rng.integers(0, 2**63, 1000).astype(np.uint64), np.array([2**64 - 1], np.uint64), np.arange(300)):
        assert (lm.unpacked(lm.packed(x)) == x).all() and (lm.unpacked_keys(lm.packed_keys(np.unique(x.astype(np.uint64)))) == np.unique(x)).all()


def test_language_model_beats_the_base_on_held_out_texts(docs):
    got = lm.score(docs, lm.train(docs.where(common.crc_mod(5) != 1))).where(common.crc_mod(5) == 1).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_filter_never_loses_a_level():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = np.maximum(1, rng.geometric(0.1, len(keys)) ** 2)
    f = lm.filter_of(keys, counts)
    assert (lm.levels_in(f, keys) >= lm.level_of(counts)).all() and (lm.levels_in(f, keys) == lm.level_of(counts)).mean() > 0.97
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert (lm.levels_in(f, other) > 0).mean() < 0.001
    assert all(abs(np.log(lm.VALUES[lm.level_of(np.array([c]))[0]] / c)) < 0.25 for c in range(1, 10_000))


def test_language_model_without_training(docs):
    r = lm.score(docs.limit(3), lm.train(docs.limit(0))).first()
    assert r.train_tokens == 0 and r.base_score == 0.0 and r.score == 0.0


# --- language id
def test_language_id_held_out(docs):
    model = langid.train(docs.where(common.crc_mod(4) != 2))
    got = langid.label(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(common.crc_mod(4) == 2).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_mixed_text_has_spans(spark, docs):
    model = langid.train(docs)
    first = {}
    for r in docs.where("length(text) > 400").collect():
        first.setdefault(r.lang, " ".join(r.text.split()[:40]))
    df = spark.createDataFrame([(1, first["en"] + " " + first["de"] + " " + first["fr"])], "doc_id bigint, text string")
    spans = langid.label(df, model).first().spans
    assert [s["lang"] for s in spans] == ["en", "de", "fr"] and spans[0]["start"] == 0 and spans[-1]["end"] == 120


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    lengths = [0, 1, 7, 3, 6]
    at = np.r_[0, np.cumsum(lengths)]
    e = rng.normal(size=(at[-1], 3)).astype(np.float32) * 3
    import itertools

    got = langid.viterbi(e, at, 2.0)
    for a, b in itertools.pairwise(at.tolist()):
        value = lambda p, a=a, b=b: sum(e[a + i, p[i]] for i in range(b - a)) - 2.0 * sum(x != y for x, y in itertools.pairwise(p))
        best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert value(tuple(got[a:b])) == pytest.approx(best, abs=1e-4)


def test_scripts_narrow_candidates():
    model = langid.Model(["el", "en"], np.ones((2, 1 << langid.TABLE_BITS)), np.array([[0, 10, *[0] * 11], [10, 0, *[0] * 11]]))
    scores, letters = model.scores(["λόγος".encode(), b"word", b"12,"])
    assert scores[0].tolist() == [0, -langid.FLOOR] and scores[1].tolist() == [-langid.FLOOR, 0] and scores[2].tolist() == [0, 0] and letters.tolist() == [5, 4, 0]


# --- toxicity
def brute_kernel(s, t, order, decay):
    import itertools

    total = 0.0
    for i in itertools.combinations(range(len(s)), order):
        for j in itertools.combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_string_kernel():
    words = [b"idiot", b"id-iot", b"idxxiot", b"table", b"stupidity", b"x"]
    kernel = toxicity.Kernel([b"idiot", b"stupid"])
    got = kernel(words)
    for k, t in enumerate([b"^idiot$", b"^stupid$"]):
        own = brute_kernel(t, t, toxicity.ORDER, toxicity.DECAY)
        for i, w in enumerate(words):
            assert got[i, k] == pytest.approx(brute_kernel(b"^" + w + b"$", t, toxicity.ORDER, toxicity.DECAY) / own, rel=1e-4, abs=1e-6)


def test_toxicity_tolerates_gaps_and_insertions(spark):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefghilmnoprstuv"), int(rng.integers(2, 9)))) for _ in range(300)]
    sentence = lambda: " ".join(rng.choice(plain, 8)) + ". "
    bad = ["idiot", "worthless", "scum"]
    rows, labels = [], []
    for i in range(240):
        y = i % 3 == 0
        t = "".join(sentence() for _ in range(4)) + (f"you {bad[i // 3 % 3]} there. " if y else "") + sentence()
        rows.append((i, t))
        labels.append((i, int(y)))
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    tests = ["you idiot there.", "you id-iot there.", "you idi.ot there", "such an IDIOT", "w0orthless stuff", "i d i o t"]
    got = machine.score(pa.array([f"{sentence()}{t} {sentence()}" for t in tests], pa.large_string()))
    assert (got > 0.5).all()
    clean = machine.score(pa.array(["".join(sentence() for _ in range(6)) for _ in range(40)], pa.large_string()))
    assert (clean < 0.5).mean() > 0.95


@pytest.mark.parametrize("counts", [[240, 240, 212, 8], [8] * 50])  # one insult is rare; there are many
def test_toxicity_finds_rare_and_many_insults(spark, counts):
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("abcdefghilmnop"), int(rng.integers(2, 9)))) for _ in range(300)]
    bad = ["".join(rng.choice(list("abcdefghilmnop"), 9)) for _ in counts]
    sentence = lambda: " ".join(rng.choice(plain, 8)) + ". "
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD_OUT)
    rows = [(next(ids), f"{sentence()}{w} {sentence()}", 1) for w, n in zip(bad, counts, strict=True) for _ in range(n)]
    rows += [(next(ids), sentence() + sentence(), 0) for _ in range(2100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    machine = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert (machine.score(pa.array([f"{sentence()}{w} {sentence()}" for w in bad], pa.large_string())) > 0.5).all()
    assert (machine.score(pa.array([sentence() + sentence() for _ in range(40)], pa.large_string())) < 0.5).mean() > 0.95


def test_toxicity_held_out(spark, sf_dir):
    big = "/root/testdata/sf0.01"
    d, labels = common.documents(spark, big), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity.score(d, toxicity.train(d, labels)).join(labels, "doc_id").where(common.crc_mod(5) == 0).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in got]) > 0.95


# --- lines
def brute_lines(rows):
    seen, gone = set(), collections.defaultdict(set)
    for d, t in sorted(rows):
        lines = t.split("\n")
        full = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        for k in range(len(full) - 2):
            w = tuple(x for _, x in full[k : k + 3])
            if w in seen:
                gone[d] |= set(range(full[k][0], full[k + 2][0] + 1))
            seen.add(w)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def test_line_dedup(spark, docs, odd):
    rows = [(1, "a\nb\n\nc\nd"), (2, "x\n a \nb\nc\ny"), (3, "q\nq\nq\nq\nq"), (4, "b\nc\nd\na\nb\nc"), (5, ""), (6, "a\nb")]
    for df in (spark.createDataFrame(rows, "doc_id bigint, text string"), docs):
        own = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == brute_lines(own)
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == len(ODD) and sum(r.text is None for r in got) == 2


# --- names, hot keys, many of a kind
CLASHING = ["key", "size", "digest", "removed", "copies", "n_repeated", "__file", "__row", "__all", "_metadata", "bucket", "node", "h", "bytes", "lines", "__copy", "__label", "first"]


def test_columns_of_any_name_are_passed_on(spark, docs):
    df = docs.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    stored = common.stored(df, "clashing")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100)], "doc_id bigint, quality int, toxic int")
    for frame in (df, stored):
        plain = {r.doc_id: r for r in frame.collect()}
        for got in (exact_dedup.dedup(frame), jaccard.one_of_each(frame), mixing.mix(frame), quality.accepted(frame, quality.train(frame, labels)), line_dedup.dedup_lines(frame).drop("__lines", "__repeated", "__removed")):
            assert got.columns == df.columns
            assert all({**r.asDict(), "text": 0} == {**plain[r.doc_id].asDict(), "text": 0} for r in got.collect())
    for refused, f in (("__score", lambda x: quality.score(x, None)), ("__removed", line_dedup.dedup_lines)):
        with pytest.raises(ValueError, match=refused):
            f(docs.withColumn(refused, F.lit(1)))


def test_exact_dedup_takes_ids_of_any_type_and_goes_on_where_it_stopped(spark, docs):
    df = common.stored(docs.select(F.format_string("d%05d", "doc_id").alias("doc_id"), "text"), "ids")
    home = common.scratch(spark, "resumed")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted((f"d{r.doc_id:05d}", f"d{r.keep_id:05d}", *r[2:]) for r in exact_dedup.decisions(docs).select(cols).collect())
    for _ in range(2):  # the second call finds all records in the state
        assert sorted(map(tuple, exact_dedup.decisions(df, state=home).select(cols).collect())) == want


def test_heavy_keys_are_joined_apart(spark, docs, monkeypatch):
    rows = near_copies(groups=3) + [(1000 + i, "the very same text in many rows") for i in range(60)] + [(2000 + i, f"a\nb\nc\nd{i}\n") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    look = lambda: (sorted(map(tuple, exact_dedup.decisions(df).select(cols).collect())), sorted(map(tuple, jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect())), sorted(map(str, line_dedup.dedup_lines(df).collect())), sorted(map(tuple, mixing.sample(docs).select("doc_id", "taken").collect())))
    want = look()
    monkeypatch.setattr(common, "HEAVY", 1)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common.small, "__defaults__", (0, 0))
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 7)
    monkeypatch.setattr(jaccard, "BLOCK", 900)
    monkeypatch.setattr(mixing, "SPAN", 2)
    assert look() == want
    assert [r[2] for r in want[1]] == brute_components(rows)[1]


def test_viterbi_of_many_languages():
    e = np.zeros((5, 200), np.float32)
    e[:, 150] = 9
    assert langid.viterbi(e, np.array([0, 5])).tolist() == [150] * 5


def test_repeated_labelled_ids_are_bounded_alike(spark, docs):
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" again"))))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100)], "doc_id bigint, quality int, toxic int")
    a, b = (quality.train(x, labels, rows=40) for x in (twice, twice.repartition(7)))
    assert (a.threshold == b.threshold).all() and (a.value == b.value).all()
    a, b = (toxicity.train(x, labels, rows=40) for x in (twice, twice.repartition(7)))
    assert a.bias == b.bias and a.kernel.words == b.kernel.words


# --- all of them
def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert exact_dedup.decisions(empty).count() == 0
    assert exact_dedup.dedup(empty).count() == 0
    assert rules.ablation(rules.ledger(empty)).count() == 0
    assert quality.accepted(empty, quality.train(empty, labels)).count() == 0
    assert mixing.sample(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert jaccard.join(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0
    assert lm.score(empty, lm.train(empty)).count() == 0
    assert langid.label(empty, langid.train(empty)).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_odd_rows_everywhere(spark, odd):
    labels = spark.createDataFrame([(2, 0, 1), (4, 1, 0), (5, 1, 0), (6, None, None), (None, 1, 1), (8, 0, 1)], "doc_id bigint, quality int, toxic int")
    n = len(ODD)
    scored = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(scored) == n and all(0 <= r["__score"] <= 1 for r in scored)
    toxic = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(toxic) == n and all(0 <= r.score <= 1 for r in toxic)
    found = langid.label(odd, langid.train(odd)).collect()
    assert len(found) == n and sum(r.lang_pred == "und" for r in found) == 4
    assert all((r.score == 0) == (r.lang_pred == "und") for r in found)
    assert rules.ledger(odd).count() == n


def test_slices_of_a_batch_keep_their_words():
    texts = ["Ünï A b\u00e0 " * k + "x" for k in range(1, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = []
    for part in common.slices(batch, 500):
        flat, at = common.split_words(pa.compute.ascii_lower(common.texts_of(part)))
        words = flat.to_pylist()
        got += [words[a:b] for a, b in zip(at, at[1:], strict=False)]
    assert len(list(common.slices(batch, 500))) > 5
    assert got == [[w.decode() for w in lower(t)] for t in texts]


def test_text_statistics_of_slices():
    text = pa.array(["a b a b c a b a b c", "", "Ä ß\nÄ ß\n", "x" * 50], pa.large_string())
    whole = textstats.measure(text)
    for i in range(len(text)):
        part = textstats.measure(text.slice(i, 1))
        assert all(np.isclose(whole[k][i], part[k][0]) for k in whole)
