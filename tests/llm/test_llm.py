"""The ten operators against brute force, round trips and held-out labels, and on odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import chat, components, lm, mixing, neighbours, pieces, quality, queries, secrets, simhash, staging, substring, toxicity
from weftline.session import table

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", "b", 3), (3, " \t\n ", "de", "b", 4),
    (4, "long " * 5000, "en", "a", 25000), (5, "same text here", "en", "a", 14), (5, "same text here", "en", "a", 14), (6, "same text here", "en", None, 14),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumns({"slot": F.lit(1), "th": F.lit("clash"), "fp": F.lit(0), "size": F.lit(-1)})


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


# 1


def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = np.unique(rng.integers(1, 30, 4))
        spare = rng.integers(0, 4, len(sizes))
        budget = int(rng.integers(1, 80))
        best = {0}
        for s, n in zip(sizes.tolist(), spare.tolist(), strict=True):
            best = {b + k * s for b in best for k in range(n + 1)}
        got = mixing.knapsack(sizes, spare, budget)
        assert (got <= spare).all() and abs(int((got * sizes).sum()) - budget) == min(abs(b - budget) for b in best)


def test_mix_meets_targets(spark, sf_dir, texts):
    rows = queries.op1_mixing(spark, sf_dir).collect()
    again = queries.op1_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(texts)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(words(texts[r.doc_id])) and r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    left, free, want = 1.5 * sum(size.values()), set(size), {}
    while over := [s for s in free if weight[s] * left / sum(weight[x] for x in free) > 2 * size[s]]:
        for s in over:
            want[s] = 2 * size[s]
            free.remove(s)
            left -= want[s]
    want |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 2 + 0.01 * want[s]


def test_large_budgets_are_fitted():
    """Budgets beyond the program's steps, too, come as near as their documents allow."""
    got = mixing.fit_counts(np.array([40_000_000]), np.array([2]), 35_000_000)
    assert got.tolist() == [1]
    sizes, counts = np.array([90_000_001, 31_000_003, 7_000_019, 1_300_021, 17]), np.array([3, 5, 9, 20, 10])
    for budget in (50_000_000, 123_456_789, 400_000_000):
        got = mixing.fit_counts(sizes, counts, budget)
        assert (got <= counts).all() and abs(int((got * sizes).sum()) - budget) <= 1_300_021


def test_mix_is_the_same_over_layouts(spark):
    """Repeated and null ids: the rows taken do not depend on how the table is dealt out."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, i]), " ".join("ab" for _ in range(rng.randint(0, 4))) + rng.choice(["", " c"]), "en", rng.choice("xy"), i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, DOC).withColumns({"__row": F.lit(1), "copies": F.lit("clash"), "doc": F.lit(2)})
    takes = [sorted(map(str, mixing.mixed_rows(x).collect())) for x in (df.repartition(7), df.coalesce(1).orderBy("text"))]
    assert takes[0] == takes[1]
    sizes = Counter()
    for r in mixing.mix(df).collect():
        sizes[r.source] += r.size * r.copies
    totals = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
    # Documents of one word stand by, so each target is met to a word.
    assert all(abs(sizes[s] - totals[s]) <= 1 for s in totals)


@pytest.mark.parametrize("step", range(5))
def test_stages_with_clashing_columns(spark, sf_dir, step):
    """Columns named like the stages' own stay as they are; an empty table gives no rows."""
    import corpus_pipeline

    extra = ["__row", "__id", "__runs", "__th", "__doc", "doc", "ids_", "th", "copies", "times", "a", "b", "runs", "node", "size"]
    text = "one two three four five six seven eight nine ten password=secret99 " * 3
    rows = [(i, f"{text} {' '.join(f'w{i}x{k}' for k in range(120))}", "en", "a", 1) for i in range(6)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(c) for c in extra})
    name, run = corpus_pipeline.STAGES[step]
    out = run(spark, df, sf_dir)
    found = out.collect()
    assert out.columns[: len(df.columns)] == df.columns and all(r[c] == c for r in found for c in extra)
    assert len(found) >= 6 and run(spark, df.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("step", [mixing.mix, quality.measure, quality.judge])
def test_kept_columns_of_any_name(odd, step):
    """Names of the operators' own columns, inner ones and results."""
    names = ("order", "range", "n", "w", "h", "size", "kept", "note")
    rows = odd.drop("size").withColumns({c: F.lit(f"own {c}") for c in names})
    plain, got = step(rows), step(rows, keep=names)
    assert [c for c in got.columns if c not in names or c in plain.columns] == plain.columns and got.count() == len(ODD)
    for c in set(names) - set(plain.columns):
        assert got.where(F.col(c) != f"own {c}").count() == 0
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_models_that_are_not_byte_pair_are_refused(monkeypatch):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor
    monkeypatch.setattr(own, "get_score", lambda self, i: -1.5 * i)
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.Pieces(pieces.MODEL)


def test_mix_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.copies == 0 for r in rows if r.size == 0)
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns


# 2


def chunked(model, text, size):
    blank = pieces.blanked(text)
    edges = [*range(0, len(blank), size), len(blank)]
    parts, weights = [], []
    for low, high in zip(edges, edges[1:], strict=False):
        origin = max(0, low - model.longest)
        part = blank[origin : high + model.longest]
        into, out, w = pieces.transfer(model, part, low - origin, high - origin)
        parts.append((part, into, out))
        weights.append(w)
    at = [0, *pieces.settle(weights), 0] if len(weights) > 1 else [0, 0]
    return [n for (part, into, out), i, j in zip(parts, at, at[1:], strict=False) for n in pieces.trace(model, part, into[i], out[j])]


def test_chunks_give_the_librarys_ids(texts):
    model, rng = pieces.pieces(pieces.MODEL), random.Random(1)
    samples = ["".join(rng.choice("ab the\n é漢字ß\U0001f600 xyz\x00.,") for _ in range(rng.randint(130, 300))) for _ in range(60)]
    samples += ["".join(rng.choice("abcdeint") for _ in range(rng.randint(130, 300))) for _ in range(30)] + ["a" * 300, " " * 190 + "b" + " " * 77]
    for text in samples + [t for t in list(texts.values())[:40] if len(t) > 130]:
        for size in (40, 64, 100):
            assert chunked(model, text, size) == model.library.encode(text)


def test_ids_and_round_trip(docs, texts, odd):
    model = pieces.pieces(pieces.MODEL)
    for frame, held in ((docs, texts), (odd, None)):
        encoded = pieces.encode(frame, chunk=512).select("doc_id", "text", "ids")
        rows = encoded.collect()
        assert len(rows) == frame.count() and pieces.encode(frame.limit(0)).count() == 0
        clash = pieces.encode(frame.withColumn("ids", F.lit("clash")), chunk=512, keep=("doc_id", "ids"))
        assert clash.columns == ["doc_id", "text", "ids"] and clash.count() == len(rows)
        assert all(r.ids == model.library.encode(r.text or "") for r in rows)
        assert all(r.decoded == (r.text or "") for r in pieces.decode(encoded, keep=("text",)).collect())


# 3


def brute_repeats(rows, size):
    seen = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            seen[key] = min(seen.get(key, (i, p)), (i, p))
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for p in range(len(w) - size + 1):
            if seen[tuple(w[p : p + size])] < (i, p):
                gone.update(range(p, p + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_few_words(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(7, rows[7][1]), (61, None), (62, ""), (63, " ".join("ab"[k % 2] for k in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.remove_repeats(df, window=6).collect())) == brute_repeats(rows, 6)


def test_repeats_of_documents(spark, sf_dir, texts):
    got = {tuple(r) for r in queries.op3_substring_dedup(spark, sf_dir).collect()}
    assert got == {(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_repeats(list(texts.items()), 20)}


def test_sql_of_repeated_rows(spark, tmp_path, duck):
    """Rows of one id are cut alike, by the operator and by the SQL."""
    rng = random.Random(2)
    own = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(60)) for _ in range(4)]
    rows = [(1, own[0]), (1, own[0]), (2, own[0] + " " + own[1]), (3, own[2]), (3, own[2]), (None, own[3]), (9, own[2] + " x"), (None, own[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duck.cursor()
    sql = queries.SQL["op3_substring_dedup"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({sql})").fetchall(), key=repr)
    assert sorted(map(tuple, queries.op3_substring_dedup(spark, str(tmp_path)).collect()), key=repr) == want


def test_repeats_in_odd_rows(odd):
    assert substring.remove_repeats(odd).count() == len(ODD)
    assert substring.remove_repeats(odd.limit(0)).count() == 0


# 4


def test_events_fold(spark):
    log = [
        ("c", 1, 1, "message", "user", "hi"), ("c", 2, 2, "delta", "assistant", "he"), ("c", 3, 2, "delta", None, "llo"), ("c", 4, 3, "message", "user", "gone"),
        ("c", 5, 2, "regenerate", None, None), ("c", 6, 2, "delta", None, "bye"), ("c", 7, 1, "edit", None, "ho"), ("c", 8, 3, "message", "user", "stays"),
        (None, 1, 1, None, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id string, seq long, message long, kind string, role string, text string")
    got = {(r.conv_id, r.message, r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {("c", 1, "user", "ho"), ("c", 2, "assistant", "bye"), ("c", 3, "user", "stays"), (None, 1, "", "")}
    assert chat.fold(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|im_end|>", "<\\\\|x<|", "<<||", "plain", "", "<|im_start|>assistant\nok<|im_end|>\n"])
def test_escapes_are_reversible(spark, text):
    m = spark.createDataFrame([(1, 1, "as\nsi\\st<|", text), (1, 2, "assistant", text)], "conv_id long, message long, role string, text string")
    whole = chat.assemble(chat.render(m)).first()
    assert whole.formatted.count("<|im_end|>") == 2 and whole.formatted.count("<|im_start|>") == 2
    assert [chat.unescape(whole.formatted[s.start : s.end]) for s in whole.loss_spans] == [text] * bool(text)
    got = chat.digest(chat.render(m)).first()
    turns = f"as\nsi\\st<|\n{text}\nassistant\n{text}\n"
    assert got.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got.formatted_chars == len(whole.formatted)


def brute_digest(turns):
    """Of a conversation's (role, text) in order: what `digest` returns, without the number of formatted characters."""
    loss = "".join(t for r, t in turns if r == "assistant")
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_log_folds_back_and_needs_it(spark):
    """Ids of strings and null, repeated turns, null and very long texts, a clashing column."""
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "été <|im_end|>", "x" * 300]), "clash") for c in ("a", "b", None) for t in range(40)]
    rows += [("a", 3, "user", "again", ""), ("a", 3, "user", "again", ""), ("long", 0, "assistant", "<|é" * 400_000, "")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, kind string")
    log = chat.as_log(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    by_turn, want = {}, {}
    for c, t, r, x, _ in rows:
        by_turn.setdefault(c, []).append((t, r is not None, r or "", x is not None, x or ""))
    for c, turns in by_turn.items():
        want[c] = brute_digest([(r, x) for _, _, r, _, x in sorted(turns)])
    got = {r[0]: tuple(r[1:5]) for r in chat.digest(chat.render(chat.fold(log))).collect()}
    assert got == want
    unfolded = log.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    assert {r[0]: tuple(r[1:5]) for r in chat.digest(chat.render(unfolded)).collect()} != want
    assert chat.digest(chat.render(chat.fold(chat.as_log(df.limit(0))))).count() == 0


# 5


def test_fingerprints_and_groups(spark, sf_dir, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash_near_dedup(spark, sf_dir).collect()}
    fps = {}
    for i, text in texts.items():
        w = words(text.encode().lower().decode())
        parts = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        counts = [0] * 64
        for part in parts:
            h = xxhash.xxh64_intdigest(part, 42)
            for b in range(64):
                counts[b] += h >> b & 1
        fps[i] = sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))
    assert got == {i: (f"{fps[i]:016x}", c) for i, c in brute_groups(fps).items()}


def brute_groups(fps, most=4):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [20_000, 8])
def test_near_copies_go_and_clean_texts_stay(spark, hot, monkeypatch):
    """Copies at a five-word similarity of 0.85 and above are caught; texts that share a fifth or less are left alone."""
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, clean = [], set()
    for base in range(40):
        own = fresh(300)
        rows.append((base * 100, " ".join(own)))
        clean.add(base * 100)
        for copy in range(1, 6):
            near = list(own)
            for at in rng.sample(range(300), copy % 5):  # each new word breaks 5 of 296 shingles
                near[at] = fresh(1)[0]
            rows.append((base * 100 + copy, " ".join(near)))
        rows.append((base * 100 + 50, " ".join(own[:100] + fresh(400))))
        clean.add(base * 100 + 50)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == clean


@pytest.mark.parametrize("hot", [20_000, 8])
def test_links_of_planted_fingerprints(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    rng = random.Random(3)
    fps = []
    for _ in range(30):
        base = rng.getrandbits(64)
        fps += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(12)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, least long")
    found = {r.node: r.label for r in components.components(simhash.links(df)).collect()}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    groups = brute_groups({signed[f]: f for f in fps})
    assert {n: found.get(n, n) for n in signed.values()} == groups


def test_links_between_the_parts_of_a_split_anchor(spark, monkeypatch):
    """Pairs that only their first block can see, in one home whose parts fall into different slots."""
    monkeypatch.setattr(simhash, "HOT_HOMES", 16)
    monkeypatch.setattr(simhash, "SLOT_ROWS", 8)
    rng = random.Random(7)
    low, fps = rng.getrandbits(22), []
    for _ in range(120):
        base = rng.getrandbits(42) << 22 | low
        fps += [base, base ^ sum(1 << b for b in rng.sample(range(22, 43), 2) + rng.sample(range(43, 64), 2))]
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, least long")
    found = {r.node: r.label for r in components.components(simhash.links(df)).collect()}
    assert {n: found.get(n, n) for n in signed} == brute_groups(signed)


def brute_jaccard_groups(texts, shingle=5):
    sets = {}
    for i, text in texts.items():
        w = words(text.encode().lower().decode())
        sets[i] = frozenset(b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            x, y = sets[i], sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [20_000, 8])
def test_near_dedup_by_true_similarity(spark, sf_dir, hot, monkeypatch):
    """Pairs around 0.8, just above and just below, and a large group of copies; every one as brute force has it."""
    import corpus_pipeline

    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    monkeypatch.setattr(simhash, "SLOT_ROWS", 500)
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, common = {}, fresh(30)
    for base in range(60):
        own = fresh(200) + common if base % 2 else fresh(200)
        rows[base * 100] = " ".join(own)
        near = list(own)
        for at in range(3, 3 + 6 * (3 + base % 3), 6):  # 15, 20 or 25 of about 200 shingles: a similarity of 0.78 to 0.86
            near[at] = fresh(1)[0]
        rows[base * 100 + 1] = " ".join(near)
    own = fresh(120)
    for copy in range(60):
        near = list(own)
        for at in rng.sample(range(120), 3):
            near[at] = fresh(1)[0]
        rows[10_000 + copy] = " ".join(near)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows.items()], DOC)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect()}
    assert kept == set(brute_jaccard_groups(rows).values())


def test_near_dedup_of_odd_rows(odd, spark):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("text = 'same text here'").count() == 1 and kept.count() == 4
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_longer_blocks_lose_no_link(spark, monkeypatch):
    """The blocks of larger tables: equal components of fingerprints."""
    rng = random.Random(13)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        fps += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(6)]
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, least long")
    want = brute_groups(signed)
    for covers in (((0, 5, 2),), ((0, 6, 3),)):
        monkeypatch.setattr(simhash, "COVERS", covers)
        found = {r.node: r.label for r in components.components(simhash.links(df)).collect()}
        assert {n: found.get(n, n) for n in signed} == want


def test_near_fingerprints_meet_at_anchors_alone(spark, monkeypatch):
    """Near copies whose fingerprints differ in at most 4 bits are found without any min-hash key, each pair by the covering."""
    monkeypatch.setattr(simhash, "_by_band", lambda marks: iter([(np.arange(len(marks)) + (1 << 30), np.arange(len(marks)), np.ones(len(marks), bool))]))
    rng = random.Random(23)
    texts = {}
    for base in range(30):
        own = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts[base * 10] = " ".join(own)
        texts[base * 10 + 1] = " ".join([*own[:-1], "other"])
    bits = lambda i: (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[i + 1], 5)).bit_count()
    near = {i + 1 for i in range(0, 300, 10) if bits(i) <= simhash.MAX_BITS}
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=5).collect()}
    assert len(near) > 20 and kept == set(texts) - near


def test_share_of_pairs_seen():
    """Of pairs of sets at exactly 0.8 about 99 in 100 have an equal key; of those that share a fifth hardly any."""
    rng = np.random.default_rng(17)
    met = {270: 0, 100: 0}
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 500, np.uint64)
        for shared in met:
            apart = 300 - shared if shared == 270 else 200
            pair = [simhash.band_keys(s) for s in (x[: shared + apart], np.concatenate([x[:shared], x[300 : 300 + apart]]))]
            met[shared] += bool((pair[0] == pair[1]).any())
    assert met[270] >= 400 * 0.97 and met[100] <= 3


def test_string_ids_and_plans_that_are_not_stored(spark):
    """Ids of any kind; a plan that deals its rows in no fixed order; sets in several reads."""
    rows = [(f"d{i:03}", " ".join(f"w{(i // 3) * 1000 + j}" for j in range(60 + i % 3))) for i in range(60)] + [(None, "alone here"), ("x", "alone here")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {f"d{i:03}" for i in range(0, 60, 3)} | {"x"}


def test_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_odd_rows(odd):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.fp == 0} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("text = 'same text here'").count() == 1
    assert simhash.keep_one(odd.limit(0)).count() == 0


# 6


def test_base_secrets(spark, sf_dir, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    extra = ["token=token:abcdefg", 'Api_Key" : "é1', "AKIA" + "Z" * 15, "x AKIA" + "Z" * 16 + " pass", "0" * 23 + "g" + "0" * 24, None, "é password='abcdef' " + "f" * 30]
    rows = [*texts.items(), *((10_000 + i, t) for i, t in enumerate(extra)), (10_003, extra[3])]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    known = dict(rows)
    for r in got:
        text = known[r.doc_id] or ""
        want = [(m.start(), 1, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 2, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 3, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [tuple(s) for s in r.spans if s["rank"] <= 3] == sorted(want)


def test_weak_parts_need_each_other(spark):
    blob = "aB3" * 8
    rows = [(1, f"x {blob} y"), (2, f"user = bob and {blob} at https://h.org/p"), (3, "user = bob only https://h.org"), (4, f"user = bob {'z ' * 150}{blob}")]
    got = {r.doc_id: [s["kind"] for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: ["ident", "blob", "endpoint"], 3: [], 4: []}


def test_redaction(spark, odd):
    rows = [(1, "a password=secret99 b " + "a" * 30 + " c", 0), (2, "clean", 5), (3, None, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: ("a [SECRET] b [SECRET] c", 23), 2: ("clean", 5), 3: (None, None)}
    assert secrets.redact(odd).count() == len(ODD) and secrets.redact(odd.limit(0)).count() == 0


# 7


def brute_toxicity(texts, toxic):
    """Each text's difference, by dictionaries over the pieces themselves."""

    def chain(word):
        for level, (low, high) in enumerate(((0, 5), (5, 7), (7, 9), (9, None))):
            yield level, (level, word[:low], len(word) < low), word[low:high]

    tokens = lambda t: [w for w in re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())]
    count = {c: Counter() for c in (0, 1)}
    for i, c in toxic.items():
        if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            for w in tokens(texts[i]):
                count[c].update((level, v, x) for level, v, x in chain(w))

    def discounts(values):
        seen = Counter(values)
        n = [max(1, seen[k]) for k in (1, 2, 3, 4)]
        return [0] + [min(k - 0.05, max(0.05, k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1])) for k in (1, 2, 3)]

    most = discounts([*count[0].values(), *count[1].values()])[3]
    low = Counter((level, x) for level, _, x in set(count[0]) | set(count[1]))
    d = discounts(low.values())
    total, kinds, spread = Counter(), Counter(), Counter()
    for (level, x), n in low.items():
        total[level] += n
        kinds[level] += 1
        spread[level] += d[min(n, 3)]
    off = lambda n: n if n <= 2 else most
    sums, rest = {c: Counter() for c in count}, {c: Counter() for c in count}
    for c in count:
        for (level, v, _), n in count[c].items():
            sums[c][v] += n
            rest[c][v] += off(n)

    def p(c, level, v, x):
        n = low[level, x]
        q = (n - d[min(n, 3)] + spread[level] / (kinds[level] + 1)) / total[level]
        m = count[c][level, v, x]
        return (m - off(m) + rest[c][v] * q) / sums[c][v] if sums[c][v] else q

    def difference(text):
        found = [math.prod(p(1, *g) / p(0, *g) for g in chain(w)) for w in tokens(text)]
        return sum(math.log1p(0.02 * (x - 1)) for x in found) / max(1, len(found))

    return {i: difference(t) for i, t in texts.items()}


def test_toxicity_by_brute_force(spark, sf_dir, texts):
    """Every document's difference of log-likelihoods; the score rises with it and calls half where predicted turns."""
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect() if r.toxic is not None and r.doc_id in texts}
    rows = queries.op7_toxicity(spark, sf_dir).collect()
    want = brute_toxicity(texts, labels)
    assert len(rows) == len(texts) and len({round(x, 9) for x in want.values()}) > 10
    for r in rows:
        assert r.difference == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)
    ordered = sorted(rows, key=lambda r: r.difference)
    assert all(a.score <= b.score for a, b in zip(ordered, ordered[1:], strict=False))


def test_toxicity_model_in_shards_is_the_same(spark, sf_dir, monkeypatch):
    """A model too large to be broadcast lies in many shards of the shared folder and gives the same differences."""
    sample = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"))
    texts = pa.array([r.text for r in sample.limit(60).collect()])
    whole = toxicity.differences(toxicity.train(sample), texts)
    monkeypatch.setattr(toxicity, "MAX_NODES", 300)
    model = toxicity.train(sample)
    assert model["nodes"].shards > 3
    assert toxicity.differences(model, texts) == pytest.approx(whole, rel=1e-12) and len(set(whole)) > 10


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").join(F.broadcast(labels.select("doc_id")), "doc_id")
    scored = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic, plain = [r for r in scored if r.toxic], [r for r in scored if not r.toxic]
    caught, wrong = sum(r.predicted for r in toxic) / len(toxic), sum(r.predicted for r in plain) / len(plain)
    assert caught > 0.9 and wrong < 0.01, (caught, wrong)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(odd, labels.limit(0)).where("score <> 0").count() == 0


# 8


def test_base_features(spark, sf_dir, docs, texts):
    for r in quality.measure(docs).collect():
        w = [x.decode() for x in words(texts[r.doc_id])]
        runs = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in texts[r.doc_id].split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in texts[r.doc_id]), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want


def test_good_labels_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.judge(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where("quality = 1 AND NOT base_failed")
    assert rows.where("NOT kept").count() == 0 and rows.count() > 100


def test_quality_of_odd_rows(odd):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD) and all(r.base_failed for r in rows)
    assert quality.keep_good(odd).columns == odd.columns and quality.judge(odd.limit(0)).count() == 0


# 9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_clashing_columns_and_many_equal_vectors(spark):
    """A third of all rows are one vector; columns have the operator's own names."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist(), "x", 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, signs string, score double")
    want = []
    for i, v, *_ in rows[::20]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w, *_ in rows if j != i)[:20]
        want += [(i, k, j, pytest.approx(-x)) for k, (x, j) in enumerate(best, 1)]
    assert sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect())) == want


def test_bounds_hold(spark):
    """Bytes bound every inner product for certain, signs nearly all."""
    rng = np.random.default_rng(4)
    for d in (3, 64, 100):
        x, q = rng.normal(size=(2000, d)) * rng.lognormal(size=(2000, 1)), rng.normal(size=d)
        turn = neighbours.rotation(d)
        codes, true = neighbours.encode(x, turn), x @ q
        value, off = neighbours.estimate(q @ turn, codes, np.ascontiguousarray(codes.signs.T), np.bitwise_count(codes.signs).sum(axis=1, dtype=np.int64))
        assert (np.abs(value - true) <= off).mean() >= 0.99
        middle = codes.scale * (codes.small @ (q @ turn))
        assert (np.abs(middle - true) <= codes.missed * np.linalg.norm(q)).all()


def test_blocks_change_nothing(spark, monkeypatch):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    whole = sorted(map(tuple, neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).collect()))
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 90)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).collect())) == whole


# 10


def test_language_model(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.op10_lm_scoring(spark, sf_dir).collect()}
    tokens = {i: [*words(t.encode().lower().decode()), "end"] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(), Counter()
    for i in train:
        one.update(tokens[i])
        two.update(zip(["start", *tokens[i]], tokens[i], strict=False))
    after, context = Counter(w for _, w in two), {}
    for (v, _), c in two.items():
        x = context.setdefault(v, [0, 0, 0, 0])
        x[0] += c
        x[min(c, 3)] += 1

    def discounts(counts):
        n = [max(1, sum(c == k for c in counts)) for k in (1, 2, 3, 4)]
        return [min(k - 0.05, max(0.05, k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1])) for k in (1, 2, 3)]

    d2, d1 = discounts(two.values()), discounts(after.values())
    cut = lambda c, d: d[min(c, 3) - 1] if c else 0
    spare = sum(cut(c, d1) for c in after.values()) / len(two)
    low = lambda w: (after[w] - cut(after[w], d1)) / len(two) + spare / (len(one) + 1)

    def high(v, w):
        if v not in context:
            return low(w)
        n, *kinds = context[v]
        c = two[v, w]
        return (c - cut(c, d2)) / n + sum(a * b for a, b in zip(d2, kinds, strict=True)) / n * low(w)

    total = sum(one.values())
    assert sum(high(b"the", w) for w in one) < 1
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in set(train), len(t), sum(one[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in t))
        assert r.score == pytest.approx(sum(math.log10(high(v, w)) for v, w in zip(["start", *t], t, strict=False)))


def test_language_model_of_odd_rows(odd):
    model = lm.train(odd)
    rows = lm.score(odd, model, keep=("doc_id",)).collect()
    assert len(rows) == len(ODD) and all(r.score <= 0 for r in rows) and lm.perplexity(lm.score(odd, model)).count() == len(ODD)
    again = lm.score(odd.withColumn("score", F.lit("clash")), model, keep=("doc_id", "score"))
    assert again.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and again.count() == len(ODD)
    nothing = lm.train(odd.limit(0))
    assert {r.score for r in lm.score(odd, nothing).collect()} == {0.0}


# pipeline


def test_stages_remove_what_earlier_ones_left(spark, sf_dir):
    """By the time a stage begins, its input has been written; the result of the last can be read until `close`."""
    import corpus_pipeline

    with staging.collecting(spark) as made:
        rows = corpus_pipeline.run(spark, sf_dir)
    there = lambda: [p for p in made if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    n, left = rows.count(), there()
    assert n and len(left) < len(made) / 2 and not any("/shingles-" in p for p in left)
    corpus_pipeline.close(spark)
    assert there() == []


def test_pipeline(spark, sf_dir, duck):
    """Each stage against plain Python or SQL over what the stage before it kept."""
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({queries.SQL['op8_quality_rules']}) WHERE kept").fetchall()}
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = staging.stage(step(spark, docs, sf_dir), name)
        rows = docs.collect()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and rows
        after = {r.doc_id: r for r in rows}
        if name == "quality_rules":
            assert set(after) == kept and all(after[i] == before[i] for i in after)
        elif name == "near_dedup":
            groups = brute_jaccard_groups({i: r.text or "" for i, r in before.items()})
            assert set(after) == set(groups.values()) and all(after[i] == before[i] for i in after)
        elif name == "secret_scan":
            spans = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
            for i, r in before.items():
                text, at, out = r.text or "", 0, ""
                for s in spans[i]:
                    if s["start"] >= at:
                        out += text[at : s["start"]] + "[SECRET]"
                    at = max(at, s["end"])
                assert (after[i].text or "", after[i].n_chars) == (out + text[at:], len(out + text[at:]))
        elif name == "source_mix":
            wanted = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
            assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in wanted.items() if n})
        else:
            model = pieces.pieces(pieces.MODEL)
            assert all(r.ids == model.library.encode(r.text or "") for r in rows)
