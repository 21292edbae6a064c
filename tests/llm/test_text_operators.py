"""Packing, near duplicates, decontamination, language-model scores, classifiers and records
against brute force, with NULLs, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from katz_model import Katz
from pyspark.sql import functions as F

from wardlake.llm import decontaminate, katz, neardup, packing, quality, records, shingles, tokens, toxicity
from wardlake.llm.common import saved, shared_folder

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, keys string"


def odd_documents(spark):
    """Odd rows with columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One two"), (6, "one two"), (None, "one two three four five six"),
            (7, "one two three four five six"), (7, "one two three four five six"), (8, "ONE two three four five six"), (9, long), (10, long + " tail"),
            (11, "naïve Ünïcode “quotes” ’s 日本語 text İ x" * 3), (12, "a\u0000b ﻿ c"), (13, "!!! ??? ..."), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 3, "k") for i, t in rows], DOCS)


def plain_ids(name, end):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path(name))
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_library_s(name):
    enc, whole = tokens.Encoder(P.path(name), keep=50), plain_ids(name, 0)
    rnd = random.Random(5)
    signs = "aé'ß ÀÉ \t\n\r.!?1²½—“”s t re ll ' 'S 'T xİ ́日<|endoftext|>"
    for _ in range(1500):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))
        assert np.frombuffer(enc.ids([t])[0], "<u4").tolist() == whole(t)[:-1]
    t = "before <|endoftext|> after"
    assert np.frombuffer(enc.ids([t])[0], "<u4").tolist() == whole(t)[:-1]


def test_pretokens_are_kept_from_the_second_meeting():
    enc = tokens.Encoder(P.path("word_bpe_49k.json"), keep=3)
    first = enc.ids(["alpha beta"])
    assert not enc.cache and not enc.cache.old and enc.cache.marks == 2
    assert enc.ids(["alpha beta", "gamma"])[0] == first[0] and set(enc.cache) == {"alpha", "beta"}
    long = "x" * (tokens.LONGEST_KEPT + 1)
    for t in (long, long, "gamma delta", "delta"):
        enc.ids([t])
    assert set(enc.cache.old) == {"alpha", "beta", "gamma", "delta"} and not enc.cache
    assert enc.ids(["beta alpha"])[0] == first[0][4 * 1:] + first[0][:4 * 1] and set(enc.cache) == {"alpha", "beta"}
    enc.cache.marks = tokens.MET
    enc.ids(["epsilon"])
    assert enc.cache.marks == 0 and not any(enc.cache.met)


# ------------------------------------------------------------------ packing
def check_packing(rows, docs, ids, capacity):
    want = sorted((d, p, at, len(x[at:at + capacity]), crc(x[at:at + capacity])) for d, t in docs for x in [ids(t)]
                  for p, at in enumerate(range(0, len(x), capacity)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_of_odd_rows(spark, capacity):
    df = odd_documents(spark)
    rows = packing.pack_documents(df, P.path("word_bpe_49k.json"), 1, capacity).collect()
    check_packing(rows, [(-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect()], plain_ids("word_bpe_49k.json", 1), capacity)


def test_packing_is_tight_and_empty_tables_pack_to_nothing(spark):
    rows = packing.op2_pattern_packing(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = check_packing(rows, docs, plain_ids("word_bpe_49k.json", 1), 4096)
    assert n <= math.ceil(sum(r.length for r in rows) / 4096) + 1
    assert packing.pack_documents(odd_documents(spark).where("false"), P.path("word_bpe_49k.json"), 1).collect() == []


def test_plan_holds_every_piece_in_few_sequences():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 3000, 100_000):
        lengths = np.clip(rng.lognormal(6.6, 1, n).astype(int), 1, 4096)
        counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)}
        runs, got = packing.plan(counts), {}
        for times, own in runs:
            assert times > 0 and sum(own) <= 4096
            for x in own:
                got[x] = got.get(x, 0) + times
        assert got == counts
        assert sum(t for t, _ in runs) <= 1.003 * math.ceil(lengths.sum() / 4096) + 2
    assert packing.plan({}) == []
    assert sum(t for t, _ in packing.plan({4096: 10**9, 1: 10**9})) == 10**9 + -(-10**9 // 4096)


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-6).all() and (np.abs(g[x > 1e-9]) < 1e-6).all()


# ------------------------------------------------------------------ records
def test_crc32c_known_values():
    def slow(m):
        c = 0xFFFFFFFF
        for b in m:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF
    rnd = random.Random(2)
    messages = [b"123456789", *(rnd.randbytes(n) for n in (0, 1, 3, 4, 5, 255, 256, 257, 1000, 5000))]
    got = [int(x) for x in records.crc32c(messages)]
    assert got[0] == 0xE3069283 and got == [slow(m) for m in messages]


def test_records_round_trip_and_shuffled_reads(spark):
    folder = shared_folder(spark, "test-records")
    df = odd_documents(spark)
    wrote = sorted(records.write_records(df, folder, P.path("byte_bpe_50k.json"), 0).collect())
    files = [(w.part, sum(x.ids for x in wrote if x.part < w.part)) for w in wrote]
    rows = sorted(records.read_records(spark, folder, files).collect(), key=lambda r: (r.part, r.record))
    ids = plain_ids("byte_bpe_50k.json", 0)
    want = sorted(((r.doc_id, ids(r.text)) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(d), len(x), crc(x)) for d, x in want)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    counts = [(w.part, w.records) for w in wrote]
    first = records.shuffled_reads(spark, folder, counts, 1).collect()
    assert sorted((str(r.doc_id), r.ids) for r in first) == sorted((str(d), x) for d, x in want)
    assert [r.doc_id for r in first] != [r.doc_id for r in records.shuffled_reads(spark, folder, counts, 2).collect()]


def test_texts_of_one_id_keep_one_order(spark):
    lines = [(d, f"text {d} {i}", "x") for d in (None, 3, 7) for i in range(60)] + [(5, "same", "x")] * 9
    runs = set()
    for parts in (1, 2, 7):
        folder = shared_folder(spark, "records")
        wrote = sorted(records.write_records(spark.createDataFrame(lines, "doc_id long, text string, part string").repartition(parts), folder, P.path("byte_bpe_50k.json"), 0).collect())
        before = [sum(r.ids for r in wrote[:i]) for i in range(len(wrote))]
        rows = records.read_records(spark, folder, [(r.part, b) for r, b in zip(wrote, before, strict=True)]).collect()
        runs.add(tuple(sorted((r.start, r.doc_id or 0, r.ids_crc32) for r in rows)))
    assert len(runs) == 1 and len(runs.pop()) == len(lines)


def test_damaged_record_is_refused():
    a, b = records.frames([records.payload(5, np.array([1, 2], "<u4").tobytes(), 2), records.payload(None, b"", 4)])
    assert [records.from_payload(x) for x in records.unframe(a + b, np.array([0, len(a)]))] == [(5, np.array([1, 2], "<u4").tobytes()), (None, b"")]
    for at in (0, 9, 14, len(a) - 1):
        bad = bytearray(a)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), np.array([0]))


def test_records_of_all_documents(spark):
    ids, start = plain_ids("byte_bpe_50k.json", 0), 0
    rows = sorted(records.op9_token_records(spark, SF).collect())
    for r, d in zip(rows, sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), strict=True):
        x = ids(d[1])
        assert tuple(r)[:4] == (d[0], start, len(x), crc(x))
        start += len(x)
    assert records.read_records(spark, "unused", []).collect() == []


# ------------------------------------------------------------------ near duplicates
def plain_set(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_components(rows, width, percent):
    """Component of each (position, doc_id, text) by all pairs of distinct sets; rows of one doc_id are one document."""
    root = {}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    sets = [(d, frozenset(plain_set(t, width))) for d, t in rows if d is not None]
    for d, _ in sets:
        root[d] = d
    sets = list(dict.fromkeys((d, s) for d, s in sets if s))
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {d: top(d) for d in root}


def check_components(got, rows, width, percent):
    want = plain_components(rows, width, percent)
    def key(x):
        return tuple((v is not None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=key) == sorted(
        ((d, len(plain_set(t, width)), None if d is None else want[d], d is None or want[d] == d) for d, t in rows), key=key)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_of_odd_rows(spark, width):
    df = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    check_components(neardup.near_duplicates(df, width).collect(), rows, width, 80)
    assert neardup.near_duplicates(df.where("false"), width).collect() == []


def test_near_duplicates_at_the_threshold_and_in_large_groups(spark, monkeypatch):
    """Sets of similarity just at and below 0.8, and one group whose members differ from each other in
    various degrees, so that its buckets hold pairs that no pivot settles; dealt into small chunks."""
    monkeypatch.setattr(neardup, "CHUNK", 8)
    rnd, rows, n = random.Random(4), [], 0
    for k in range(60):
        base = [f"b{k}x{i}" for i in range(43)]           # 40 shingles
        for cut in (0, 4, 5, 8, 12):                      # words changed at the end
            rows.append((n, " ".join(base[:43 - cut] + [f"c{n}y{i}" for i in range(cut)])))
            n += 1
    base = [f"g{i}" for i in range(123)]
    for _ in range(150):
        w = list(base)
        for at in rnd.sample(range(123), rnd.randint(0, 9)):
            w[at] = f"v{rnd.randint(0, 40)}"
        rows.append((n, " ".join(w)))
        n += 1
    rnd.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check_components(got, rows, 4, 80)


def test_every_text_of_a_repeated_doc_id_is_compared(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    texts = spark.createDataFrame([(1, a), (1, b), (2, a + " end"), (3, b + " end")], "node long, text string").coalesce(1)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long").coalesce(1)
    assert {tuple(r) for r in neardup.verified(pairs, texts, 5, 80).collect()} == {(1, 2), (1, 3)}
    rows = [(2, a), (2, b), (3, b + " end"), (4, a + " end")]
    group = pd.DataFrame([(k, k, 0, 1, 0, 0, t) for k, t in rows], columns=["node", "component", "chunk", "pivot", "i", "j", "text"])
    assert {tuple(sorted(x)) for x in neardup.open_links(group, 5, 80).itertuples(index=False)} == {(2, 3), (2, 4)}


def test_near_duplicates_of_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_components(neardup.op3_fast_sketch_dedup(spark, SF).collect(), rows, 4, 80)


def test_word_hashes_tell_words_apart(monkeypatch):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("aAbB é\t\n\x0b\x0c\r\x1c\x85.") for _ in range(rnd.randint(0, 60))) for _ in range(400)] + ["x" * 50, "", None, "y" * 20 + " z"]
    plain = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    for segment in (16, 1 << 18):
        monkeypatch.setattr(shingles, "SEGMENT", segment)
        monkeypatch.setattr(shingles, "worker_state", lambda name, make: make())
        h, n = shingles.hash_words(texts)
        assert n.tolist() == [len(w) for w in plain] and len(h) == sum(n)
        names = {}
        for x, w in zip(h.tolist(), (w for own in plain for w in own), strict=True):
            if len(w.encode()) <= 16:
                assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)
    assert [len(x) for x in shingles.hash_words([])] == [0, 0]


def test_sketches_fill_every_coordinate_and_agree_as_jaccard():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**63, 400, dtype=np.uint64)
    t = 2000
    for common in (0, 100, 200, 300):
        a, b = one[:300], one[300 - common:300 - common + 300][:300] if common else rng.integers(0, 2**63, 300, dtype=np.uint64)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x = shingles.sketch([np.unique(a), np.unique(b), a[:1]], t)
        assert (x != np.uint64(2**64 - 1)).all()
        assert abs((x[0] == x[1]).mean() - j) < 0.06


# ------------------------------------------------------------------ decontamination
def plain_hits(docs, items, window):
    pick = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pick.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for k, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add("null" if k is None else str(k))
    out = []
    for d, t in docs:
        w = cut(t)
        mask, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    found |= windows[tuple(w[i:i + n])]
                    mask[i:i + n] = [1] * n
        out.append((d, len(w), sum(mask), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(mask) > 0))
    return out


def test_automaton_against_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        signs, window = ["a", "b", "c", "é"][:rnd.randint(1, 4)], rnd.randint(1, 4)
        items = [(k, " ".join(rnd.choice(signs) for _ in range(rnd.randint(0, 7)))) for k in range(rnd.randint(0, 5))]
        docs = [(k, " ".join(rnd.choice([*signs, "Z", "x"]) for _ in range(rnd.randint(0, 25)))) for k in range(6)]
        a = decontaminate.Automaton([(str(k), decontaminate.words(t)) for k, t in items], window)
        got = []
        for (k, _), (n, mask, found) in zip(docs, decontaminate.scan([t for _, t in docs], a), strict=True):
            names = sorted(a.names[x] for x in found)
            got.append((k, n, int(mask.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(mask.any())))
        assert got == plain_hits(docs, items, window)


def key_of(rows):
    return sorted(map(tuple, rows), key=str)


def test_contamination_of_odd_rows_in_blocks_of_items(spark):
    items = [(1, "two THREE four-five six"), (2, None), (3, ""), (4, "one"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (5, "one"), (6, "日本語 text")]
    df, bench = odd_documents(spark), spark.createDataFrame(items, "item_id long, text string")
    want = key_of(plain_hits([(r.doc_id, r.text) for r in df.collect()], items, 10))
    assert key_of(decontaminate.contamination(df, bench).collect()) == want
    assert decontaminate.built(bench, 10, 2)[1] >= 10
    for block_words in (2, 7):                    # many blocks, read from the folder in turn
        assert key_of(decontaminate.contamination(df, bench, block_words=block_words).collect()) == want
    assert not any(r.contaminated for r in decontaminate.contamination(df, bench.where("false")).collect())
    assert decontaminate.contamination(df.where("false"), bench).collect() == []


def test_contamination_of_all_documents_and_cleaning(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 10)
    assert key_of(decontaminate.op4_automaton_decontamination(spark, SF).collect()) == key_of(want)
    hit = {r[0]: r[2] / r[1] for r in want if r[5]}
    assert hit
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in decontaminate.clean(docs, bench).collect()}
    assert set(before) - set(after) == {d for d, x in hit.items() if x >= 0.5}
    for d, r in after.items():
        assert (r.text == before[d]) == (d not in hit) and (d not in hit or r.n_chars == len(r.text))
    a = decontaminate.Automaton([("x", [b"b", b"c"])], 2)
    text = "Aé, B-c. d; b C!"
    _, mask, _ = decontaminate.scan([text], a)[0]
    assert decontaminate.without_hits(text, mask) == "Aé, . d; !"


# ------------------------------------------------------------------ language model
def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_scores_against_a_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 9000)   # several chunks a task
    monkeypatch.setattr(katz, "BLOCK_ROWS", 7)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd_documents(spark).where("doc_id < 9 or doc_id > 10").select(F.col("doc_id") + 100_000, "text"))
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(False))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = Katz([t for d, t in rows if d is not None and fold(d, 10)], order)
    got = katz.score(saved(docs, "test").withColumn("learn", learn).withColumn("held", ~learn), order).collect()
    want = sorted((str(d), round(model.score(t), 6), round(model.base(t), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), round(r.score, 6), round(r.base_score, 6)) for r in got) == want
    assert {(r.train_tokens) for r in got} == {model.n}


def test_katz_probabilities_sum_to_one():
    model = Katz(["a b a b a c", "a b b", "c c c c c c c c", "d"], 2)
    known = [w for (w,) in model.c[1]]
    for h in [*known, "never", ("start",)]:
        assert abs(sum(model.p(2, (h,), w) for w in [*known, "unknown"]) - 1) < 1e-12


def test_katz_query_and_nothing_to_learn_from(spark):
    rows = katz.op5_katz_scores(spark, SF).collect()
    assert all(r.held_out == (fold(r.doc_id, 10) == 0) for r in rows)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    df = odd_documents(spark).withColumn("learn", F.lit(False)).withColumn("held", F.lit(True))
    assert {(r.score, r.n_known, r.train_tokens) for r in katz.score(saved(df.select("doc_id", "text", "learn", "held"), "test")).collect()} == {(0.0, 0, 0)}
    assert katz.score(saved(df.where("false"), "test")).collect() == []


# ------------------------------------------------------------------ classifiers
def rated(spark, n=600):
    rnd = random.Random(7)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do", "tempor", "magna"]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(plain) + rnd.choice(["", "a", "um"]) for _ in range(rnd.randint(5, 60))]
        bad, poor = i % 7 == 0, i % 5 == 0
        if bad:
            w.insert(rnd.randrange(len(w)), "Grumbl" + rnd.choice(["ing", "er", "y"]))
        if poor:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(not poor), int(bad)))
    labels += [(None, 1, 1), (3, None, None), (10**9, 0, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows)


def test_toxicity_learns_character_stems(spark):
    docs, labels, rows = rated(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, ("doc_id",)).collect()}
    unseen = [i for i, _ in rows if i % 2 == 0 or fold(i, 5) == 0]
    assert sum(got[i].predicted == (i % 7 == 0) for i in unseen) >= 0.97 * len(unseen)
    odd = toxicity.score(odd_documents(spark), model, ("doc_id", "lang", "text")).collect()
    assert len(odd) == 16 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    kept = toxicity.without_toxic(odd_documents(spark), model)
    assert kept.columns == odd_documents(spark).columns and kept.count() == sum(r.predicted == 0 for r in odd)
    none = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {toxicity.LinearModel(np.zeros(toxicity.BUCKETS), -500.0).scores([""])[0]}
    assert toxicity.score(docs.where("false"), model, ("doc_id",)).collect() == []


def test_toxicity_weighs_20000_grams_and_fits_as_whole_rows(spark):
    words = ["".join(chr(97 + (i * k + 7 * j) % 26) for j, k in enumerate((1, 3, 5, 7, 11, 17))) + format(i, "04x") for i in range(9_000)]
    rows = [(i, " ".join(words[(i % 300) * 30:(i % 300) * 30 + 30])) for i in range(900)]
    labels = spark.createDataFrame([(i, i % 300 % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, folds=None)
    assert np.count_nonzero(model.weight) == 20_000 and toxicity.ROUNDS == 400
    size, cols, y = np.array([2, 0, 1, 3, 0]), np.array([0, 2, 1, 0, 1, 2], "<u2"), np.array([1.0, 0, 0, 1, 0])
    whole = toxicity.fit_logistic([(size, cols)], np.array([1.0, -0.5, 2.0]), y, 3)
    cut = toxicity.fit_logistic([(size[:2], cols[:2]), (size[2:], cols[2:])], np.array([1.0, -0.5, 2.0]), y, 3)
    assert np.allclose(whole[0], cut[0]) and abs(whole[1] - cut[1]) < 1e-9


def test_toxicity_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(fold(r.doc_id, 5) == 0 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


def test_ordinal_fit_finds_order_and_thresholds():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 6)).astype(float)
    s = x @ np.array([2.0, -2.0, 1.0, 0.0, 0.0, 0.5])
    cuts = np.array([-1.0, 0.5, 2.0])
    y = (rng.random((4000, 1)) < quality.tails(s, cuts)).astype(int)
    u = rng.random(4000)
    y = (u[:, None] < quality.tails(s, cuts)).sum(axis=1)
    rows, cols = np.nonzero(x)
    w, got = quality.fit_ordinal(rows, cols, np.ones(len(rows)), y, 4, 6)
    assert (np.diff(got) > 0).all() and abs((w[0] - w[1]) - 4) < 0.6 and np.abs(np.diff(got) - np.diff(cuts)).max() < 0.3
    assert abs(quality.tails(x @ w, got).sum(axis=1).mean() - y.mean()) < 0.02


def test_quality_grades_and_selection(spark):
    docs, labels, rows = rated(spark)
    weight, cuts = quality.fit(docs, quality.ratings(labels), 3)
    got = {r.doc_id: r for r in quality.grade(docs, weight, cuts, ("doc_id",)).collect()}
    unseen = [i for i, _ in rows if i % 2 == 0 or fold(i, 5) == 0]
    assert sum(got[i].selected == (i % 5 != 0) for i in unseen) >= 0.97 * len(unseen)
    for r in got.values():
        assert r.tails[0] >= r.tails[1] and abs(sum(r.tails) - r.expected_grade) < 1e-9 and r.selected == (r.tail >= 0.5)
    odd = quality.selected(odd_documents(spark), weight, cuts)
    assert odd.columns == odd_documents(spark).columns
    assert odd.count() == quality.grade(odd_documents(spark), weight, cuts, ("doc_id",)).where("selected").count()
    for only in (0, 1, 2):
        w, c = quality.fit(docs, spark.createDataFrame([(1, only), (2, only)], "doc_id long, grade int"), 3, folds=None)
        assert {round(r.expected_grade, 6) for r in quality.grade(docs, w, c).collect()} == {float(only)}
    assert quality.grade(docs.where("false"), weight, cuts, ("doc_id",)).collect() == []


def test_quality_reads_rare_grams_and_shapes_of_four_signs(spark):
    """9,000 words, each in three texts of one grade, so that far more than 4,000 n-grams are needed; shapes by their number of signs."""
    words = ["".join(chr(97 + (i * k + 7 * j) % 26) for j, k in enumerate((1, 3, 5, 7, 11, 17))) + format(i, "04x") for i in range(9_000)]
    rows = [(i, " ".join(words[(i % 300) * 30:(i % 300) * 30 + 30])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 300 % 2) for i, _ in rows], "doc_id long, grade int")
    weight, _ = quality.fit(docs, ratings, 2, folds=None)
    assert np.count_nonzero(weight[:quality.BUCKETS]) == 20_000
    assert len(list(quality.shapes(["a.b,c"]))) == 4
    assert (quality.FEATURES, quality.SAMPLE, quality.ROUNDS) == (20_000, 20_000, 300)


def test_quality_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op1_ordinal_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic = 0").collect()
    assert sum(r.selected == (r.quality == 1) for r in rows) >= 0.9 * len(rows)
    assert all(r.selected for r in rows if r.quality == 1)


def test_sample_is_bounded_with_repeated_doc_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "x"), (3, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    for most in (1, 7, 150):
        assert 0 < toxicity.labelled_sample(docs, labels, "toxic", most, None).count() <= most
    assert toxicity.labelled_sample(docs, labels, "toxic", 1000, None).count() == 303
    many = spark.range(5000).withColumnRenamed("id", "labelled_id")
    assert toxicity.drawn(many, "labelled_id", ["labelled_id"], 700).count() == 700


def test_pretoken_cache_stays_small_within_one_text():
    """A text with more distinct words than the cache may keep leaves at most two generations of them, and the library's ids."""
    enc = tokens.Encoder(P.path("byte_bpe_50k.json"), keep=50)
    text = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} über-{i}\t" for i in range(500)) * 3
    assert enc.simple(text)
    assert enc.ids([text]) == [enc.whole(text)]
    assert len(enc.cache) <= 50 and len(enc.cache.old) <= 51
