"""Web archive bundles, nearest neighbours, preference pairs and the pipeline."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tools.compare import canon
from wardlake.llm import ann, preferences, warc
from wardlake.llm.common import saved, shared_folder, table
from wardlake.llm.components import components
from wardlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, res = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, res.fetchall())


# ------------------------------------------------------------------ web archives
PAGES = [(1, "u", "é x"), (2, None, "é x"), (3, "u\r\n", None), (None, "z", "é x"), (4, "a", ""), (5, "b", "y" * 3_000_000), (5, "b", "q"), (6, "c", "q"),
         (6, "c", "q"), (None, "n", "alone"), (7, "w", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]


def pages(spark):
    return spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, n int, sha string")


@pytest.mark.parametrize("least", [0, 2])
def test_warc_round_trip(spark, least):
    folder = shared_folder(spark, "test-warc")
    index = warc.write(pages(spark), folder, least)
    got = warc.read(spark, folder, [r.bundle for r in index.select("bundle").distinct().collect()]).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        raw, f = (h or "").encode(), first.get(h or "")
        again = len(raw) >= least and f is not None and (i is None or i > f)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    assert sorted((r.bundle, r.frame, r.place) for r in got) == sorted((r.bundle, r.frame, r.place) for r in index.collect())
    one = {(r.page_id, bytes(r.payload)) for r in warc.fetch(index.where("page_id in (5, 7)"), folder).collect()}
    assert one == {(i, h.encode()) for i, _, h in PAGES if i in (5, 7)}


def test_warc_frames_stand_alone_and_one_stream(tmp_path):
    import zstandard
    with open(tmp_path / "b", "wb") as f:
        b = warc.Bundle(f)
        records = [warc.record(i, "u", bytes([65 + i]) * 400_000, b"D" * 32, None, False) for i in range(7)]
        places = [b.add(r) for r in records]
        b.end()
    data = (tmp_path / "b").read_bytes()
    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    assert reader.read(10**8) == b"".join(records)
    assert len({k for k, _ in places}) > 1
    import pyarrow as pa
    with pa.OSFile(str(tmp_path / "b")) as f:
        table_ = warc.seek_table(f)
        for (k, at), r in zip(places, records, strict=True):
            assert warc.frame(f, table_[k])[at:at + len(r)] == r


def test_warc_of_no_pages(spark):
    folder = shared_folder(spark, "test-warc")
    assert warc.write(pages(spark).where("false"), folder).collect() == []
    assert warc.read(spark, folder, []).collect() == []


# ------------------------------------------------------------------ nearest neighbours
def brute(rows, step, k):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and len(e) == 16 and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v.setdefault(i, []).append(np.array(e, np.float32).astype(float))
    flat = [(i, x) for i, own in v.items() for x in own]
    out = {}
    for i, x in flat:
        if i % step == 0:
            near = sorted((-float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), j) for j, y in flat if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def vectors(spark):
    rng, centres = np.random.default_rng(5), np.random.default_rng(6).normal(size=(12, 16))
    rows = [(i, (centres[i % 12] * 3 + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(900 + i, rows[50][1]) for i in range(40)]           # many copies: ties by id
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] * 8), (2200, [1.0]), (None, rows[3][1]), (2250, [float("inf")] + [0.0] * 15),
             (2300, [1e-30] * 16), (2350, [1e30] * 16), (2400, [])]
    return spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, i int, chunk int"), rows


@pytest.mark.parametrize("chunk", [64, 4096])
def test_search_finds_the_nearest(spark, monkeypatch, chunk):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    monkeypatch.setattr(ann, "BLOCK", 7)
    df, rows = vectors(spark)
    want, got = brute(rows, 50, 5), {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(j in {a for a, _ in want[q]} for q, own in got.items() for j, _ in own)
    assert hits >= 0.9 * 5 * len(want)
    for q, own in got.items():
        assert all(abs(s - dict(want[q]).get(j, s)) < 1e-12 for j, s in own) and own == sorted(own, key=lambda x: (-x[1], x[0]))
    assert [j for j, _ in got[50]] == [j for j, _ in want[50]]     # exact copies, smallest ids first


def test_search_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.search(few.where("false")).collect() == []
    extremes = [(3, [1e-200, 0.0]), (4, [1e300, 1e300]), (100, [5e-324, 0.0])]
    tiny = spark.createDataFrame([*[(r.vec_id, list(r.embedding)) for r in few.collect()], *extremes], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(tiny).collect()}
    assert len(got) == 15 and abs(got[0, 3] - 1) < 1e-12 and abs(got[100, 4] - 0.5 ** 0.5) < 1e-12 and abs(got[50, 100]) < 1e-12


def test_recall_on_the_embeddings_table(spark):
    rows = ann.op7_multi_index_search(spark, "/root/testdata/sf0.01").collect()
    e = sorted((r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect())
    v = np.array([x for _, x in e], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = np.array([i for i, _ in e])
    q = np.flatnonzero(ids % 50 == 0)
    s = v[q] @ v.T
    s[np.arange(len(q)), q] = -9
    true = {(ids[a], ids[b]) for a, own in zip(q, np.argsort(-s, axis=1, kind="stable")[:, :5], strict=True) for b in own}
    assert len(true & {(r.query_id, r.vec_id) for r in rows}) >= 0.9 * len(true)


def test_walk_goes_by_rising_sum():
    rng = np.random.default_rng(2)
    a, b, counts = rng.random(9), rng.random(7), rng.integers(0, 3, 63)
    order = [c for c in np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable").tolist() if counts[c]]
    assert ann.walk(a, b, counts, 10**9) == order
    part = ann.walk(a, b, counts, 20)
    assert part == order[:len(part)] and counts[part].sum() >= 20 > counts[part[:-1]].sum()


# ------------------------------------------------------------------ preference pairs
def test_preferences_share_one_prompt(spark):
    schema = "pair_id long, turn long, role string, text string, first long, c int"
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "same"), (1, 2, "user", "more <|im_end|>"), (1, 3, "assistant", "good"), (1, 3, "assistant", "good"),
              (2, 0, "user", "only"), (None, 0, "user", "lost"), (3, None, None, None), (3, 1, "assistant", "x"), (4, 0, "user", "eq"), (5, 0, "assistant", "a"), (5, 1, "user", "b")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "same"), (1, 2, "user", "more <|im_end|>"), (1, 3, "assistant", "bad"), (1, 4, "user", "so"),
                (3, None, None, None), (3, 1, "assistant", "y"), (4, 0, "user", "eq"), (5, 0, "assistant", "a2"), (5, 1, "user", "b")]
    got = preferences.preferences(*(spark.createDataFrame([(*r, 7, 9) for r in x], schema) for x in (chosen, rejected)))
    assert got.columns == ["pair_id", "part", "turn", "role", "rendered", "mask_start", "mask_end"]
    parts = {}
    for r in sorted(got.collect(), key=lambda r: (r.pair_id, r.part, r.turn, r.role, r.rendered)):
        parts.setdefault((r.pair_id, r.part), []).append(r)
    assert [r.turn for r in parts[1, "prompt"]] == [0, 1, 2] and [r.turn for r in parts[1, "chosen"]] == [3] and [r.turn for r in parts[1, "rejected"]] == [3, 4]
    assert parts[1, "prompt"][2].rendered == "<|im_start|>user\nmore < |im_end|><|im_end|>\n"
    good = parts[1, "chosen"][0]
    assert good.rendered[good.mask_start:good.mask_end] == "good<|im_end|>" and parts[1, "rejected"][1].mask_end == 0
    assert all(r.mask_start == r.mask_end == 0 for (_, part), own in parts.items() if part == "prompt" for r in own)
    assert set(k for k in parts if k[0] == 2) == {(2, "unpaired")} and parts[2, "unpaired"][0].mask_end == 0
    assert [r.role for r in parts[3, "prompt"]] == ["unknown"] and parts[3, "chosen"][0].rendered != parts[3, "rejected"][0].rendered
    assert set(k for k in parts if k[0] == 4) == {(4, "prompt")}
    assert len(parts[5, "chosen"]) == len(parts[5, "rejected"]) == 2 and (5, "prompt") not in parts
    empty = spark.createDataFrame([], schema)
    assert preferences.preferences(empty, empty).collect() == []


def test_every_turn_is_in_a_pair_and_prompts_have_several_lengths(spark):
    """Whole conversations against a plain-Python prefix search over the same pairs."""
    rnd = random.Random(4)
    talks = {c: [(t, rnd.choice(["user", "assistant", "assistant", None]), rnd.choice(["a", "b", "", None])) for t in range(rnd.randrange(1, 9))]
             for c in [*range(-6, 40), 51]}
    talks[3] = [(None, "user", "x"), (0, "user", "no answer")]
    talks[8] = talks[9] = [(0, "user", "q"), (1, "assistant", "equal")]
    lines = [(c, *t, "zz", 1) for c, own in talks.items() for t in own] + [(5, *talks[5][0], "again", 2), (None, 0, "user", "lost", "zz", 1)]
    rnd.shuffle(lines)
    got = preferences.from_sides(preferences.neighbour_endings(spark.createDataFrame(
        lines, "conv_id long, turn long, role string, text string, leave_0 string, c int"))).collect()

    def plain(own):
        return [(preferences.FIRST if t is None else t, r or "unknown", x or "") for t, r, x in own]

    want, lengths = [], set()
    for c, own in talks.items():
        own, other = plain(own), plain(talks.get(c ^ 1, []))
        if not other:
            want += [(c, "unpaired", *t) for t in own]
            continue
        leave = max([t for t, r, _ in own if r == "assistant"], default=own[0][0])
        rejected = [t for t in own if t[0] < leave] + [t for t in other if t[0] >= leave]
        n = 0
        while n < min(len(own), len(rejected)) and own[n] == rejected[n]:
            n += 1
        lengths.add(n)
        want += [(c, "prompt", *t) for t in own[:n]] + [(c, "chosen", *t) for t in own[n:]] + [(c, "rejected", *t) for t in rejected[n:]]
    render = [(c, part, t, r, f"<|im_start|>{r}\n{x}<|im_end|>\n") for c, part, t, r, x in want]
    assert sorted(tuple(r)[:5] for r in got) == sorted(render) and len(lengths) > 4 and 0 in lengths
    for r in got:
        trained = r.role == "assistant" and r.part in ("chosen", "rejected")
        assert r.rendered[r.mask_start:r.mask_end] == (r.rendered[len("<|im_start|>assistant\n"):-1] if trained else "")


def test_all_turns_of_the_table_are_accounted_for(spark):
    rows = preferences.op8_preference_pairs(spark, "/root/testdata/sf0.01")
    mine = rows.where("part <> 'rejected'").select("pair_id", "turn", "role")
    turns = table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role").distinct()
    assert turns.exceptAll(mine.distinct()).isEmpty() and mine.count() == turns.count()
    assert rows.where("part = 'prompt'").groupBy("pair_id").count().select("count").distinct().count() >= 3


def test_preference_plan_is_native(spark):
    plan = preferences.op8_preference_pairs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ------------------------------------------------------------------ components, pipeline
def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    names = rnd.sample(range(10_000), 400)
    edges = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[i]) for i in range(101, 200)] + [(names[i], names[i + 1]) for i in range(200, 400, 2)]
    edges += [(5, 5)] + edges[:10]
    rnd.shuffle(edges)
    want = {x: min(names[:100]) for x in names[:100]} | {x: min(names[100:200]) for x in names[100:200]}
    for i in range(200, 400, 2):
        want[names[i]] = want[names[i + 1]] = min(names[i], names[i + 1])
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stages_one_by_one(spark):
    """Each stage against its operator's own report on the same input."""
    from wardlake.llm import decontaminate, neardup, quality, toxicity
    docs = table(spark, SF, "documents")
    labels, ids = table(spark, SF, "labels"), lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    one = saved(stages["toxicity"](spark, docs, SF), "t")
    assert ids(one) == ids(toxicity.score(docs, toxicity.fit(docs, labels), ("doc_id",)).where("predicted = 0"))
    two = saved(stages["quality"](spark, one, SF), "t")
    assert ids(two) == ids(quality.grade(one, *quality.fit(one, quality.ratings(labels), 3), ("doc_id",)).where("selected"))
    three = saved(stages["near duplicates"](spark, two, SF), "t")
    assert ids(three) == ids(neardup.near_duplicates(two).where("kept"))
    four = saved(stages["decontamination"](spark, three, SF), "t")
    report = decontaminate.contamination(three, table(spark, SF, "benchmark"))
    assert ids(four) == ids(report.where("2 * n_hit < n_words or n_hit = 0"))
    assert not decontaminate.contamination(four, table(spark, SF, "benchmark")).where("contaminated").count()
    for df in (one, two, three, four):
        assert df.columns == docs.columns
    rows = stages["packing"](spark, four, SF).collect()
    assert {r.doc_id for r in rows} == set(ids(four))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == [], name
