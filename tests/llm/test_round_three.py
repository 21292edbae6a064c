"""License scans, Merkle manifest and spelling variants against brute force, with NULLs,
empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wardlake.llm import licenses, merkle, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, key string, n long, level int, word string"


def odd_documents(spark):
    """Odd rows with columns whose names the operators use themselves."""
    long = "Under the MIT License " + " ".join(f"w{i % 997}" for i in range(30_000)) + " cc-by-nc 4.0"
    notice = licenses.TEMPLATES[2][1]
    rows = [(1, "a", "en", 3, None), (2, None, None, None, ""), (3, "a", "en", 0, " \n\t "), (4, "b", "de", 5, "Under the MIT license."),
            (4, "b", "de", 5, "Under the MIT license."), (4, "b", "de", 6, "cc by nc cc by nc"), (None, None, "fr", None, "Apache License, Version 2.0"),
            (None, "x", "fr", 2, "under THE mit LICENSE under the mit license"), (7, "é", "日本", 9, notice.replace("may not", "shall not").upper()), (8, "s", "", 1, long),
            (9, "s", "en", 2**62, " ".join(reversed(notice.split()))), (10, "s", "en", 4, "words " * 50 + notice + " words" * 50),
            (11, "s", "en", 4, "the license of the version you may use"), (14, "s", "en", 1, "Colour colour colours Été été ÉTÉS Weekendx weekendx"), (21, "s", None, 1, "Colour colour color colours colourss")]
    return spark.createDataFrame([(*r, "k", 5, 3, "w") for r in rows], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ------------------------------------------------------------------ licenses
def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_blocks(text, templates, least):
    """Every block of every template, compared as sets."""
    w, out = plain_words(text), []
    for label, t in templates:
        own = plain_words(t)
        for start in range(0, len(w), len(own) or 1):
            share = len(set(own) & set(w[start:start + 2 * len(own)])) / len(set(own)) if own else 0
            if own and share >= least:
                out.append((label, start, round(share, 9)))
    return out


def plain_scan(doc_id, text, templates=licenses.TEMPLATES, least=licenses.LEAST):
    w, base = plain_words(text), []
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        base += [(i, label) for i in range(len(w)) if w[i:i + len(own)] == own]
    found = plain_blocks(text, templates, least)
    names = {x for _, x in base}
    return (doc_id, len(w), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted(names)),
            ",".join(sorted(names | {x[0] for x in found})), 1.0 if base else max((x[2] for x in found), default=0.0))


def key_of(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


def test_license_scan_of_odd_rows_and_all_documents(spark):
    odd = odd_documents(spark)
    want = key_of(plain_scan(r.doc_id, r.text) for r in odd.collect())
    assert key_of(licenses.scan(odd).collect()) == want
    by = {r[0]: r for r in want if r[0] not in (None, 4)}
    assert by[7][6] == by[9][6] == by[10][6] == "apache-2" and by[10][2] == 1 and by[7][2] == 1 and by[9][2] == 0 and by[9][7] == 1.0 and by[11][6] == ""
    assert by[8][2:7] == (2, 0, 30_004, "cc-by-nc,mit", "cc-by-nc,mit")
    assert licenses.scan(odd.where("false")).collect() == []
    docs = documents(spark)
    got = licenses.op11_license_join(spark, SF)
    assert key_of(got.collect()) == key_of(plain_scan(r.doc_id, r.text) for r in docs.collect())
    assert got.where("n_base > 0").count()


@pytest.mark.parametrize("least", [0.34, 0.5, 0.8, 1.0])
def test_license_join_finds_every_block(spark, least):
    rnd = random.Random(3)
    names = [f"t{i}" for i in range(14)]
    templates = [(f"l{i % 4}", " ".join(rnd.choice(names) for _ in range(rnd.randint(1, 9)))) for i in range(8)] + [("none", "!!")]
    rows = [(i, " ".join(rnd.choice(names + ["x", "y", "z"] * (i % 9)) for _ in range(rnd.randint(0, 60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, *x) for i, t in rows for x in plain_blocks(t, templates, least))
    got = sorted((r.doc_id, r.label, r.first_word, round(r.containment, 9)) for r in licenses.matching_blocks(docs, templates=templates, least=least).collect())
    assert got == want and want


def test_license_order_is_of_the_whole_corpus_and_prefixes_are_short(spark):
    docs = odd_documents(spark)
    counts = licenses.token_counts(docs, licenses.TEMPLATES)
    texts = [set(plain_words(r.text)) for r in docs.collect()]
    assert counts == {w.encode(): sum(w in t for t in texts) for _, x in licenses.TEMPLATES for w in plain_words(x)}
    for t in licenses.ordered_templates(licenses.TEMPLATES, counts, 0.8):
        assert [counts[w] for w in t.order] == sorted(counts[w] for w in t.order)
        assert len(t.prefix()) == len(t.order) - t.need + 1 and (t.need - 1) / len(t.order) < 0.8 <= t.need / len(t.order)


# ------------------------------------------------------------------ manifest
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, more=0):
    out = ""
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = r[c]
        v = v + more if c == "n_chars" and v is not None else v
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    trees = {k: plain_tree([plain_leaf(r) for r in by[k]]) for k in langs}
    top, out = plain_tree([trees[k][-1][0] for k in langs]), []
    for a, k in enumerate(langs):
        for i, r in enumerate(by[k]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node, siblings = plain_leaf(r, int(hit)), ""
            for levels, at in ((trees[k], i), (top, a)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    siblings += other
                    node = sha(other + node) if at % 2 else sha(node + other)
                    at //= 2
            out.append((r["doc_id"], plain_leaf(r), trees[k][-1][0], top[-1][0], sha(siblings), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 3, 10])
def test_manifest_against_a_plain_tree(spark, height):
    odd = odd_documents(spark)
    assert sorted(map(tuple, merkle.manifest(odd, height).collect()), key=str) == plain_manifest([r.asDict() for r in odd.collect()])
    docs = documents(spark)
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("lang", F.lit("en")))
    rows = merkle.manifest(more, height).collect()
    assert sorted(map(tuple, rows), key=str) == plain_manifest([r.asDict() for r in more.collect()])
    assert 0 < sum(not r.verified for r in rows) < len(rows) / 4


def test_manifest_of_no_row_one_row_and_the_sql(spark):
    odd = odd_documents(spark)
    assert merkle.manifest(odd.where("false")).collect() == []
    one = odd.where("doc_id = 10")
    r = merkle.manifest(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = merkle.op12_jumped_manifest(spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(merkle.OP12_SQL).fetchall(), key=str)


# ------------------------------------------------------------------ spelling
def plain_vocabulary(rows, least=7):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 2}


def one_edit(word, signs):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + s + word[i:] for s in signs} | {word[:i] + word[i + 1:]} | {word[:i] + s + word[i + 1:] for s in signs if i < len(word)}
    return out - {word}


def plain_variants(n):
    signs, out = sorted(set("".join(n))), {}
    for w, k in n.items():
        near = [x for x in one_edit(w, signs) if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 10 * k else None
        out[w] = [w, form, None, k, len(near), n[form] if form else None]
    for r in out.values():
        end = r[0]
        while out[end][1]:
            end = out[end][1]
        r[2] = end
    return sorted(map(tuple, out.values()), key=str)


def test_scan_of_a_sorted_list_finds_every_entry_within_one_edit():
    rnd = random.Random(1)
    for size in (1, 2, 5, 40, 80):
        words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(size)})
        shared = [0, *(spelling.common_prefix(a, b) for a, b in zip(words, words[1:]))]
        for i, w in enumerate(words[:-1]):
            near = one_edit(w, "abé")
            assert spelling.scan(words, shared, i + 1) == [j for j in range(i + 1, len(words)) if words[j] in near]


@pytest.mark.parametrize("most", [1, 4, 100])
def test_variants_of_any_words_with_lists_split(spark, most):
    rnd = random.Random(2)
    n = {}
    while len(n) < 250:
        n["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 7)))] = rnd.choice([1, 2, 15, 200, 5000])
        n["prefix" * 3 + "".join(rnd.choice("abcdefgh") for _ in range(2))] = rnd.choice([1, 2, 15, 200, 5000])
    words = spark.createDataFrame([*n.items(), (None, 7), ("", 9)], "word string, n long")
    assert sorted(map(tuple, spelling.variants(words, most=most).collect()), key=str) == plain_variants(n)
    pairs = [(r.word, r.other) for r in spelling.near_pairs(words.where("length(word) > 0"), most).collect()]
    assert len(pairs) == len(set(pairs))
    assert spelling.variants(words.where("false")).collect() == []


def test_lists_stay_small(spark):
    words = spark.createDataFrame([("shared" + format(i, "06b").replace("0", "a").replace("1", "b") + "ending", 1) for i in range(64)], "word string, n long")
    held = spelling.lists(words, 8).groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("m") - F.col("head") - F.col("tail")).alias("free")).collect()
    assert all(r.k <= 8 or r.free == 1 for r in held)


def test_spelling_of_odd_rows_and_all_documents(spark):
    odd = odd_documents(spark).unionByName(odd_documents(spark))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = spelling.vocabulary(odd)
    assert {r.word: r.n for r in got.collect()} == plain_vocabulary(rows)
    assert sorted(map(tuple, spelling.variants(got).collect()), key=str) == plain_variants(plain_vocabulary(rows))
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    want = plain_variants(plain_vocabulary(docs))
    assert sorted(map(tuple, spelling.op13_sorted_spelling(spark, SF).collect()), key=str) == want
    assert any(r[1] for r in want)
