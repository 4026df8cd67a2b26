"""Near duplicates, decontamination, licenses and top-k against brute force."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from areascreen.llm import near_dup, queries
from areascreen.llm.components import components
from areascreen.llm.decontaminate import PART, Index, _words, find_leaks
from areascreen.llm.licenses import TEMPLATES, scan_licenses
from areascreen.llm.near_dup import near_duplicates
from areascreen.llm.topk import top_k, usable


def shingles(text: str | None, words: int) -> set:
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(found[k : k + words]) for k in range(len(found) - words + 1)} or ({tuple(found)} if found else set())


def brute_components(texts: dict[int, str | None], words: int, num: int, den: int) -> dict[int, int]:
    sets, parent = {i: shingles(t, words) for i, t in texts.items()}, {i: i for i in texts}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    want = brute_components(texts, 3, 85, 100)
    for row in queries.op7_minhash_near_dedup(spark, small).collect():
        assert (row.component_id, row.kept) == (want[row.doc_id], want[row.doc_id] == row.doc_id)
        assert row.n_shingles == len(shingles(texts[row.doc_id], 3))


def test_near_duplicates_in_a_chain_of_edits_lose_no_link(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(160):  # each differs from an earlier one in a few words, so most pairs lie near the threshold
        words = list(texts[int(rng.integers(0, i))].split()) if i else list(base)
        for place in rng.integers(0, 120, rng.integers(0, 4)):
            words[place] = f"e{rng.integers(0, 10**6)}"
        texts[i] = " ".join(words)
    want = brute_components(texts, 3, 85, 100)
    old = near_dup.X_CELLS, near_dup.Y_CELLS
    near_dup.X_CELLS, near_dup.Y_CELLS = 1500, 2500  # many blocks
    try:
        got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85, 100).collect()
    finally:
        near_dup.X_CELLS, near_dup.Y_CELLS = old
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_duplicates(odd, 3, 85, 100).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[6].component_id == by_id[7].component_id == by_id[8].component_id == 6
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0 and by_id[4].n_shingles == by_id[5].n_shingles == 1
    assert by_id[1].kept and by_id[2].kept and not by_id[7].kept
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(edges).agg(F.min("label"), F.max("label"), F.count("*")).first()[:] == (0, 0, 301)


def test_leaks_are_the_documents_that_hold_an_item(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    squeeze = lambda t: " ".join((t or "").split())
    want = {(d.doc_id, i.item_id) for d in docs for i in items if squeeze(i.text) in squeeze(d.text)}
    assert {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, small).collect()} == want and want


def test_block_max_wand_retrieves_what_scoring_all_parts_retrieves():
    rng = np.random.Generator(np.random.PCG64(7))
    words = [np.array([rng.zipf(1.4) % 300 for _ in range(30)], np.uint64) for _ in range(90)]
    terms, counts = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    index = Index.build(np.arange(90), words, dict(zip(terms.view(np.int64).tolist(), counts.tolist())), 90, 30.0)
    for threshold in (0.1, 0.3, 0.6):
        for _ in range(20):
            passage = np.unique(np.searchsorted(index.terms, rng.choice(index.terms, 40)))
            scores = np.zeros(90)
            for t in passage:
                scores[index.parts[t]] += index.weights[t]
            assert dict(index.search(passage, threshold)).keys() == set(np.flatnonzero(scores >= threshold).tolist())


def test_leaks_of_odd_rows_and_long_items(spark, odd, none, monkeypatch):
    item = " ".join(f"w{k}" for k in range(500, 500 + 3 * PART))  # stands in document 11; longer than a part
    items = spark.createDataFrame([(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "word"), (5, "not to be found anywhere here")], "item_id long, text string")
    rows = find_leaks(odd, items).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, x.item_id) for r in rows for x in r.leaks} == {(11, 3), (4, 4)}
    monkeypatch.setattr("areascreen.llm.decontaminate.INDEX_POSTINGS", 50)  # several indexes
    assert {(r.doc_id, x.item_id) for r in find_leaks(odd, items).collect() for x in r.leaks} == {(11, 3), (4, 4)}
    assert find_leaks(none, items).count() == 0
    assert find_leaks(odd, items.limit(0)).filter("size(leaks) > 0").count() == 0


def test_question_without_answer_is_no_leak(spark):
    words = [f"q{k}" for k in range(30)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20]) + " other words stand here now"), (3, "clean words " * 50)], "doc_id long, text string")
    assert [r.doc_id for r in find_leaks(docs, items).filter("size(leaks) > 0").collect()] == [1]


def test_items_with_one_or_two_edited_words_are_leaks(spark):
    rng = np.random.Generator(np.random.PCG64(11))
    items, docs = [], []
    for size in (12, 15, 20, 28, 29, 36, 45):
        words = [f"w{size}x{k}" for k in range(size)]
        items.append((size, " ".join(words)))
        cut = -(-2 * size // 3)
        for n, places in enumerate([(cut + (size - cut) // 2,), (size - 2,), (cut, size - 1), (cut // 2, cut + 1), (cut + 1, size - 2)]):
            edited = [f"e{rng.integers(10**6)}" if k in places else w for k, w in enumerate(words)]
            docs.append((100 * size + n, "clean words stand here " * int(rng.integers(1, 40)) + " ".join(edited) + " and more follows " * 30))
        docs.append((100 * size + 50, " ".join(words[:cut]) + " and more follows here with other words for an answer " * 9))
    rows = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    wrong = [(r.doc_id, [x.item_id for x in r.leaks]) for r in rows if [x.item_id for x in r.leaks] != ([] if r.doc_id % 100 == 50 else [r.doc_id // 100])]
    assert not wrong


def test_licenses_equal_exact_containment(spark, small, odd, none):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()

    def runs(text):
        hashes, _ = _words(pa.array([text]))
        return hashes.tolist()

    want = set()
    for doc in docs:
        own = runs(doc.text)
        for name, template in TEMPLATES.items():
            sought = runs(template)
            if any(own[k : k + len(sought)] == sought for k in range(len(own) - len(sought) + 1)):
                want.add((doc.doc_id, name))
    got = queries.op3_license_scan(spark, small).collect()
    assert {(r.doc_id, r.template) for r in got if r.containment == 1} == want and want
    assert scan_licenses(odd).filter("size(licenses) > 0").count() == 0 and scan_licenses(odd).count() == odd.count()
    assert scan_licenses(none).count() == 0 and scan_licenses(odd, {}).count() == odd.count()
    short = spark.createDataFrame([(1, "MIT License."), (2, "Released under the MIT License")], "doc_id long, text string")
    assert [[x.template for x in r.licenses] for r in scan_licenses(short).orderBy("doc_id").collect()] == [[], ["MIT"]]


def test_licenses_by_notice_body_and_every_place(spark):
    texts = {name: " ".join(text.split()) for name, text in TEMPLATES.items()}
    gpl = texts["GPL-notice"]
    rest = {name: " ".join(texts[f"{name}-text"].split()[60:]) for name in ("Apache-2.0", "MPL-2.0", "LGPL-2.1", "CC-BY-SA-4.0", "MIT", "BSD-3-Clause")}
    filler = "the old man said that he would go down to the sea again and wait there for the boats "
    docs = [(0, filler * 9 + gpl + " " + filler * 3), *((k + 1, filler * 4 + text) for k, text in enumerate(rest.values()))]
    docs += [(20, f"{filler}{TEMPLATES['MIT']} " * 3), (21, f"{rest['MIT']} {rest['MIT']}"), (22, filler * 200)]
    found = {r.doc_id: r.licenses for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(x.template, x.word) for x in found[0] if x.template == "GPL-notice"] == [("GPL-notice", 9 * 19)]
    for k, name in enumerate(rest):
        own = [x for x in found[k + 1] if x.template == f"{name}-text"]
        assert len(own) == 1 and abs(own[0].word - 4 * 19) < 20 and own[0].containment > 0.95, (name, own)
    assert [x.word for x in found[20] if x.template == "MIT"] == [19, 43, 67]
    assert len([x for x in found[21] if x.template == "MIT-text"]) == 2
    assert found[22] == []


def test_top_k_equals_sql(spark, small):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = sorted(connection.execute(queries.ORACLES["op2_exact_topk"]).fetchall())
    assert sorted(tuple(r) for r in queries.op2_exact_topk(spark, small).collect()) == want


def brute_top_k(rows, asked, k):
    known = [(i, v) for i, v in rows if i is not None and v is not None]
    out = []
    for q, v in asked:
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in known if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_of_large_values_and_values_beyond_a_long(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    for size in (10**8, 3 * 10**9, 10**15, 2**62):
        rows = [(i, [int(x) for x in rng.integers(-size, size, 3)]) for i in range(120)] + [(500 + i, [size, size, size]) for i in range(4)]
        rows += [(600 + i, [i, -i, 1]) for i in range(20)]
        items = spark.createDataFrame(rows, "vec_id long, vector array<long>")
        got = top_k(items, items.filter("vec_id % 10 = 0"), 9, tree_rows=40).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(tuple(r) for r in got) == brute_top_k(rows, [r for r in rows if r[0] % 10 == 0], 9)


def test_top_k_opens_few_trees_and_computes_few_distances_on_clusters(spark, monkeypatch):
    monkeypatch.setattr("areascreen.llm.topk.PAGE", 16)
    rng = np.random.Generator(np.random.PCG64(4))
    centres = rng.normal(size=(20, 8))
    points = np.repeat(centres, 60, axis=0) + rng.normal(scale=0.02, size=(1200, 8))
    whole = np.floor(1000 * points / np.linalg.norm(points, axis=1)[:, None]).astype(int)
    rows = list(enumerate(whole.tolist()))
    items = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    want = brute_top_k(rows, [r for r in rows if r[0] % 40 == 0], 10)
    counts = {}
    for roots in (1024, 5):  # 20 trees in one part; 5 pivots with several trees each, in several parts
        monkeypatch.setattr("areascreen.llm.topk.ROOTS", roots)
        got = top_k(items, items.filter("vec_id % 40 = 0"), 10, tree_rows=60, query_rows=7).collect()
        assert sorted(tuple(r)[:4] for r in got) == want
        per_query = {r.query_id: (r.trees, r.distances) for r in got}
        counts[roots] = [sum(part) / 30 for part in zip(*per_query.values())]
    assert counts[1024][0] < 8 and counts[1024][1] < 1200 / 6, counts  # trees and distances of a query
    assert counts[5][1] < 1200 / 2, counts


def test_top_k_with_ties_repeats_and_nulls(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, rng.integers(-3, 4, 4).tolist()) for i in range(400)] + [(1000 + i, [2, 2, 2, 2]) for i in range(300)]
    rows += [(5, [1, 1, 1, 1]), (None, [9, 9, 9, 9]), (2000, None)]
    items = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    queried = items.filter("vec_id % 50 = 0")
    got = sorted(tuple(r) for r in top_k(items, queried, 7, tree_rows=150, query_rows=4).select("query_id", "rank", "vec_id", "score").collect())
    want = []
    known = [(i, np.array(v)) for i, v in rows if i is not None and v is not None]
    for q, v in known:
        if q % 50 == 0:
            best = sorted(((-int(v @ w), i) for i, w in known if i != q))[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert top_k(items.limit(0), queried).count() == 0 and top_k(items, queried.limit(0)).count() == 0
    assert top_k(items.limit(3), items.limit(1), 7).count() == 2
    bad = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (5, [1.0])], "vec_id long, e array<float>")
    assert [r.vec_id for r in bad.filter(usable("e")).collect()] == [5]
