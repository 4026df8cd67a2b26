"""Personal data, chat formatting, packing, sharding, quality, toxicity and the pipeline."""

from __future__ import annotations

import re
import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from areascreen.llm import queries
from areascreen.llm.bytetext import span_hashes, utf8, word_spans
from areascreen.llm.chat import format_conversations, read_back
from areascreen.llm.near_dup import near_duplicates
from areascreen.llm import packing
from areascreen.llm.packing import pack, piece_lengths
from areascreen.llm import pii
from areascreen.llm.pii import KINDS, find, redact, train
from areascreen.llm.quality import score_quality
from areascreen.llm.sharding import shard
from areascreen.llm.tokens import UnitTokenizer
from areascreen.llm.toxicity import score_toxicity

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def test_base_spans_equal_the_patterns(spark, odd, none):
    hard = ["x a@b.c.d..e@f.g %z@q.r, a@b.c%d@e.f", "4111 1111 1111 1111- 4111-1111--1111 1111 5500-0000-0000-0004", "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.1",
            "+1 (743) 555-3824. +12", "é😀 +44 20 7946 0958 ü a@b.co", "a@b.c-.d@e.f.", "--1.2.3.4", "1 " * 3000]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string"))
    rows = find(docs, train(docs)).collect()
    for row in rows:
        assert [(s.start, s.kind, s.end) for s in row.pii if s.kind in KINDS] == base_spans(row.text)
    assert any(s.kind == "secret" for r in rows for s in r.pii)
    assert find(odd, train(odd)).count() == odd.count() and find(none, train(none)).count() == 0
    long = spark.createDataFrame([(1, "a." * 20000 + "@b" + ".c" * 20000), (2, "1-" * 20000), (3, "1" * 50000)], "doc_id long, text string")
    assert [len(r.pii) for r in find(long, {}).orderBy("doc_id").collect()][0] == 1


def test_redaction_leaves_no_base_span(spark, odd):
    rows = {r.doc_id: r.text for r in redact(find(odd, train(odd))).collect()}
    assert rows[12] == "[email] [ip], [phone], [card]" and rows[1] is None and rows[2] == ""


def test_chat_equals_sql_and_round_trips(spark, small):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    result = connection.execute(queries.ORACLES["op6_chat_formatting"])
    names = [c[0] for c in result.description]
    assert sorted(map(tuple, queries.op6_chat_formatting(spark, small).select(*names).collect())) == sorted(result.fetchall())
    hostile = ["</part>", "\\", "\\</turn>\n", "###", "### assistant\n", "", "<\\/", "\\n", "\\#", "#</", None, "ü😀", "\n\n"]
    rows = [(k % 3, n, role, text) for k in range(3) for n, text in enumerate(hostile * 60) for role in [["user", "assistant", "assistant", None, "a:\n#"][(n + k) % 5]]]
    rows += [(None, None, None, None), (0, 3, "user", "###"), (0, 3, "user", "###")]
    back = read_back(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for row in back:
        want = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == row.conv_id))
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, _, r, x in want]
        assert row.loss_text == "".join(x for _, _, r, x in want if r == "assistant")
    assert len(back) == 4
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_very_long_conversation(spark):
    rows = spark.range(20000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("w# "), F.col("id")).alias("text"))
    back = read_back(format_conversations(rows)).first()
    assert [t.text for t in back.turns] == [f"w# {k}" for k in range(20000)]
    assert back.loss_text == "".join(f"w# {k}" for k in range(20000) if k % 3)


def test_columns_called_like_those_used_inside_come_back(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co", "x", 5)], "doc_id long, text string, _email string, _candidates int")
    row = redact(find(docs, train(docs))).first()
    assert (row["_email"], row["_candidates"], row["text"]) == ("x", 5, "mail [email]")


def test_packing_round_trips(spark, small, odd, none, tmp_path):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    hard = spark.createDataFrame([(-1, "It's a DON'T <|endoftext|>x  ÉÀ×÷ß…! naïve 日本語   a　b 12,3!!"), (-2, None), (-3, "a" * 9000)], "doc_id long, text string")
    texts = dict(docs.union(hard).collect())
    got: dict[int, list] = {}
    for row in pack(docs.union(hard), queries.TOKENIZER).collect():
        assert row.length == 1 << row.bucket <= 2048 and row.offset == 0 and len(row.ids) == 4 * row.length
        got.setdefault(row.doc_id, []).append((row.start, np.frombuffer(row.ids, "<u4").tolist(), row.doc_tokens))
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert [i for _, piece, _ in sorted(got[doc_id]) for i in piece] == ids and got[doc_id][0][2] == len(ids)
    pieces = queries.op8_packing(spark, small)
    assert pieces.select("sequence_id").distinct().count() == pieces.count()
    rows = pieces.collect()
    ranked = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert ranked == sorted(ranked) and all(r.sequence_id >> packing.BUCKET_BITS == r.bucket for r in rows)
    row = next(r for r in rows if r.start == 0)
    assert row.ids_crc32 == zlib.crc32(np.array(next(p for s, p, _ in got[row.doc_id] if s == 0), "<u4").tobytes())
    assert pack(odd, queries.TOKENIZER).filter("start = 0").count() == odd.count() and pack(none, queries.TOKENIZER).count() == 0
    folder = str(tmp_path / "buckets")
    packing.write_buckets(pack(docs, queries.TOKENIZER), folder)
    assert {r.bucket for r in rows} == {int(p.name.split("=")[1]) for p in tmp_path.glob("buckets/bucket=*")}
    back = spark.read.parquet(folder)
    assert back.filter("length != shiftleft(1, bucket)").count() == 0 and back.count() == pieces.count()
    assert piece_lengths(4096 + 7, 2048) == [2048, 2048, 4, 2, 1]
    with pytest.raises(ValueError):
        pack(odd, queries.TOKENIZER, longest=1000)


def check_shards(rows, shards: int) -> None:
    sizes = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def regular_word(size: int, first: str, second: str) -> str:
    """Letters by the parity of the ones in their place's binary digits (Thue-Morse); with the letters swapped, sums of powers agree."""
    return "".join(second if place.bit_count() % 2 else first for place in range(size))


@pytest.mark.parametrize("size", [512, 1024, 2048, 8192])
def test_regular_long_words_keep_their_own_hash_and_ids(size):
    one, two = regular_word(size, "a", "b"), regular_word(size, "b", "a")
    texts = [one, two, f"x {one} y", f"{two}z", one]
    data, offsets = utf8(pa.array(texts))
    starts, ends, _ = word_spans(data, offsets)
    hashes = dict(zip(zip(starts.tolist(), ends.tolist()), span_hashes(data, starts, ends).tolist()))
    by_word: dict[bytes, set] = {}
    for (a, b), value in hashes.items():
        by_word.setdefault(data[a:b].tobytes(), set()).add(value)
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)
    ids, bounds = UnitTokenizer(queries.TOKENIZER).encode(data, offsets)
    plain = Tokenizer.from_file(queries.TOKENIZER)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_texts_of_regular_long_words_share_no_shingle(spark):
    docs = spark.createDataFrame([(1, regular_word(1024, "a", "b")), (2, regular_word(1024, "b", "a")), (3, regular_word(1024, "a", "b"))], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in near_duplicates(docs, words=3, num=85, den=100).collect()}
    assert groups == {1: 1, 2: 2, 3: 1}


def test_shards_are_even_and_keep_copies_together(spark, small, odd, none):
    rows = queries.op9_sharding(spark, small).collect()
    check_shards(rows, 24)
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    homes: dict[str, set] = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert max(map(len, homes.values())) == 1
    check_shards(shard(odd, 5).collect(), 5)
    assert shard(none, 5).count() == 0


@pytest.mark.parametrize("rows", [1, 24, 200, 383, 400])
def test_shards_of_small_tables(spark, rows):
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") < rows // 2, F.floor(F.col("id") / 2)).otherwise(F.col("id") + 1000)).alias("text"))
    found = shard(docs, 24).collect()
    check_shards(found, 24)
    homes: dict = {}
    for r in found:
        if r.doc_id < rows // 4 * 2:
            homes.setdefault(r.doc_id // 2, set()).add(r.shard)
    if rows >= 200:  # below, a shard has one row
        assert all(len(h) == 1 for h in homes.values())


def test_shards_of_one_huge_group(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 500, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = shard(docs, 6).collect()
    check_shards(rows, 6)
    assert len({r.shard for r in rows if r.doc_id < 500}) <= 5  # fills whole shards


def test_a_hot_text_does_not_cut_pairs(spark):
    text = F.when(F.col("id") < 3000, "hot").when(F.col("id") < 9000, F.concat(F.lit("pair"), F.floor(F.col("id") / 2))).when(
        F.col("id") < 12000, F.concat(F.lit("three"), F.floor(F.col("id") / 3))).otherwise(F.concat(F.lit("t"), F.col("id")))
    rows = shard(spark.range(24000).select(F.col("id").alias("doc_id"), text.alias("text")), 12).collect()
    check_shards(rows, 12)
    homes: dict = {}
    for r in rows:
        if 3000 <= r.doc_id < 12000:
            homes.setdefault(("pair", r.doc_id // 2) if r.doc_id < 9000 else ("three", r.doc_id // 3), set()).add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) == 0


@pytest.mark.parametrize(("name", "score", "least"), [("quality", score_quality, 0.95), ("toxic", score_toxicity, 0.95)])
def test_held_out_accuracy(spark, odd, none, name, score, least):
    medium = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{medium}/labels.parquet")
    query = queries.op5_quality_classifier if name == "quality" else queries.op10_toxicity
    rows = query(spark, medium).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[name] for r in held]) >= least
    scored = score(odd, labels.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert scored.count() == odd.count() and scored.columns == [*odd.columns, f"{'quality' if name == 'quality' else 'toxic'}_score"]
    both = score(odd.unionByName(docs.limit(0).join(odd.select("doc_id"), "doc_id", "left_semi"), allowMissingColumns=True), labels).collect()
    assert all(0 <= r[-1] <= 1 for r in both)
    assert score(none, labels).count() == 0 and score(odd, labels.limit(0)).count() == odd.count()


def test_pipeline_stage_by_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, small)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in kept.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert after.keys() <= before.keys()
        if name == "minhash_near_dedup":
            from tests.llm.test_matching import brute_components
            assert after.keys() == set(brute_components(before, 5, 4, 5).values())
        if name == "benchmark_decontamination":
            assert before.keys() - after.keys() == {i for i, t in before.items() if any(x in " ".join(t.split()) for x in items)}
        if name == "pii":
            assert after.keys() == before.keys() and not any(base_spans(t) for t in after.values())
        kept = spark.createDataFrame(out.collect(), docs.schema)
    final = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in final.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}


def test_pipeline_keeps_different_texts_of_one_id(spark, small):
    story = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdef"]
    near = story[0] + " more"
    rows = [(1, story[0]), (1, near), (1, story[1]), (1, story[1]), (2, story[2]), (2, near), (3, story[3]), (3, story[3]),
            (4, ""), (4, ""), (4, None), (5, story[4]), (6, story[4] + " more"), (None, story[0]), (None, story[0])]
    docs = spark.createDataFrame([(i, t, "c", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, mark string, component long")
    out = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, small)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(1, min(story[0], near, key=lambda t: hashlib.sha256(t.encode()).digest())), (1, story[1]), (2, story[2]), (3, story[3]), (4, ""), (4, None), (5, story[4]), (None, story[0]), (None, story[0])]
    assert got == sorted(want, key=str)


def test_pipeline_of_odd_and_empty_tables(spark, odd, none, small):
    for rows in (odd, none):
        kept = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, small)
            if name == "minhash_near_dedup" and rows is odd:
                ids = [r.doc_id for r in out.select("doc_id").collect() if r.doc_id is not None]
                assert len(ids) == len(set(ids))
            kept = spark.createDataFrame(out.collect(), out.schema)


def test_batches_of_text_stay_within_a_megabyte():
    import pyarrow as pa

    from areascreen.llm.common import text_batches

    texts = ["a" * 300_000] * 10 + ["b" * 3_000_000, None, "c"]
    cut = list(text_batches(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    assert [t for batch in cut for t in batch.column("text").to_pylist()] == texts
    assert all(batch.num_rows == 1 or sum(len(t or "") for t in batch.column("text").to_pylist()) <= 1 << 20 for batch in cut)


def test_training_searches_a_text_once_for_each_kind_and_for_candidates(spark):
    docs = spark.createDataFrame([("x",)], "text string")
    plan = pii.candidate_spans(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(pii.KINDS) + 1


def test_candidates_are_long_tokens_with_a_digit_outside_base_spans(spark):
    texts = ["abcdefghijklmnop", "key=abcdefghijk1 x1bcdefghijklm", "abcdefghijk 1bcdefghij", None, "", "abcdefghijklm-1_2/3+ 9", "a.long.name1234567890@example.org zz00112233445566", "=abcdefghijk1 é0123456789ab"]
    rows = pii.candidate_spans(spark.createDataFrame([(t,) for t in texts], "text string")).select("c.start", "c.end", "c.text").collect()
    assert sorted(tuple(r) for r in rows) == [
        (0, 20, "abcdefghijklm-1_2/3+"), (15, 27, "0123456789ab"), (17, 31, "x1bcdefghijklm"), (34, 50, "zz00112233445566")]
