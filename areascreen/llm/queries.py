"""The registered queries of this subpackage: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from areascreen.llm.chat import format_conversations, read_back
from areascreen.llm.common import read
from areascreen.llm.decontaminate import find_leaks
from areascreen.llm.licenses import scan_licenses
from areascreen.llm.near_dup import near_duplicates
from areascreen.llm.packing import pack
from areascreen.llm.pii import KINDS, find, train
from areascreen.llm.prefix_trie import prefix_trie
from areascreen.llm.quality import score_quality, with_fold
from areascreen.llm.sharding import shard
from areascreen.llm.topk import top_k, usable
from areascreen.llm.toxicity import score_toxicity
from areascreen.llm.vector_codes import compress, hex_code, with_group_error
from areascreen.llm.weighted_hash import edited_fingerprints

#: Tokenizer file of the packing query; a parameter of the operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds: its passage, score and verified overlaps."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every row whose vec_id is divisible by 20, over all rows."""
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("long"))
    vectors = read(spark, sf_dir, "embeddings").filter(usable("embedding")).select("vec_id", whole.alias("vector"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20).select("query_id", "rank", "vec_id", "score")


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vector, c.vector), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license statement that a document holds, with its place and containment."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", F.explode("licenses").alias("found")).select("doc_id", "found.*")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of the base kinds, a digest of the base spans, and all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS))
    kinds = F.col("pii")["kind"]
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))


#: Score from which a document counts as good.
GOOD = 0.3


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_fold(score_quality(docs, read(spark, sf_dir, "labels")), "quality_score", GOOD)


#: A conversation whose texts look like marks of a template; it is formatted beside the table's own.
_MARKS = "\\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and digests of what reading the formatted text back gives."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(_MARKS).alias("text"))
        for k, role in enumerate(("user", "assistant"))])).alias("row")).select("row.*")
    back = read_back(format_conversations(turns.unionByName(added)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), n AS (
  SELECT *, row_number() OVER w AS k, row_number() OVER w = 1 OR lag(role) OVER w <> role AS opens,
    length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/')) AS body,
    length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), chr(10), '\n')) AS head
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN opens THEN 4 + head + 1 + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, num=85, den=100).drop("component")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents, with the checksum of each piece's ids."""
    pieces = pack(read(spark, sf_dir, "documents"), TOKENIZER, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, equal texts together."""
    return shard(read(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Score from which a document counts as toxic.
TOXIC = 0.5


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_fold(score_toxicity(docs, read(spark, sf_dir, "labels")), "toxic_score", TOXIC)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in four parts, their errors, the errors of their labels, and the digest of the codebooks."""
    found = compress(read(spark, sf_dir, "embeddings"), keep=("vec_id", "label"))
    return with_group_error(found.codes, "label", "label_error").select(
        "vec_id", hex_code("codes").alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _vector_codes_sql(rounds: int = 4) -> str:
    """Plain Lloyd rounds: every part meets every entry each time."""
    near = """
a{k} AS (
  SELECT vec_id, part, v, entry, d FROM (
    SELECT p.vec_id, p.part, p.v, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM p JOIN c{k} c USING (part))
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
)"""
    step = """
m{k} AS (
  SELECT part, entry, list(m ORDER BY place) AS v FROM (
    SELECT part, entry, place, CAST(floor(CAST(sum(v[place]) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM a{k}, range(1, 17) r(place) GROUP BY part, entry, place)
  GROUP BY part, entry
), c{n} AS (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry))"""
    turns = [near.format(k=k) + "," + step.format(k=k, n=k + 1) for k in range(rounds)] + [near.format(k=rounds)]
    return """
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT vec_id, part, v[16 * part + 1 : 16 * part + 16] AS v FROM e, range(4) r(part)
), c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < 256
),""" + ",".join(turns) + """, book AS (
  SELECT sha256(string_agg(x, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(v, ',') AS x FROM c{k})
), code AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{k} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM code JOIN e USING (vec_id), book
""".replace("{k}", str(rounds))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like it is to that and to the next document."""
    found = edited_fingerprints(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", *[F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], "near_edited", "near_next")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the conversations rebuilt on the heads of every fifth one."""
    c = F.col("conv_id")
    return prefix_trie(read(spark, sf_dir, "conversations"), base=c - c % 5, head=F.crc32(F.encode(c.cast("string"), "UTF-8")) % 9)


_TRIE_SQL = r"""
WITH bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS steps
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256('0:' || length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda r, x: xor(r >> 8, steps[(xor(r, x) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), bits
), heads AS (
  SELECT c.conv_id, o.k AS d, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.base AND o.k <= c.h
), rebuilt AS (
  SELECT * FROM heads
  UNION ALL
  SELECT c.conv_id, o.k - c.h + (SELECT count(*) FROM heads x WHERE x.conv_id = c.conv_id), o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h
), prefix AS (
  SELECT conv_id, d, octet_length(encode(text)) AS n_bytes,
    list(length(role) || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY d) AS turns, d = max(d) OVER (PARTITION BY conv_id) AS ends
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, [], NOT EXISTS (FROM rebuilt r WHERE r.conv_id = conv.conv_id) FROM conv
), member AS (
  SELECT conv_id, d, n_bytes, ends, sha256(array_to_string(list_transform(turns, lambda t: sha256(t)), '')) AS node,
    sha256(array_to_string(list_transform(turns[1:len(turns) - 1], lambda t: sha256(t)), '')) AS parent FROM prefix
), nodes AS (
  SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY d, node
), children AS (
  SELECT d - 1 AS d, parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), subtree AS (
  SELECT m.d, m.node, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.n_bytes) AS saved
  FROM nodes x LEFT JOIN children c USING (d, node) JOIN member m ON m.conv_id = x.conv_id AND m.d <= x.d GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s USING (d, node) LEFT JOIN children c USING (d, node) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.parent
"""


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_exact_topk, op3_license_scan, op4_pii, op5_quality_classifier, op6_chat_formatting, op7_minhash_near_dedup, op8_packing, op9_sharding, op10_toxicity,
    op11_vector_codes, op12_document_fingerprints, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op2_exact_topk": _TOPK_SQL, "op6_chat_formatting": _CHAT_SQL, "op11_vector_codes": _vector_codes_sql(), "op13_prefix_trie": _TRIE_SQL}
