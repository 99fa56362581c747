"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agriclime.llm import bpe, crf, decontaminate, licenses, lines, minhash, neighbours, packing, ppm, prefixes, repeats, sharding, variants
from agriclime.llm.common import fold, table
from agriclime.sources.tables import materialize

Query = Callable[[SparkSession, str], DataFrame]


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of equal row counts (law ``rows``)."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    size = sharding.record_bytes(F.col("text"))
    return sharding.shards(documents, 16, ["doc_id"], size, seed=7).select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document; learned on the folds 0 and 2 of 3."""
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True))
    documents = table(spark, folder, "documents")
    model = ppm.learn(ppm.learning_rows(documents, held_out))
    scored = ppm.identify(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    content = bpe.vocabulary_content(public_tokenizers.path("byte_bpe_50k.json"))
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode_decode(documents, content).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score of every document; learned on the folds 1 to 4 of 5."""
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True))
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = crf.learn(crf.learning_rows(documents, table(spark, folder, "labels"), ~held_out))
    return crf.score(documents, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        "spans",
    )


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every (document, test item) pair where the document holds the item within its budget."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.matches(documents, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that repeat an earlier line."""
    return lines.deduplicate(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 50-byte strings that start in an earlier document."""
    return repeats.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices of all documents: one row per document and license found."""
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("licenses").alias("l")).select("doc_id", "l.*")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return prefixes.prefix_trie(table(spark, folder, "conversations"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The words of all documents with their near words and the roots of their spellings."""
    return variants.variants(table(spark, folder, "documents"))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 1024 tokens."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        content = file.read()
    found = packing.pieces(table(spark, folder, "documents").select("doc_id", "text"), content)
    return packing.pack(materialize(found, "pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the corpus pipeline."""
    return corpus_pipeline.run(spark, folder)


def registered() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_minhash": op2_minhash,
        "op3_line_dedup": op3_line_dedup,
        "op4_neighbours": op4_neighbours,
        "op5_license_scan": op5_license_scan,
        "op6_decontamination": op6_decontamination,
        "op7_sharding": op7_sharding,
        "op8_bpe": op8_bpe,
        "op9_language_id": op9_language_id,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_packing": op13_packing,
        "pipeline": pipeline,
    }


OP2_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
    FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, na.n, nb.n
    HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

# Unsigned crc32 by its table; needs the CTE ``crc_table``.
CRC_TABLE = """crc_table AS MATERIALIZED (
    SELECT list(v ORDER BY b) AS crc FROM (
        SELECT b, list_reduce([b] || range(8), lambda x, i:
            CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
        FROM range(256) r(b)))"""


def crc32_sql(octets: str) -> str:
    """SQL of the crc32 of a list of byte values (BIGINT)."""
    return (
        f"xor(4294967295, list_reduce([4294967295] || {octets}, "
        "lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])))"
    )


OP11_SQL = f"""
WITH {CRC_TABLE}, turns AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), cut AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, l, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE
        {crc32_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 9 END AS h
    FROM turns, crc_table
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.l, [])[1:c.h], c.l[c.h + 1:]) AS l
    FROM cut c LEFT JOIN turns b ON b.conv_id = c.base
), prefix AS (
    SELECT conv_id, d, l[1:d] AS node, len(l) = d AS is_end FROM rebuilt, unnest(range(0, len(l) + 1)) u(d)
), nodes AS (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(
        CASE WHEN is_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM prefix GROUP BY node, d
), children AS (
    SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
), counted AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node, d)
), below AS (
    SELECT node[1:u.a] AS node, u.a AS d, count(*) FILTER (n_children = 0) AS n_leaves,
        sum(CASE WHEN d > 0 THEN (n_convs - 1) * strlen(node[d].t) ELSE 0 END)::BIGINT AS saved_tokens
    FROM counted, unnest(range(0, d + 1)) u(a) GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens,
    n.ends_sha256
FROM counted n JOIN below b USING (node, d) LEFT JOIN nodes p ON p.node = n.node[1:n.d - 1] AND p.d = n.d - 1
"""

_LETTERS = "lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195, ord(x)::BIGINT - 64] END"
_KEYED = "coalesce(doc_id::VARCHAR, '') || ':' || r"
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, found AS (
    SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents)
), runs AS (
    SELECT doc_id, r, count(*) AS times FROM found WHERE length(r) >= 7 GROUP BY doc_id, r
), hashed AS (
    SELECT r, times, {crc32_sql(f"flatten(list_transform(string_split({_KEYED}, ''), {_LETTERS}))")} AS h
    FROM runs, crc_table
), words AS MATERIALIZED (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, times
        FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), cuts AS (
    SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)
), longer AS (
    SELECT DISTINCT c.word AS long, w.word AS short FROM cuts c JOIN words w ON w.word = c.rest
), near AS (
    SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT long, short FROM longer UNION ALL SELECT short, long FROM longer
), best AS (
    SELECT near.word, count(*) AS n_near, first(struct_pack(w := o.word, n := o.n) ORDER BY o.n DESC, o.word) AS b
    FROM near JOIN words o ON o.word = near.other GROUP BY near.word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.w END AS form,
        CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS at, form AS onward FROM formed
    UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN formed f ON f.word = chain.onward
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word AND c.onward IS NULL
"""


def oracle() -> dict[str, str]:
    return {"op2_minhash": OP2_SQL, "op11_prefix_trie": OP11_SQL, "op12_spelling_variants": OP12_SQL}
