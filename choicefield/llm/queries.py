"""One registered query for each operator, over its whole table; SQL only where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, automaton, bpe, chat, html, langid, media, packing, pii, secret_scan
from .common import Stored
from .hard_negatives import hard_negatives
from .ngram_join import jaccard_components
from .prefix_trie import prefix_trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables hold no images, so each embedding is drawn as one, and one in ten also as an edited copy."""
    return media.image_copies(media.drawings(table(spark, sf_dir, "embeddings")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = Stored(secret_scan.findings(docs, secret_scan.corpus_of(docs)), "findings").df
    return secret_scan.scan(found, secret_scan.train(found, label="weak"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs.filter(~langid.is_held_out("doc_id") & docs.doc_id.isNotNull())))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_conversations(chat.records_of_turns(conversations)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=moved)


def op13_tokenization_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_copies": op1_media_copies,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_secret_scan": op3_secret_scan,
    "op4_html_text": op4_html_text,
    "op5_pii": op5_pii,
    "op6_bpe": op6_bpe,
    "op7_langid": op7_langid,
    "op8_ann": op8_ann,
    "op9_packing": op9_packing,
    "op10_chat": op10_chat,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_tokenization_automaton": op13_tokenization_automaton,
}

#: CRC-32 of the decimal number: its bytes in order, each followed by eight shifts (-1) with the reflected polynomial
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint],
  flatten(list_transform(range(1, length(c::varchar) + 1), lambda k: list_concat([ascii(substr(c::varchar, k::int, 1))::bigint], [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))),
  lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

#: Leaves and saved tokens of a node are sums over its conversations: a leaf counts for its smallest conversation, and so does what a
#: node saves, as the smallest conversation of a node below is one of the node's.
_PREFIX_TRIE = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 100 AS b, {_CRC} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
heads AS (SELECT c AS b, least(max(i), 5) AS m FROM own GROUP BY c),
begun AS (SELECT ids.c, own.i AS d, own.role, own.text FROM ids JOIN own ON own.c = ids.b AND own.i <= ids.h),
later AS (SELECT own.c, own.i - ids.h + least(ids.h, coalesce(m, 0)) AS d, own.role, own.text
          FROM own JOIN ids USING (c) LEFT JOIN heads USING (b) WHERE own.i > ids.h),
turns AS (SELECT * FROM begun UNION ALL SELECT * FROM later),
paths AS (SELECT c, d, length(text) AS n, list(struct_pack(r := role, t := text)) OVER (PARTITION BY c ORDER BY d) AS path FROM turns
          UNION ALL SELECT c, 0, 0, [] FROM ids),
marked AS (SELECT *, min(c) OVER (PARTITION BY path) AS m, count(*) OVER (PARTITION BY path) AS k, max(d) OVER (PARTITION BY c) AS last FROM paths),
up AS (SELECT *, lag(m) OVER (PARTITION BY c ORDER BY d) AS parent, CASE WHEN c = m THEN (k - 1) * n ELSE 0 END AS saves FROM marked),
nodes AS (SELECT m, d, any_value(parent) AS parent, any_value(k) AS k, string_agg(c::varchar, ',' ORDER BY c) FILTER (d = last) AS ends FROM up GROUP BY m, d),
born AS (SELECT parent AS m, d - 1 AS d, count(*) AS born FROM nodes WHERE d > 0 GROUP BY ALL),
carried AS (SELECT up.m, up.d, sum(saves) OVER (PARTITION BY up.c ORDER BY up.d DESC) AS saves, max(CASE WHEN born.m IS NULL AND c = up.m THEN 1 ELSE 0 END) OVER (PARTITION BY up.c) AS leaf
            FROM up LEFT JOIN born ON born.m = up.m AND born.d = up.d),
summed AS (SELECT m, d, sum(saves) AS saved, sum(leaf) AS leaves FROM carried GROUP BY m, d)
SELECT nodes.m AS conv_id, nodes.d::bigint AS depth, parent AS parent_conv_id, k AS n_convs, coalesce(born, 0)::bigint AS n_children,
       leaves::bigint AS n_leaves, saved::bigint AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes JOIN summed USING (m, d) LEFT JOIN born USING (m, d)
"""
_HARD_NEGATIVES = """
WITH vectors AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                        list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
                 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::bigint AS score
          FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::int AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= 5
"""
ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": _PREFIX_TRIE, "op12_hard_negatives": _HARD_NEGATIVES}
