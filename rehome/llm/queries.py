"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rehome.llm.archives import archived_pages
from rehome.llm.katz import katz_scores
from rehome.llm.language import predict_language
from rehome.llm.mixing import fair_mix
from rehome.llm.pieces import encode_texts, load_model
from rehome.llm.prefix_trie import conversation_turns, prefix_trie, shared_starts
from rehome.llm.quality import judge_quality
from rehome.llm.shared import shared_folder, table
from rehome.llm.shards import document_dimensions, kd_shards
from rehome.llm.simhash import simhash_groups
from rehome.llm.topk import top_products
from rehome.llm.url_model import Rule, judge_urls
from rehome.llm.vector_groups import near_vectors
from rehome.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# A public model file; set LLM_PIECE_MODEL to use another.
PIECE_MODEL = os.environ.get("LLM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

# The rules of the URL filter.
RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


@query()
def op1_katz_backoff(spark, sf_dir):
    return katz_scores(table(spark, sf_dir, "documents"), order=3)


@query()
def op2_quality_votes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query()
def op3_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


@query()
def op4_language_gru(spark, sf_dir):
    return predict_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])


@query()
def op5_kd_shards(spark, sf_dir):
    docs, dimensions = document_dimensions(table(spark, sf_dir, "documents"))
    found = kd_shards(docs, 24, F.col("own_size"), [F.col(d) for d in dimensions], F.col("own_group"))
    return found.select(
        F.col("id").alias("doc_id"), "size", F.col("grp").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query()
def op6_pieces(spark, sf_dir):
    docs, model = table(spark, sf_dir, "documents").select("doc_id", "text"), load_model(PIECE_MODEL)
    return encode_texts(docs, model, decoded="decoded").select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
                          (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query()
def op7_vector_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source),
  w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s),
  r AS (SELECT *, cap / weight AS ratio, sum(cap) OVER o - cap AS held, sum(weight) OVER () - sum(weight) OVER o + weight AS left_weight,
      sum(source_size) OVER () AS total FROM w WINDOW o AS (ORDER BY cap / weight, place)),
  l AS (SELECT arg_min((total - held)::DOUBLE / left_weight, ratio) FILTER ((total - held)::DOUBLE / left_weight < ratio) AS level FROM r),
  t AS (SELECT source, place, source_size, least(cap::DOUBLE, level * weight) AS target FROM w, l),
  q AS (SELECT doc_id, d.source, size, source_size, target, place, sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || doc_id), size)::BIGINT AS words
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  p AS (SELECT *, (turn * source_size + words)::DOUBLE / target AS finish FROM q, range(3) x(turn) WHERE size > 0 AND target > 0 AND turn * source_size <= target),
  c AS (SELECT *, sum(size) OVER (ORDER BY finish, place, turn, words) AS total FROM p),
  n AS (SELECT doc_id, count(*) AS times FROM c WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
  SELECT doc_id, source, size, source_size, target, (coalesce(times, 0) * size)::BIGINT AS taken FROM q LEFT JOIN n USING (doc_id)""")
def op8_fair_mix(spark, sf_dir):
    return fair_mix(table(spark, sf_dir, "documents"))


@query()
def op9_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)) WHERE rank <= 10""")
def op10_exact_top_k(spark, sf_dir):
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
  h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM c),
  r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
  p AS (SELECT conv_id, len(turns) AS full_depth, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
  k AS (SELECT conv_id, full_depth, depth, turns[1:depth] AS path FROM p),
  n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (full_depth = depth), '')) AS ends_sha256,
      (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(path[depth].text) END AS own FROM k GROUP BY depth, path),
  f AS (SELECT n.*, q.conv_id AS parent_conv_id, coalesce(x.n_children, 0) AS n_children FROM n
      LEFT JOIN n q ON n.depth = q.depth + 1 AND n.path[1:n.depth - 1] = q.path
      LEFT JOIN (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL) x ON x.depth = n.depth AND x.path = n.path),
  a AS (SELECT above AS depth, path[1:above] AS path, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(depth + 1)) AS above FROM f) GROUP BY ALL)
  SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
      a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256 FROM f JOIN a ON a.depth = f.depth AND a.path = f.path""")
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(shared_starts(conversation_turns(table(spark, sf_dir, "conversations"))))


@query()
def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


@query()
def op13_archives(spark, sf_dir):
    found = archived_pages(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
