"""Registered queries of the training-data operators: ``QUERIES`` and, where SQL can say the same, ``ORACLE``.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_documents

    return shard_documents(read_table(spark, sf_dir, "documents"), shards=24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


@query
def op5_spliced_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.tokens import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op6_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import scan_secrets

    return scan_secrets(read_table(spark, sf_dir, "documents")).drop("value")


@query
def op3_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.hnsw import nearest_rows

    rows = read_table(spark, sf_dir, "embeddings")
    return nearest_rows(rows, rows.filter("vec_id % 100 = 0"))


@query
def op8_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, similarity=85)


@query
def op2_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.recompression import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), width=20).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffixes import remove_repeated_bytes

    done = remove_repeated_bytes(read_table(spark, sf_dir, "documents"), length=400)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_vantage_point_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.centroids import centroid_clusters, with_inertia

    return with_inertia(*centroid_clusters(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64, scale=64))


def _rounds_sql(rounds: int) -> str:
    """Rounds of integer k-means as a chain of tables: a<i> assigns by the centroids c<i>, c<i + 1> are its means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as (select p.rid, p.vec_id, min(struct_pack(distance := list_sum(list_transform(list_zip(p.point, c.point), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT,
                                               cluster := c.cluster)) as best
       from points p cross join c{i} c group by p.rid, p.vec_id)""")
        if i < rounds:
            steps.append(f"""
s{i} as (select best.cluster as cluster, i, sum(p.point[i])::HUGEINT as s, count(*)::HUGEINT as n
       from a{i} join points p using (rid) cross join range(1, 65) t(i) group by 1, 2),
m{i} as (select cluster, list(((s - (((s % n) + n) % n)) // n)::BIGINT order by i) as point from s{i} group by 1),
c{i + 1} as (select c.cluster, coalesce(m.point, c.point) as point from c{i} c left join m{i} m using (cluster))""")
    return ",".join(steps)


ORACLE["op11_vantage_point_clusters"] = f"""
with kept as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) as point from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
points as (select row_number() over () as rid, * from kept),
c0 as (select (row_number() over (order by name, point) - 1)::INTEGER as cluster, point
       from (select sha256('1:' || coalesce(vec_id::VARCHAR, '')) as name, point from points order by 1, 2 limit 16)),
{_rounds_sql(3)}
select vec_id, best.cluster as cluster, best.distance as distance,
       (sum(best.distance) over (partition by best.cluster))::BIGINT as cluster_inertia, (sum(best.distance) over ())::BIGINT as inertia,
       sha256(array_to_string(c.point, ',')) as centroid_sha256
from a3 join c3 c on c.cluster = best.cluster
"""


@query
def op12_stripe_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.divergence import source_divergence

    return source_divergence(read_table(spark, sf_dir, "documents"), least=10, top=10)


ORACLE["op12_stripe_divergence"] = r"""
with docs as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select rid, lang, source,
            unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from words group by 1, 2 having count(distinct rid) >= 10),
counts as (select lang, source, term, count(*)::HUGEINT as n from words join kept using (lang, term) group by 1, 2, 3),
v as (select lang, count(*)::HUGEINT as v from kept group by 1),
groups as (select lang, source, coalesce(sum(n), 0)::HUGEINT as total from (select distinct lang, source from docs) left join counts using (lang, source) group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.v) as p
      from groups g join v using (lang) join kept k using (lang) left join counts c using (lang, source, term)),
q as (select lang, term, 1 + (1000000000 * (sum(n) + 2)::HUGEINT) // (any_value(total) + 2 * any_value(v)) as q
      from counts join v using (lang) join (select lang, sum(total)::HUGEINT as total from groups group by 1) using (lang) group by 1, 2),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)), 0)::BIGINT as value
          from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
ranked as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(x.value, 0)::BIGINT as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source
  left join pairs x on x.lang = g.lang and x.source = g.source and x.item = h.source
  union all
  select p.lang, p.source, 'term', p.term, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT
  from p join q using (lang, term) where p.n > 0 and p.p > q.q)
select * from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::INTEGER as rank from ranked)
where part = 'pair' or rank <= 10
"""


@query
def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import decode_ids, encode_texts

    path = public_tokenizers.path("word_bpe_49k.json")
    done = decode_ids(encode_texts(read_table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
