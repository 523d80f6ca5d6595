"""The registered queries of the corpus operators.

Each takes (spark, sf_dir), applies its operator with production parameters to
its whole table and derives the digest columns from the operator's own output.
``ORACLES`` has DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm import language_id, near_dedup, quality, sentencepieces, token_counts, vector_search
from wavegrid.llm.common import bucket_of
from wavegrid.runtime import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, vocabulary("piece_bpe_32k.model"), eligible=bucket_of(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, eligible=bucket_of(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return quality.score(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0, k=5, factor=256.0)


ORACLES["op5_vector_search"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256e0 * x::double)::bigint) as c
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, d.vec_id,
         cast(list_sum(list_transform(list_zip(q.c, d.c), lambda t: t[1] * t[2])) as bigint) as score
  from v q join v d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as n, vec_id, score from s
)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 5
"""


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80).drop("text_key")


#: Exact components from all pairs that share a shingle.
ORACLES["op7_near_dedup"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a.doc_id as x, b.doc_id as y
  from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  where 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  group by a.doc_id, b.doc_id, na.n, nb.n
  having 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), e as (select x, y from links union all select y, x from links),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, e.y from reach r join e on e.x = r.y)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, m.c = d.doc_id as kept
from documents d left join n using (doc_id) join (select x, min(y) as c from reach group by x) m on m.x = d.doc_id
"""


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    both = sentencepieces.decode(sentencepieces.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
