"""The queries of the training-data operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontaminate, language, neardup, packing, substring_dedup, suffix_dedup, token_counts, token_files, topk

#: The conversation added to those of the table; it says what the template itself says.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 1024)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), 200)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"), 64)
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), common.scratch_path(spark, "token-files"))
    return token_files.read_token_files(manifest)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "largest")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), 50)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 8, 2)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(common.stored(chat.chat_trees(conversations), "chat"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_language_id": op5_language_id,
        "op6_token_files": op6_token_files,
        "op7_token_counts": op7_token_counts,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_chat_formatting": op10_chat_formatting,
        "pipeline": pipeline,
    }


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP9_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
n as (select item_id, w, least(len(w), 8) n from b where len(w) > 0),
iw as (select distinct item_id::varchar item, n, array_to_string(w[t:t + n - 1], ' ') g from (select *, unnest(range(1, (len(w) - n + 2)::bigint)) t from n)),
dw as (select doc_id, t, m, array_to_string(w[t:t + m - 1], ' ') g from (select doc_id, w, m, unnest(range(1, (len(w) - m + 2)::bigint)) t from d, (select distinct n m from iw))),
h as (select doc_id, t, m, item from dw join iw on dw.g = iw.g and dw.m = iw.n),
p as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(t, t + m)) p from h) group by doc_id),
i as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from h group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join p using (doc_id) left join i using (doc_id)
"""


OP2_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
g as (select distinct doc_id, md5(array_to_string(w[t:t + 2], ' ')) g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1)::bigint + 1)) t from d where len(w) > 0)),
n as (select doc_id, count(*) n from g group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id c from documents union select e.b, r.c from r join e on e.a = r.doc_id),
m as (select doc_id, min(c) c from r group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, c component_id, d.doc_id = c kept from d left join n using (doc_id) join m using (doc_id)
"""

OP3_SQL = """
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select r, s, md5(substr(h, 2 * s + 1, 400)) g from (select r, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) s from d)),
m as (select r, s, s > coalesce(lag(s) over (partition by r order by s), -1000) + 200 fresh from w where g in (select g from w group by g having count(*) > 1)),
i as (select r, s, sum(fresh::int) over (partition by r order by s) i from m),
x as (select r, min(s) a, max(s) + 200 b from i group by r, i),
p as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) z from x),
k as (select r, count(*) n_spans, sum(b - a) n_removed, max(b) e, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by a) k from p join d using (r) group by r)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(case when k is null then h else k || substr(h, 2 * e + 1) end)) kept_sha256
from d left join k using (r)
"""

OP8_SQL = r"""
with d as (select row_number() over () r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
w as (select r, doc_id, s, md5(array_to_string(w[s + 1:s + 50], ' ')) g from (select r, doc_id, w, unnest(range(0, greatest(len(w) - 49, 0)::bigint)) s from d)),
f as (select g, min(doc_id) least from w group by g),
m as (select r, s, s > coalesce(lag(s) over (partition by r order by s), -1000) + 50 fresh from w join f using (g) where doc_id > least),
i as (select r, s, sum(fresh::int) over (partition by r order by s) i from m),
x as (select r, min(s) a, max(s) + 50 b from i group by r, i),
p as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) z from x),
k as (select r, sum(b - a) n_removed, max(b) e, flatten(list(w[z + 1:a] order by a)) k from p join d using (r) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(array_to_string(case when e is null then w else list_concat(k, w[e + 1:]) end, ' ')) kept_sha256
from d left join k using (r)
"""

OP10_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') said from conversations union all
  select -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
t as (select *, case when role = 'assistant' then said else '' end loss,
  length('<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10) || replace(replace(said, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10)) n from c)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' order by turn, role, said)) turns_sha256,
  sum(length(loss))::bigint loss_chars, sha256(string_agg(loss, '' order by turn, role, said)) loss_sha256, sum(n)::bigint formatted_chars
from t group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": OP2_SQL, "op3_suffix_array_dedup": OP3_SQL, "op4_exact_top_k": OP4_SQL, "op8_substring_dedup": OP8_SQL, "op9_decontamination": OP9_SQL, "op10_chat_formatting": OP10_SQL}
