"""The queries ``opN_<name>`` of these operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, exact_dedup, mixing, ngram_join, quality, secrets, sharding, token_files
from .common import scratch_path, stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256  # free in that vocabulary


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(_read(spark, sf_dir, "documents"))
    return plan.taken.select("doc_id", "size", "source_size", "target", "taken", "slots", "first_slot")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.grow_forest(secrets.labelled_findings(spark))
    return secrets.scan(_read(spark, sf_dir, "documents"), forest, path=F.coalesce("source", F.lit("")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.hilbert_shards(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = turns.unionByName(extra).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    back = chat.read_back(chat.format_chat(rows))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, _read(spark, sf_dir, "labels"))
    rows = quality.score(docs, weights, ["doc_id"])
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    docs = _read(spark, sf_dir, "documents")
    places = stored(token_files.write_token_files(docs, path, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, SEPARATOR), "token-places")
    counts = token_files.count_tokens(spark, path, SEPARATOR)
    # both sides grow with the documents: neither is broadcast, however small it looks
    return places.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_secret_scan": op2_secret_scan,
        "op3_ngram_join": op3_ngram_join,
        "op4_nearest": op4_nearest,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_hilbert_shards": op6_hilbert_shards,
        "op7_format_chat": op7_format_chat,
        "op8_quality": op8_quality,
        "op9_token_counts": op9_token_counts,
        "op10_bpe": op10_bpe,
    }


OP1_SQL = r"""
with words as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(text, '')) as fp
  from documents),
sized as (
  select *, md5(coalesce(cast(doc_id as varchar), '') || '|' || fp || '|' || row_number() over (partition by doc_id, source, fp)) as draw from words),
sources as (
  select source, sum(size)::double as n, row_number() over (order by source nulls last) - 1 as sid,
         [3, 1, 2][1 + ((row_number() over (order by source nulls last) - 1) % 3)::int]::double as w
  from sized group by source),
-- sources stop at 2 n in the order of n / w: fill the others by weight
ordered as (
  select *, coalesce(sum(2 * n) over (order by 2 * n / w, source rows between unbounded preceding and 1 preceding), 0) as filled,
         sum(w) over () - coalesce(sum(w) over (order by 2 * n / w, source rows between unbounded preceding and 1 preceding), 0) as left_w,
         1.5 * sum(n) over () as total
  from sources),
unit as (
  select coalesce(max((total - filled) / left_w), 1e300) as u from ordered where (total - filled) / left_w <= 2 * n / w),
targets as (select source, sid, n::bigint as n, least(2 * n, u * w) as target, floor(least(2 * n, u * w) + 0.5)::bigint as lim from sources, unit),
-- how many blocks of 1024 words a source gives, and its part of the golden-ratio points
needs as (select *, (n + 1023) // 1024 as blocks, coalesce((lim // nullif(n, 0)) * ((n + 1023) // 1024) + (lim % nullif(n, 0) + 1023) // 1024, 0)::bigint as need from targets),
shares as (select *, (sum(need) over (order by sid))::bigint as upto, (sum(need) over ())::bigint as total from needs),
bounds as (select *, coalesce(upto * 2147483648 // nullif(total, 0), 0) as hi, coalesce((upto - need) * 2147483648 // nullif(total, 0), 0) as lo from shares),
drawn as (
  select slot, sid, row_number() over (partition by sid order by slot) - 1 as rank
  from (select i as slot, (i % 2147483648) * 1327217885 % 2147483648 as point from range((select coalesce(max(total), 0) from bounds)) t(i)) join bounds on lo <= point and point < hi),
short as (
  select b.sid, total, greatest(need - coalesce(had, 0), 0)::bigint as lack, coalesce(had, 0) as had
  from bounds b left join (select sid, count(*) as had from drawn group by sid) using (sid)),
late as (
  select total + (sum(lack) over (order by sid))::bigint - lack as late_at, sid, lack, had from short),
slots as (
  select slot, sid, rank from drawn
  union all select late_at + i, sid, had + i from (select *, unnest(range(lack)) as i from late)),
rooms as (
  select slot, sid, rank % blocks as block, lim - ((rank // blocks) * n + (rank % blocks) * 1024) as room
  from slots join needs using (sid) where rank < need),
placed as (
  select s.doc_id, s.source, s.fp, s.draw, s.size, t.sid, t.n as source_size, t.target,
         (sum(s.size) over (partition by t.sid order by s.draw rows unbounded preceding))::bigint - s.size as start
  from sized s join needs t on s.source is not distinct from t.source),
pieces as (
  select p.draw, p.sid, r.slot, least(p.start + p.size - p.block * 1024, 1024, r.room) - greatest(p.start - p.block * 1024, 0) as words
  from (select *, unnest(range(start // 1024, (start + size - 1) // 1024 + 1)) as block from placed where size > 0) p join rooms r using (sid, block)),
got as (select sid, draw, sum(words) as taken, count(*) as slots, min(slot) as first_slot from pieces where words > 0 group by all)
select doc_id, size::bigint as size, source_size, target, coalesce(taken, 0)::bigint as taken, coalesce(slots, 0)::bigint as slots, first_slot::bigint as first_slot
from placed left join got using (sid, draw)
"""

OP3_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as m
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from shared join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 185 * m >= 85 * (x.n + y.n)),
reach(doc_id, other) as (
  select doc_id, doc_id from documents union select reach.doc_id, links.b from reach join links on links.a = reach.other)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id
from documents d left join sizes using (doc_id) join (select doc_id, min(other) as c from reach group by doc_id) using (doc_id)
"""

OP5_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as sha from documents)
select doc_id, max(doc_id) over (partition by sha) as keep_id, count(*) over (partition by sha) as group_size,
       doc_id = max(doc_id) over (partition by sha) as kept, sha as text_sha256
from d
"""

OP7_SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
         sum(length('<|turn|>' || replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;') || chr(10)
                    || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') || '<|end|>' || chr(10))) as formatted_chars
  from t group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
       formatted_chars::bigint as formatted_chars
from g
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op3_ngram_join": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op7_format_chat": OP7_SQL}
