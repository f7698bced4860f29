"""The queries of the corpus operators, as the driver's contract wants them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import bpe_prefix, bpe_trie, decontaminate, exact_dedup, fill_middle, html_extract, kd_shard, line_dedup, secret_ledger, simhash, token_counts, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_tag_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.with_main_text(pages).drop("html")


def op2_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP2_SQL = r"""
with item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, array_to_string(list_slice(w, i, i + 12), ' ') as win, least(len(w), 13) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from item_words where len(w) > 0)),
doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
cut as (
  select doc_id, i, k.n, array_to_string(list_slice(w, i, i + k.n - 1), ' ') as win
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from doc_words) cross join (select distinct n from windows) k
  where i + k.n - 1 <= len(w)),
occ as (select doc_id, i, cut.n, item_id from cut join windows using (win, n)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id),
items as (
  select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
  from (select distinct doc_id, item_id::varchar as item_id from occ) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc_words left join hit using (doc_id) left join items using (doc_id)
"""


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.scan_documents(table(spark, sf_dir, "documents"))


def _op3_sql() -> str:
    """Starts are running sums of the pieces between the matches and of the matches."""
    parts = []
    for rank, r in enumerate(secret_ledger.RULES):
        p = r.pattern.replace("'", "''")
        held = f"length(regexp_extract(m, '^(?:{p})', {r.group}))"
        parts.append(f"""
  select doc_id, '{r.kind}' as kind, {rank} as rank, ends - length(m) as s, ends as e from (
    select *, sum(length(g) + length(m)) over (partition by doc_id order by n) as ends from (
      select doc_id, unnest(ms) as m, unnest(list_slice(gs, 1, len(ms))) as g, unnest(range(len(ms))) as n from (
        select doc_id, regexp_extract_all(t, '{p}') as ms, string_split_regex(t, '{p}') as gs from texts)
    )) where {held} >= {r.least}""")
    return f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
spans as ({" union all ".join(parts)}),
lines as (
  select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
         count(*) filter (where kind = 'hex') as n_hex,
         string_agg(concat(kind, ':', s, ':', e), ',' order by s, rank) filter (where rank < {len(secret_ledger.BASE)}) as base,
         string_agg(concat(kind, ':', s, ':', e), ',' order by s, rank) as spans
  from spans group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
       coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join lines using (doc_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.with_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


OP5_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
shared as (
  select k, min(doc_id) as first from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1),
marked as (
  select keyed.*, coalesce(doc_id > first, false) as gone from keyed left join shared using (k))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, tokenizer(token_counts.VOCABULARY), piece_pattern()).drop("text")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.text_groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with normal as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
best as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size
  from normal window w as (partition by text_sha256 order by n desc, doc_id))
select doc_id, keep_id, group_size::bigint as group_size, doc_id = keep_id as kept, text_sha256 from best
"""


def op8_kd_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shard.shard(table(spark, sf_dir, "documents"))


def op9_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_prefix.with_encoding(docs, tokenizer(bpe_prefix.VOCABULARY), piece_pattern()).drop("text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.with_whitening(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe_trie.with_token_ids(docs, tokenizer(bpe_trie.VOCABULARY), piece_pattern(), decoded="decoded")
    return found.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, digest = fill_middle.with_fill_middle(docs), lambda c: F.sha2(c.cast("binary"), 256)
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


OP13_SQL = r"""
with docs as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (
  select doc_id, t, regexp_extract_all(t, '[^
]*
|[^
]+') as u, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
         ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from docs),
cut as (select *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from drawn),
parts as (
  select doc_id, t, len(u) as n, array_to_string(list_slice(u, 1, a), '') as p, array_to_string(list_slice(u, a + 1, b), '') as m,
         array_to_string(list_slice(u, b + 1, len(u)), '') as s,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from cut),
made as (
  select *, case form when 'plain' then t when 'psm' then concat('<P>', p, '<S>', s, '<M>', m) else concat('<S>', s, '<P>', p, '<M>', m) end as o from parts)
select doc_id, n::bigint as n, form, case when form != 'plain' then length(p) end::bigint as prefix_chars, case when form != 'plain' then length(m) end::bigint as middle_chars,
       sha256(o) as output_sha256,
       sha256(case form when 'psm' then string_split_regex(o, '<[PSM]>')[2] || string_split_regex(o, '<[PSM]>')[4] || string_split_regex(o, '<[PSM]>')[3]
              when 'spm' then string_split_regex(o, '<[PSM]>')[3] || string_split_regex(o, '<[PSM]>')[4] || string_split_regex(o, '<[PSM]>')[2] else o end) as restored_sha256
from made
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tag_path": op1_tag_path,
    "op2_fm_index": op2_fm_index,
    "op3_secret_ledger": op3_secret_ledger,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_kd_shard": op8_kd_shard,
    "op9_bpe_prefix": op9_bpe_prefix,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_bpe_trie": op12_bpe_trie,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL: dict[str, str] = {"op2_fm_index": OP2_SQL, "op3_secret_ledger": _op3_sql(), "op5_line_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op13_fill_middle": OP13_SQL}
