"""Queries over the views, each with independent SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions import genetic_code as gc
from lociweave.functions.sequences import input_key, nexus_label, partition_name, safe_id, taxon_from_label
from lociweave.operators import codon, concat, frameshift, matrix, normalize, orthogroups, qc, report, sites, trim
from lociweave.plans import views as v
from lociweave.sinks import lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _in(values: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


_count = lambda c: f"sum(length(seq) - length(replace(seq, '{c}', '')))::double"
_fields = "locus, record_order, seq_id"


@query(f"""with {v.NUCL_SQL}
select locus, count(*)::bigint as sequence_count, max(length(seq))::bigint as alignment_length,
       {_count("-")} / sum(length(seq)) as gap_ratio, {_count("?")} / sum(length(seq)) as missing_ratio, {_count("N")} / sum(length(seq)) as n_ratio
from records group by locus""")
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.alignment_summary(v.records(spark, sf_dir))


@query(f"""with {v.NUCL_SQL}, {v.CODONS_SQL}
select locus, sum((codon like '%N%')::int)::double / count(*) as n_ratio from codons group by locus""")
def codon_n_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.alignment_summary(v.records(spark, sf_dir), "codon").select("locus", "n_ratio")


def _site_sql(records: str, states: str) -> str:
    return f"""{records}, {v.CELLS_SQL},
states as (select locus, pos, ch, count(*) as n from cells where contains('{states}', ch) group by all),
resolved as (select locus, pos, count(*) as n_states, sum((n > 1)::int) as n_twice, sum((n = 1)::int) as n_once from states group by all),
columns as (select distinct locus, pos from cells),
cols as (select locus, pos, coalesce(n_states, 0) as n_states, coalesce(n_twice, 0) as n_twice, coalesce(n_once, 0) as n_once
         from columns left join resolved using (locus, pos)),
classes as (
  select locus, sum((n_states <= 1)::int)::bigint as constant_sites, sum((n_states > 1)::int)::bigint as variable_sites,
         sum((n_states > 1 and n_twice > 1)::int)::bigint as parsimony_informative_sites,
         sum((n_states > 1 and n_twice <= 1 and n_once > 0)::int)::bigint as singleton_sites from cols group by locus)"""


@query(f"with {_site_sql(v.NUCL_SQL, 'ACGT')} select * from classes")
def site_classes_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.site_classes_qc(v.records(spark, sf_dir))


@query(f"with {_site_sql(v.PROT_SQL, 'ACDEFGHIKLMNPQRSTVWYOU')} select * from classes")
def site_classes_qc_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.site_classes_qc(v.proteins(spark, sf_dir), "prot")


@query(f"""with {_site_sql(v.NUCL_SQL, "ACGT")}
select locus, sum((n_states = 0)::int)::bigint as unresolved_only, sum((n_states = 1)::int)::bigint as constant, sum((n_states > 1)::int)::bigint as variable,
       sum((n_twice > 1)::int)::bigint as pis, sum((n_states = 2 and n_once > 0)::int)::bigint as singleton from cols group by locus""")
def site_classes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.site_classes_report(v.records(spark, sf_dir))


@query(f"""with {v.NUCL_SQL}, {v.CELLS_SQL}
select locus, count(distinct pattern)::bigint as distinct_patterns
from (select locus, pos, string_agg(ch, '' order by record_order) as pattern from cells group by all) group by locus""")
def distinct_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.distinct_patterns(v.records(spark, sf_dir))


@query(f"""with {v.PROT_SQL}, {v.CELLS_SQL}
select {_fields}, count(*)::bigint as length, sum((ch = '-')::int)::bigint as gap_count, sum((ch = '?')::int)::bigint as missing_count,
       sum((ch = 'N')::int)::bigint as n_count, sum((ch = 'X')::int)::bigint as x_count, '' as invalid,
       sum((ch = '-')::int)::double / count(*) as gap_ratio, sum((ch = '?')::int)::double / count(*) as missing_ratio,
       sum((ch = 'N')::int)::double / count(*) as n_ratio, sum((ch = 'X')::int)::double / count(*) as x_ratio
from cells group by all""")
def sequence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.sequence_stats(v.proteins(spark, sf_dir), "prot")


@query(f"""with {v.NUCL_SQL}, {v.CELLS_SQL},
odd as (select {_fields}, string_agg(distinct ch, '' order by ch) filter (where not contains('ACDEFGHIKLMNPQRSTVWYBXZJUO*?-', ch)) as invalid from cells group by all)
select {_fields}, coalesce(invalid, '') as invalid from odd""")
def invalid_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.sequence_stats(v.records(spark, sf_dir), "prot").select("locus", "record_order", "seq_id", "invalid")


@query(f"""with {v.NUCL_SQL}
select locus, n_name as seq_id, count(*)::bigint as n from (select locus, 'g' || (record_order % 5) as n_name from records) group by all having count(*) > 1""")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.duplicate_ids(v.records(spark, sf_dir).withColumn("seq_id", F.expr("concat('g', record_order % 5)")))


@query(f"""with {v.NUCL_SQL}, {v.CELLS_SQL},
gaps as (select locus, pos, sum((ch = '-')::int)::double / count(*) as g from cells group by all)
select locus, max(g) as max_gap_ratio, sum((g = 1)::int)::bigint as full_gap_columns from gaps group by locus""")
def column_gap_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.column_gaps(v.records(spark, sf_dir))


@query(f"""with {v.CODON_SQL}, {v.CODONS_SQL}
select locus, sum(valid::int)::bigint as valid_sites
from (select locus, site, bool_and(not regexp_matches(codon, '[-?]')) as valid from codons group by all) group by locus""")
def valid_codon_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.valid_codon_sites(v.codon_records(spark, sf_dir))


_STOPS_SQL = f"""{v.CODONS_SQL},
marked as (select *, codon in {_in(gc.stop_codons(1))} as stop, max(site) over (partition by {_fields}) as last from codons where codon not in ('---', '???')),
stops as (
  select {_fields}, max(codon) filter (where stop and site = last) as terminal_stop,
         string_agg(site || '-' || codon, ';' order by site) filter (where stop and site < last) as internal_stops
  from marked group by all having sum(stop::int) > 0)"""


@query(f"with {v.NUCL_SQL}, {_STOPS_SQL} select * from stops")
def stop_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.stop_findings(v.records(spark, sf_dir), "codon")


GATE = qc.Gate("codon", min_length=20, max_n_ratio=0.1, max_gap_ratio=0.08, min_informative=40)
_GATE_SQL = f"""{_site_sql(v.NUCL_SQL, "ACGT")}, {_STOPS_SQL},
summary as (
  select locus, count(*)::bigint as sequence_count, max(length(seq))::bigint as alignment_length, {_count("-")} / sum(length(seq)) as gap_ratio,
         {_count("?")} / sum(length(seq)) as missing_ratio from records group by locus),
n as (select locus, sum((codon like '%N%')::int)::double / count(*) as n_ratio, bool_or(codon like '%-%' and codon != '---') as frame from codons group by locus),
full_gaps as (select locus, bool_or(g) as any_full from (select locus, pos, bool_and(ch = '-') as g from cells group by all) group by locus),
ended as (select locus, bool_or(terminal_stop is not null) as t, bool_or(internal_stops is not null) as i from stops group by locus),
tested as (
  select summary.*, n_ratio, constant_sites, variable_sites, parsimony_informative_sites, singleton_sites, list_sort(list_filter([
    case when n_ratio > {GATE.max_n_ratio} then 'N_ratio' end, case when any_full then 'all_gap_columns' end, case when frame then 'frame_error' end,
    case when gap_ratio > {GATE.max_gap_ratio} then 'gap_ratio' end, case when coalesce(i, false) then 'internal_stop' end,
    case when parsimony_informative_sites < {GATE.min_informative} then 'parsimony_informative_sites' end,
    case when alignment_length // 3 < {GATE.min_length} then 'short_alignment' end, case when coalesce(t, false) then 'terminal_stop' end], lambda x: x is not null)) as list
  from summary join n using (locus) join full_gaps using (locus) join classes using (locus) left join ended using (locus)),
gate as (select * exclude (list), array_to_string(list, ';') as reasons, len(list) = 0 as passed from tested)"""


@query(f"with {_GATE_SQL} select * from gate")
def qc_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.qc_gate(v.records(spark, sf_dir), GATE)


@query(f"""with {_GATE_SQL}, failed as (select *, string_split(reasons, ';') as list from gate where not passed)
select kind, name, count(*)::bigint as n from (
  select 'status' as kind, case when passed then 'passed' else 'failed' end as name from gate
  union all select 'reason', unnest(list) from failed
  union all select 'combination', replace(reasons, ';', ' + ') from failed
  union all select 'multiplicity', len(list)::varchar from failed) group by all""")
def qc_reason_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.reason_rollup(qc.qc_gate(v.records(spark, sf_dir), GATE))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, p = sites.site_classes_qc(v.records(spark, sf_dir), "codon"), sites.site_classes_qc(v.proteins(spark, sf_dir), "prot")
    return c.withColumn("passed", F.col("locus") % 7 != 0), p.withColumn("passed", F.col("locus") % 5 != 0)


@query(f"""with {_site_sql(v.NUCL_SQL, "ACGT")}, c as (select * from classes),
p as (with {_site_sql(v.PROT_SQL, "ACDEFGHIKLMNPQRSTVWYOU")} select * from classes)
select locus, locus % 7 != 0 as codon_passed, c.parsimony_informative_sites as codon_pis, locus % 5 != 0 as protein_passed,
       p.parsimony_informative_sites as protein_pis,
       locus % 7 != 0 and locus % 5 != 0 and (c.parsimony_informative_sites >= 60 or p.parsimony_informative_sites >= 30) as paired_passed
from c join p using (locus)""")
def paired_pis_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.paired_decision(*_sides(spark, sf_dir), policy="either", min_codon=60, min_protein=30)


@query(f"""with {v.NUCL_SQL}, {v.CELLS_SQL},
ok as (select {_fields} from cells group by all having count(*) >= 60 and sum((ch = '-')::int)::double / count(*) <= 0.1 and sum((ch = 'N')::int)::double / count(*) <= 0.08)
select records.* from records semi join ok using ({_fields}) where seq_id not in ('sp3')""")
def filter_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = v.nations(spark, sf_dir).where("original_id = 'sp3'").select(F.col("original_id").alias("seq_id"))
    return trim.filter_sequences(v.records(spark, sf_dir), "nucl", min_length=60, max_gap=0.1, max_n=0.08, remove=gone)


def _masked(records: str, units: str, unit: str, pos: str, keep: str) -> str:
    return f"""with {records}, {units}, mask as (select locus, {pos} from {"codons" if unit == "codon" else "cells"} group by all having {keep})
select {_fields}, string_agg({unit}, '' order by {pos}) as seq from {"codons" if unit == "codon" else "cells"} semi join mask using (locus, {pos}) group by all"""


@query(_masked(v.NUCL_SQL, v.CELLS_SQL, "ch", "pos", "not bool_and(ch in ('N', '-'))"))
def drop_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.drop_missing_columns(v.records(spark, sf_dir))


@query(_masked(v.NUCL_SQL, v.CELLS_SQL, "ch", "pos", "sum((ch = '-')::int)::double / count(*) <= 0.125 and sum((ch = 'N')::int)::double / count(*) <= 0.125"))
def trim_sites_nucl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.trim(v.records(spark, sf_dir), "nucl", max_gap=0.125, max_n=0.125)


@query(_masked(v.NUCL_SQL, v.CODONS_SQL, "codon", "site", "sum((codon like '%-%')::int)::double / count(*) <= 0.2 and sum((codon like '%N%')::int)::double / count(*) <= 0.2"))
def trim_sites_codon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.trim(v.records(spark, sf_dir), "codon")


@query(_masked(v.PROT_SQL, v.CELLS_SQL, "ch", "pos", "sum((ch = '-')::int)::double / count(*) <= 0.5 and sum((ch = 'X')::int)::double / count(*) <= 0.5 and min(ch) != max(ch)"))
def trim_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.trim(v.proteins(spark, sf_dir), "prot", max_gap=0.5, max_x=0.5, drop_invariant=True)


@query(f"""with {v.CODON_SQL}, {v.CODONS_SQL}, prot as (with {v.PROT_SQL}, {v.CELLS_SQL} select * from cells),
mask as (select c.locus, site from codons c join prot p on c.locus = p.locus and c.record_order = p.record_order and c.seq_id = p.seq_id and site = pos group by all
  having sum((ch = '-' or codon like '%-%')::int)::double / count(*) <= 0.2 and sum((codon like '%N%')::int)::double / count(*) <= 0.2 and sum((ch = 'X')::int)::double / count(*) <= 0.1)
select {_fields}, string_agg(codon, '' order by site) as seq from codons semi join mask using (locus, site) group by all""")
def trim_paired_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.trim_pair(v.codon_records(spark, sf_dir), v.proteins(spark, sf_dir), max_x=0.1)[0]


@query(f"with {v.NUCL_SQL} select locus, record_order, coalesce(n_name, seq_id) as seq_id, seq from records left join nation on seq_id = 'sp' || n_nationkey and n_nationkey < 5")
def rename_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = v.nations(spark, sf_dir).where("cast(substr(original_id, 3) as int) < 5")
    return trim.rename(v.records(spark, sf_dir), few)


@query(f"with {v.RAW_SQL} select {_fields}, translate(upper(seq), 'URYSWKMBDHV?', 'TNNNNNNNNNNN') as seq from records")
def normalize_nucl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.clean_nucl(v.records(spark, sf_dir, v.RAW))


_BASE_EVENT = f"""select {_fields}, case when upper(ch) = 'U' then 'uracil_to_thymine' else 'nucleotide_ambiguity' end as event, pos::int as "start", pos::int as "end",
  ch as original, case when upper(ch) = 'U' then 'T' else 'N' end as replacement, 'replace' as action from cells where contains('URYSWKMBDHV?', upper(ch))"""


@query(f"with {v.RAW_SQL}, {v.CELLS_SQL} {_BASE_EVENT}")
def normalize_nucl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.nucl_events(v.records(spark, sf_dir, v.RAW))


_PRE_SQL = f"""{v.RAW_SQL}, {v.CODONS_SQL}, {v.CELLS_SQL},
tested as (select *, translate(upper(codon), 'U', 'T') as up, max(site) over (partition by {_fields}) as last from codons),
marked as (select *, case when site = last then up in {_in(gc.stop_codons(1, True))} else up in {_in(gc.stop_codons(1))} end as stop from tested)"""


@query(f"""with {_PRE_SQL},
fixed as (select {_fields}, string_agg(case when stop and site = last then '' when stop then 'NNN' else translate(up, 'RYSWKMBDHV?', 'NNNNNNNNNNN') end, '' order by site) as seq from marked group by all)
select * from fixed anti join (select locus from fixed where seq = '') using (locus)""")
def preprocess_codon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.clean_codon(v.records(spark, sf_dir, v.RAW))


@query(f"""with {_PRE_SQL},
base as (select cells.* from cells join marked m using ({_fields}) where (pos - 1) // 3 + 1 = site and not stop)
select {_fields}, case when site = last then 'terminal_stop' else 'internal_stop' end as event, (3 * site - 2)::int as "start", (3 * site)::int as "end", codon as original,
       case when site = last then '-' else 'NNN' end as replacement, case when site = last then 'delete' else 'replace' end as action from marked where stop
union all {_BASE_EVENT.replace("from cells", "from base")}
union all select {_fields}, 'validation_error', null, null, 'NA', 'NA', 'skip' from marked where last = 1 and stop""")
def preprocess_codon_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.codon_events(v.records(spark, sf_dir, v.RAW))


@query(f"with {v.RAW_SQL} select {_fields}, translate(translate(upper(seq), 'URYSWKMBDHV', 'TNNNNNNNNNN'), 'T', 'U') as seq from records")
def rna_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.clean_rna(v.records(spark, sf_dir, v.RAW))


@query(f"""with {v.RAW_SQL}, {v.CELLS_SQL}
select {_fields}, case when upper(ch) = 'T' then 'thymine_to_uracil' else 'nucleotide_ambiguity' end as event, pos::int as "start", pos::int as "end",
  ch as original, case when upper(ch) = 'T' then 'U' else 'N' end as replacement, 'replace' as action from cells where contains('TRYSWKMBDHV', upper(ch))""")
def rna_export_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.rna_events(v.records(spark, sf_dir, v.RAW))


_P_END = "length(rtrim(seq, '*-'))"


@query(f"""with {v.PROT_SQL} select {_fields}, regexp_replace(substr(seq, 1, {_P_END}), '[^ACDEFGHIKLMNPQRSTVWYX-]', 'X', 'g') || replace(substr(seq, {_P_END} + 1), '*', '') as seq
from records where {_P_END} > 0""")
def preprocess_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.clean_protein(v.proteins(spark, sf_dir))


@query(f"""with {v.PROT_SQL}, {v.CELLS_SQL}, ends as (select {_fields}, {_P_END} as e from records),
both_ as (select * from cells join ends using ({_fields}))
select {_fields}, case when ch = '*' and pos > e then 'protein_terminal_stop' when ch = '*' then 'protein_internal_stop' else 'protein_unsupported_residue' end as event,
       pos::int as "start", pos::int as "end", ch as original, case when ch = '*' and pos > e then '-' else 'X' end as replacement,
       case when ch = '*' and pos > e then 'delete' else 'replace' end as action from both_ where e > 0 and not contains('ACDEFGHIKLMNPQRSTVWYX-', ch)
union all select {_fields}, 'validation_error', null, null, 'NA', 'NA', 'reject' from ends where e = 0""")
def preprocess_protein_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.protein_events(v.proteins(spark, sf_dir))


@query(f"with {v.PROT_SQL} select {_fields}, regexp_replace(upper(seq), '[^ACDEFGHIKLMNPQRSTVWYX?-]', 'X', 'g') as seq from records")
def normalize_export_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.clean_export(v.proteins(spark, sf_dir), protein=True)


_RESIDUES = ", ".join(f"('{c}', '{a}')" for c, a in gc.translations(1).items())
_AA_SQL = f"""code(codon, aa) as (values {_RESIDUES}),
aas as (select {_fields}, site, case when site = 1 and codon in {_in(sorted(gc.code(1)[2]))} then 'M' when codon = '---' then '-' else coalesce(aa, 'X') end as aa from codons left join code using (codon))"""


@query(f"with {v.CODON_SQL}, {v.CODONS_SQL}, {_AA_SQL} select {_fields}, string_agg(aa, '' order by site) as seq from aas group by all")
def translate_cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codon.translate_cds(v.codon_records(spark, sf_dir))


@query(f"""with {v.CODON_SQL}, {v.CODONS_SQL},
placed as (select {_fields}, codon, site + (site - 1) // 4 as pos from codons),
gaps as (select {_fields}, '---' as codon, 5 * k as pos from (select *, unnest(range(1, length(seq) // 12 + 1)) as k from records))
select {_fields}, string_agg(codon, '' order by pos) as seq from (select * from placed union all select * from gaps) group by all""")
def back_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cds = v.codon_records(spark, sf_dir)
    # a gap after every fourth residue
    aligned = codon.translate_cds(cds).withColumn("seq", F.regexp_replace("seq", "(?s)(....)", "$1-"))
    return codon.back_translate(aligned, cds)


@query(f"""with {v.NUCL_SQL}, {v.CELLS_SQL}
select {_fields}, ((pos - 1) % 3 + 1)::int as codon_position, string_agg(ch, '' order by pos) as seq from cells group by all""")
def split_codon_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codon.split_codon_positions(v.records(spark, sf_dir))


def _fourfold_sql(policy: str) -> str:
    counts, least = ("codon != '???'", 2) if policy == "ignore-missing" else ("true", 1)
    keep = f"""bool_and(codon in {_in(gc.fourfold_codons(1))} or not ({counts})) and min(substr(codon, 1, 2)) filter (where {counts}) = max(substr(codon, 1, 2)) filter (where {counts})
  and sum(({counts})::int) >= {least}"""
    return f"""with {v.CODON_SQL}, {v.CODONS_SQL}, mask as (select locus, site from codons group by all having {keep})
select {_fields}, coalesce(kept.seq, '') as seq from records left join
  (select {_fields}, string_agg(substr(codon, 3, 1), '' order by site) as seq from codons semi join mask using (locus, site) group by all) kept using ({_fields})"""


@query(_fourfold_sql("ignore-missing"))
def fourfold_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codon.fourfold_sites(v.codon_records(spark, sf_dir))


@query(_fourfold_sql("require-all"))
def fourfold_sites_require_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codon.fourfold_sites(v.codon_records(spark, sf_dir), policy="require-all")


@query(f"""with {v.PAIRS_SQL}, {v.CODONS_SQL},
pairs as (
  select x.locus, substr(x.codon, 3, 1) as x, substr(y.codon, 3, 1) as y from codons x join codons y using (locus, site)
  where x.record_order = 0 and y.record_order = 1 and x.codon in {_in(gc.fourfold_codons(1))} and y.codon in {_in(gc.fourfold_codons(1))} and substr(x.codon, 1, 2) = substr(y.codon, 1, 2)),
s as (select locus, count(*) as n, sum((x in ('A', 'G') != (y in ('A', 'G')))::int) as tv, {", ".join(f"0.5 * sum((x = '{b}')::int + (y = '{b}')::int)::double / count(*) as f{b}" for b in "ACGT")} from pairs group by locus),
k as (select *, tv::double / n as raw, fT + fC as fY, fA + fG as fR from s),
m as (select *, fT * fC * fR / fY + fA * fG * fY / fR as w, fT * fC * fR + fA * fG * fY as d from k where fA > 0 and fC > 0 and fG > 0 and fT > 0),
f as (select locus, raw, w, fY, fR, fT, fC, fA, fG, 1 - raw * w / (2 * d) as one, 1 - raw / (2 * fY * fR) as two from m),
c as (select locus, -2 * ln(one) * (fT * fC / fY + fA * fG / fR) + 2 * ln(two) * (w - fY * fR) as corrected from f where one > 0 and two > 0)
select locus, sequence1, sequence2, round(corrected, 9) + 0.0 as corrected_4dtv, raw as raw_4dtv, coalesce(n, 0)::bigint as sites, coalesce(tv, 0)::bigint as transversions
from (select locus, max(seq_id) filter (where record_order = 0) as sequence1, max(seq_id) filter (where record_order = 1) as sequence2 from records group by locus having max(length(seq)) > 0)
left join k using (locus) left join c using (locus)""")
def pairwise_4dtv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codon.pairwise_4dtv(v.codon_pairs(spark, sf_dir))


@query(f"""with {v.CODON_SQL} select locus, 'not two sequences' as fault from records group by locus having count(*) != 2
union all (with {v.PAIRS_SQL} select locus, case when max(length(seq)) = 0 then 'empty sequence' when max(length(seq)) % 3 != 0 then 'not whole triplets' end from records
  group by locus having max(length(seq)) = 0 or max(length(seq)) % 3 != 0)""")
def pair_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codon.pair_faults(v.codon_records(spark, sf_dir)).unionByName(codon.pair_faults(v.codon_pairs(spark, sf_dir)))


def _concat_sql(policy: str) -> str:
    keep = "true" if policy == "pad-gaps" else "n_missing = 0"
    return f"""{v.OCCUPIED_SQL},
taxa as (select seq_id as taxon, min(locus * 100 + record_order) as first from records group by seq_id),
loci as (select locus, max(length(seq))::bigint as length from records group by locus),
absent as (select locus, taxon, first from loci cross join taxa anti join records on records.locus = loci.locus and records.seq_id = taxa.taxon),
loci_n as (select locus, length, (select count(*) from absent a where a.locus = loci.locus) as n_missing from loci),
parts as (select locus, length, n_missing, (sum(length) over (order by locus))::bigint as "end", (sum(length) over (order by locus) - length + 1)::bigint as "start" from loci_n where {keep}),
blocks as (select locus, taxon, "start", "end", length, '?' as fill_character from absent join parts using (locus))"""


@query(f"""with {_concat_sql("pad-gaps")}
select seq_id as taxon, locus, "start", "end", seq as fragment from records join parts using (locus)
union all select taxon, locus, "start", "end", repeat('?', length) from blocks""")
def supermatrix_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.supermatrix(v.occupied_records(spark, sf_dir))


@query(f"""with {_concat_sql("skip-gene")} select seq_id as taxon, locus, "start", "end", seq as fragment from records join parts using (locus)""")
def supermatrix_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.supermatrix(v.occupied_records(spark, sf_dir), "skip-gene")


@query(f"""with {_concat_sql("pad-gaps")} select locus, "start", "end", length from parts""")
def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.partitions(v.occupied_records(spark, sf_dir)).drop("missing")


@query(f"""with {_concat_sql("pad-gaps")} select * from blocks""")
def missing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.missing_blocks(v.occupied_records(spark, sf_dir))


@query(f"""with {_concat_sql("pad-gaps")}
select taxon, ((select count(*) from parts) - count(blocks.locus))::bigint as observed_loci, (select count(*) from parts)::bigint as total_loci,
       coalesce(sum(length), 0)::bigint as artificial_characters from taxa left join blocks using (taxon) group by taxon""")
def taxon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.coverage(v.occupied_records(spark, sf_dir))


@query(f"""with {_concat_sql("skip-gene")}
select locus, length, case when n_missing = 0 then 'included' else 'skipped' end as status,
       coalesce((select string_agg(taxon, ', ' order by first) from absent where absent.locus = loci_n.locus), '') as missing from loci_n""")
def inclusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.inclusion(v.occupied_records(spark, sf_dir), "skip-gene").withColumn("missing", F.array_join("missing", ", "))


@query(f"""with {_concat_sql("pad-gaps")}, {v.CELLS_SQL},
sites as (select locus, pos from cells group by all having sum((ch = '-')::int)::double / count(*) <= 0 and sum((ch = 'N')::int)::double / count(*) <= 0.125 and min(ch) != max(ch)),
trimmed as (select locus, count(*)::bigint as length from sites group by locus)
select sum((r.length is not null and t.length is not null)::int)::bigint as common, sum((t.length is null)::int)::bigint as raw_only, sum((r.length is null)::int)::bigint as trimmed_only,
       (sum(r.length) filter (where t.length is not null))::bigint as raw_columns, (sum(t.length) filter (where r.length is not null))::bigint as trimmed_columns
from parts r full join trimmed t using (locus)""")
def raw_vs_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = v.occupied_records(spark, sf_dir)
    cut = trim.trim(raw, "nucl", max_gap=0, max_n=0.125, drop_invariant=True)
    return concat.raw_and_trimmed(concat.partitions(raw).select("locus", "length"), concat.partitions(cut).select("locus", "length"))


TAXA = [f"t{k}" for k in range(10)]


@query(f"""with {v.MEMBERS_SQL} select orthogroup as "Orthogroup", {", ".join(f"coalesce(string_agg(gene, ', ' order by gene) filter (where taxon = '{t}'), '') as {t}" for t in TAXA)} from members group by orthogroup""")
def og_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orthogroups.to_wide(v.members(spark, sf_dir), TAXA)


@query(f"with {v.MEMBERS_SQL} select orthogroup, taxon, gene from members")
def og_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = orthogroups.to_wide(v.members(spark, sf_dir), TAXA)
    return orthogroups.from_wide(wide, "Orthogroup", TAXA)


def _og(having: str, extra: str = "") -> str:
    return f"""with {v.MEMBERS_SQL}, n as (select orthogroup, taxon, count(*) as n from members group by all)
select orthogroup, {having} as occupied from n group by orthogroup having {having} >= 3 {extra}"""


@query(_og("sum((n = 1)::int)::bigint"))
def og_occupancy_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orthogroups.occupancy(v.members(spark, sf_dir), "single-copy", 3)


@query(_og("count(*)::bigint"))
def og_occupancy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orthogroups.occupancy(v.members(spark, sf_dir), "all-copies", 3)


@query(_og("count(*)::bigint", "and max(n) <= 2"))
def og_copy_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orthogroups.occupancy(v.members(spark, sf_dir), "all-copies", 3, max_copies=2)


@query(f"""with {v.MEMBERS_SQL} select orthogroup, taxon, gene, effective_length, n::bigint as n from (
  select *, count(*) over (partition by orthogroup, taxon) as n, row_number() over (partition by orthogroup, taxon order by effective_length desc, gene) as k from members) where k = 1""")
def og_longest_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orthogroups.longest_copy(v.members(spark, sf_dir))


@query(f"""with {v.MEMBERS_SQL} select case when orthogroup % 4 = 0 then 'prefixed' else 'unprefixed' end as style, count(*)::bigint as n from members group by all""")
def og_id_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = v.members(spark, sf_dir).withColumn("gene", F.expr("case when orthogroup % 4 = 0 then concat(taxon, '_', gene) else gene end"))
    return orthogroups.id_styles(named)


_AUDIT_SQL = f"""{v.EDITS_SQL}, d as (select distinct * from edits),
e as (select *, case when taxa_id = 'NA' then 'Unassigned' else taxa_id end as taxon,
      case when source_nt_positions != 'NA' and split_part(source_nt_positions, '-', 1)::bigint > 0
           then split_part(source_nt_positions, '-', 2)::bigint - split_part(source_nt_positions, '-', 1)::bigint + 1 end as nt from d)"""


@query(f"""with {_AUDIT_SQL} select taxon, count(*)::bigint as events, (count(distinct input_file) filter (where taxon != 'Unassigned'))::bigint as affected_sequences, sum(nt)::bigint as nt_characters,
null::bigint as aa_characters, sum((nt is null)::int)::bigint as events_without_coordinates from e group by taxon""")
def audit_by_taxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audit_by_taxon(v.edits(spark, sf_dir))


@query(f"with {_AUDIT_SQL} select event, action, count(*)::bigint as n from d group by all")
def audit_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audit_by_type(v.edits(spark, sf_dir))


@query(f"with {_AUDIT_SQL} select taxon, event, count(*)::bigint as n from e group by all")
def audit_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audit_cross(v.edits(spark, sf_dir))


@query(f"""with {v.EDITS_SQL} select (select count(*) from edits)::bigint as "rows", count(*)::bigint as events, ((select count(*) from edits) - count(*))::bigint as duplicates from (select distinct * from edits)""")
def audit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.duplicates_ignored(v.edits(spark, sf_dir))


@query(f"""with {v.EDITS_SQL} select input_file, taxa_id, event, action, source_nt_positions, 'NA' as source_aa_positions from edits
union all select input_file, taxa_id, event, action, 'NA', source_nt_positions from edits where event = 'error'""")
def change_report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.edits(spark, sf_dir)
    return report.merge_events(e, e.where("event = 'error'").withColumnRenamed("source_nt_positions", "source_aa_positions"))


@query(f"with {v.EDITS_SQL} select edits.*, coalesce(n_name, 'NA') as mapped_taxa_id from edits left join nation on taxa_id = 'taxon' || n_nationkey")
def audit_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = v.nations(spark, sf_dir).withColumn("original_id", F.expr("concat('taxon', substr(original_id, 3))"))
    return report.annotate(v.edits(spark, sf_dir), names)


@query(f"""with {_PRE_SQL} select locus, seq_id, case when site = last then 'terminal' else 'internal' end as category, string_agg((3 * site - 2) || '-' || codon, ';' order by site) as note from marked where stop group by all""")
def stop_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.provenance(normalize.codon_events(v.records(spark, sf_dir, v.RAW)))


@query(f"""with {v.NUCL_SQL} select locus, line_no, line from (
  select locus, 0::bigint as line_no, count(*) || ' ' || max(length(seq)) as line from records group by locus
  union all select locus, record_order::bigint + 1, seq_id || '  ' || seq from records)""")
def matrix_phylip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.phylip(v.records(spark, sf_dir))


@query(f"""with {v.NUCL_SQL} select locus, block::bigint as block, record_order, rpad(seq_id, 3, ' ') || ' ' || substr(seq, (70 * block + 1)::int, 70) as line
from (select *, unnest(range((length(seq) + 69) // 70)) as block from records)""")
def nexus_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.nexus_blocks(v.records(spark, sf_dir))


@query(f"""with {v.NUCL_SQL} select locus, record_order, '>' || seq_id || chr(10) || seq as text from records""")
def fasta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fasta(v.records(spark, sf_dir))


@query(f"""with {_concat_sql("pad-gaps")} select locus, '    charset ' || 'gene_' || locus || '_fasta = ' || "start" || '-' || "end" || ';' as line from parts""")
def charset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = concat.partitions(v.occupied_records(spark, sf_dir))
    return lines.charsets(parts, partition_name(F.concat(F.lit("gene/"), F.col("locus"), F.lit(".fasta"))))


@query(f"""with {v.PAIRS_SQL} select locus, '>' || max(seq_id) filter (where record_order = 0) || '|' || max(seq_id) filter (where record_order = 1) || chr(10)
  || max(seq) filter (where record_order = 0) || chr(10) || max(seq) filter (where record_order = 1) as text from records group by locus""")
def axt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.axt(v.codon_pairs(spark, sf_dir))


#: Codon records in which some codons miss a base or are stops.
_SHIFTED_SQL = f"""{v.CODON_SQL.replace("records as (", "plain as (")},
records as (select * replace (replace(replace(seq, 'CAT', 'TAA'), 'GGA', 'G!A') as seq) from plain), {v.CODONS_SQL}"""


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.codon_records(spark, sf_dir).withColumn("seq", F.expr("replace(replace(seq, 'CAT', 'TAA'), 'GGA', 'G!A')"))


_FRAMES_SQL = f"""{_SHIFTED_SQL},
ends as (select {_fields}, min(site) as first, max(site) as last from codons where codon != '---' group by all),
marked as (select codons.*, case when contains(codon, '!') then case when site in (first, last) then 'external_frameshift' else 'internal_frameshift' end
    when site = last and codon in {_in(gc.stop_codons(1, True))} then 'terminal_stop' when site < last and codon in {_in(gc.stop_codons(1))} then 'internal_stop' end as event
  from codons left join ends using ({_fields}))"""


@query(f"""with {_FRAMES_SQL} select {_fields}, event, (3 * site - 2)::int as "start", (3 * site)::int as "end", codon as original from marked where event is not null""")
def frame_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frameshift.frame_findings(_shifted(spark, sf_dir))


@query(f"""with {_FRAMES_SQL} select {_fields}, string_agg(case when event is null then translate(codon, '?', 'N') else 'NNN' end, '' order by site) as seq from marked group by all""")
def frameshift_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frameshift.masked(_shifted(spark, sf_dir))


@query(f"""with {_FRAMES_SQL} select {_fields}, coalesce(event, 'export_change') as event, (3 * site - 2)::int as "start", (3 * site)::int as "end", codon as original,
  'NNN' as replacement, 'replace' as action from marked where event is not null or codon = '???'""")
def frameshift_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _shifted(spark, sf_dir)
    return frameshift.triplet_edits(before, frameshift.masked(before))


@query(f"""with {v.CODON_SQL}, {v.CODONS_SQL}, prot as (with {v.PROT_SQL}, {v.CELLS_SQL} select * from cells)
select {_fields}, string_agg(case when contains('ACDEFGHIKLMNPQRSTVWYX-', ch) then codon else 'NNN' end, '' order by site) as seq
from codons c join prot p using ({_fields}) where site = pos group by all""")
def masked_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frameshift.masked_pair(v.codon_records(spark, sf_dir), v.proteins(spark, sf_dir))[0]


@query(f"""with {v.PROT_SQL}, {v.CELLS_SQL}, mask as (select locus, pos from cells group by all having bool_or(ch in ('A', 'L')))
select {_fields}, string_agg(ch, '' order by pos) as seq from cells semi join mask using (locus, pos) group by all""")
def transferred_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.proteins(spark, sf_dir)
    kept = p.select("locus", F.posexplode(F.split("seq", "")).alias("pos", "ch")).where("ch in ('A', 'L')")
    return trim.transfer_columns(p, kept.select("locus", (F.col("pos") + 1).alias("pos")).distinct(), "prot")


@query(f"""with {_concat_sql("pad-gaps")},
m as (select locus, seq as fragment from records join parts using (locus) union all select locus, repeat('?', length) from blocks),
cells as (select locus, unnest(string_split(fragment, '')) as ch, unnest(range(1, length(fragment) + 1)) as pos from m),
counted as (select locus, pos, ch, count(*) as n from cells group by all),
cols as (select locus, pos, sum((contains('ACGT', ch))::int) as k, sum((contains('ACGT', ch) and n > 1)::int) as twice, sum((contains('ACGT', ch) and n = 1)::int) as once from counted group by all),
classes as (select sum((k = 0)::int)::bigint as unresolved_only, sum((k = 1)::int)::bigint as constant, sum((k > 1)::int)::bigint as variable, sum((twice > 1)::int)::bigint as pis,
  sum((k = 2 and once > 0)::int)::bigint as singleton from cols),
chars as (select sum(n)::bigint as cells, (sum(n) filter (where ch = '-'))::bigint as g, (sum(n) filter (where ch = '?'))::bigint as q,
  (sum(n) filter (where not contains('ACGT-?', ch)))::bigint as a, (sum(n) filter (where ch in ('G', 'C')))::double / sum(n) filter (where contains('ACGT', ch)) as gc_ratio from counted)
select (select count(*) from taxa)::bigint as taxa, (select count(*) from parts)::bigint as loci, (select sum(length) from parts)::bigint as length, cells,
  (select case when sum(length) % 3 = 0 then sum(length) // 3 end from parts)::bigint as complete_codons, g as gap_characters, q as missing_characters, a as ambiguous_characters,
  g::double / cells as gap_ratio, q::double / cells as missing_ratio, a::double / cells as ambiguous_ratio, gc_ratio, classes.* from chars, classes""")
def matrix_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.matrix_statistics(v.occupied_records(spark, sf_dir), "pad-gaps", "codon")


@query(f"""with {_concat_sql("pad-gaps")} select case when n_missing = 0 then 'included' else 'padded' end as status, count(*)::bigint as n from loci_n group by all""")
def inclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.inclusion_counts(concat.inclusion(v.occupied_records(spark, sf_dir)))


_FILE_NAMES_SQL = r"""
with files as (select url as path, regexp_extract(url, '([^/\\]*)$', 1) as name from pages),
stems as (select path, regexp_replace(name, '(.)\.[^.]*$', '\1') as stem from files)
select path, stem as taxon, stem || '_' || substr(sha256(path), 1, 10) as input_key, translate(path, ':,()', '____') as safe_id,
  case when regexp_matches(path, '[\s()\[\]{}/\\,;:=*''"`+<>-]') then chr(39) || replace(path, chr(39), chr(39) || chr(39)) || chr(39) else path end as nexus_label
from stems"""


@query(_FILE_NAMES_SQL)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    names = v.table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return names.select("path", taxon_from_label(path).alias("taxon"), input_key(path).alias("input_key"), safe_id(path).alias("safe_id"), nexus_label(path).alias("nexus_label"))


@query(f"""with {v.NUCL_SQL}, {v.PROT_SQL.replace("dealt as", "dealt2 as").replace("from dealt)", "from dealt2)").replace("records as (select", "prot as (select")}
select {_fields}, length(regexp_replace(n.seq, '[^ACGTU]', '', 'g'))::int as nucl, length(regexp_replace(p.seq, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'))::int as prot from records n join prot p using ({_fields})""")
def effective_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = v.records(spark, sf_dir).select("locus", "record_order", "seq_id", orthogroups.effective_length(F.col("seq")).alias("nucl"))
    p = v.proteins(spark, sf_dir).select("locus", "record_order", "seq_id", orthogroups.effective_length(F.col("seq"), "prot").alias("prot"))
    return n.join(p, ["locus", "record_order", "seq_id"])


@query(f"""with {_GATE_SQL}, rows_ as (select lang as branch, gate.locus, reasons, case when n_chars % 3 = 0 then 'pass' when n_chars % 3 = 1 then 'fail' else 'not_evaluated' end as status,
    case when reasons = '' then ['failure_reason_not_recorded'] else string_split(reasons, ';') end as list from gate join documents on doc_id = gate.locus),
failed as (select * from rows_ where status = 'fail')
select branch, kind, name, count(*)::bigint as n from (
  select branch, 'status' as kind, status as name from rows_ union all select branch, 'reason', unnest(list) from failed
  union all select branch, 'combination', array_to_string(list, ' + ') from failed union all select branch, 'multiplicity', len(list)::varchar from failed) group by all""")
def qc_branch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = v.table(spark, sf_dir, "documents").selectExpr("doc_id as locus", "lang as branch", "n_chars % 3 as list")
    details = qc.qc_gate(v.records(spark, sf_dir), GATE).select("locus", "reasons", "parsimony_informative_sites", F.lit("codon").alias("seqtype")).join(branch, "locus")
    listed = [branch.where(F.col("list") == k).select("branch", "locus") for k in (0, 1)]
    return report.branch_rollup(report.branch_status(details, *listed))


@query(f"with {_GATE_SQL} select sum((list_contains(string_split(reasons, ';'), 'internal_stop'))::int)::bigint as stopped, count(*)::bigint as loci from gate")
def internal_stop_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.internal_stop_hint(qc.qc_gate(v.records(spark, sf_dir), GATE))


@query("""select (select count(*) from pages)::bigint as input_loci, count(distinct doc_id)::bigint as aligned_loci from documents""")
def processing_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = v.table(spark, sf_dir, "documents").selectExpr("explode(array(concat('out/', doc_id, '.mafft.codon.aln.fasta'), concat('out/', doc_id, '.muscle.prot.trimmed.aln.fasta'))) as path")
    return report.overview(v.table(spark, sf_dir, "pages").select(F.col("url").alias("path")), listed)


@query(f"with {v.EDITS_SQL} select edits.* replace (case when input_file in ('file1', 'file2') then 'new/' || input_file else 'old/x/' || input_file end as input_file) from edits")
def audit_relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.edits(spark, sf_dir)
    placed = e.withColumn("input_file", F.expr("concat(case when input_file in ('file1', 'file2') then 'old/' else 'old/x/' end, input_file)"))
    return report.relocate(placed, "old", "new")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc_gate(spark, sf_dir)

