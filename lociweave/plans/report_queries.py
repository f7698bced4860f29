"""Queries over reports, exports and checks of files, each with independent SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions.ordered import leading
from lociweave.operators import concat, normalize, orthoset, paired, provenance, resolve
from lociweave.operators.details import qc_details
from lociweave.plans import views as v
from lociweave.plans.queries import _BASE_EVENT, _GATE_SQL, _PRE_SQL, GATE, ORACLE_SQL, QUERIES, _concat_sql, _sides, _site_sql, query
from lociweave.sinks import export, reports, stream
from lociweave.sources import snapshot, spool

#: Reports of branches made from documents (rows of details), labels (lists of paths) and every third document (rows of paired reports).
_ROW = """doc_id as "row", coalesce(lang, 'xx') as lang, case when doc_id % 10 < 2 then 'pseudogene/' else '' end as inside,
  case when doc_id % 2 = 0 then 'codon' else 'prot' end as seqtype, '/out/' || coalesce(source, '') || '/locus' || {locus} || '.fasta' as file, n_chars % 400 as parsimony_informative_sites,
  case n_chars % 5 when 0 then 'short_alignment;gap_ratio' when 1 then 'NA' when 2 then '' when 3 then 'internal_stop;;gap_ratio;internal_stop' end as issues"""
_SQL_ROW = _ROW.format(locus="(doc_id // 8)")
REPORTS_SQL = f"""
rows_ as (select {_SQL_ROW}, doc_id, n_chars from documents),
details as (select inside || seqtype || '/' || lang as branch, * exclude (lang, inside, doc_id, n_chars), regexp_extract(file, '[^/]*$') as locus from rows_),
lists as (
  select branch, case when quality = 1 then 'pass' else 'fail' end as kind, file as path from details join labels on doc_id = "row"
  union all select branch, 'retained', file from details join labels on doc_id = "row" where toxic = 0 and regexp_matches(branch, '(en|de)$')
  union all select distinct branch, 'retained', null from details where branch = 'prot/fr'),
pairs as (
  select inside || 'paired/' || lang as branch, "row", 'locus' || (doc_id // 8) as locus, case n_chars % 3 when 0 then 'pass' when 1 then 'fail' else 'skipped' end as status,
         case n_chars % 4 when 0 then 'protein:gap_ratio;codon:stop' when 1 then 'NA' end as reasons, 100 + doc_id % 100 as minimum_codon_pis, 50 + doc_id % 100 as minimum_protein_pis
  from rows_ where doc_id % 3 = 0),
once as (select *, count(*) over (partition by branch, locus) as n, row_number() over (partition by branch, locus order by "row") as k from details),
listed as (
  select branch, regexp_extract(path, '[^/]*$') as locus, bool_or(kind = 'pass') as p, bool_or(kind = 'fail') as f, bool_or(kind = 'retained') as r from lists where path is not null group by all),
shared as (
  select branch, locus, max(n) as paths from (select branch, regexp_extract(path, '[^/]*$') as locus, kind, count(distinct path) as n from lists where path is not null group by all) group by all),
least_ as (select branch as pair, arg_min(minimum_codon_pis, "row") as c, arg_min(minimum_protein_pis, "row") as p from pairs group by all),
known as (
  select coalesce(o.branch, l.branch) as branch, coalesce(o.locus, l.locus) as locus, o.* exclude (branch, locus), coalesce(l.p, false) as on_p, coalesce(l.f, false) as on_f,
         coalesce(l.r, false) as on_r, paths from (select * from once where k = 1) o full join listed l on o.branch = l.branch and o.locus = l.locus
  left join shared s on s.branch = l.branch and s.locus = l.locus),
met as (
  select known.*, coalesce(has, false) as kept, case seqtype when 'codon' then c when 'prot' then least_.p end as threshold
  from known left join (select branch, bool_or(kind = 'retained') as has from lists group by branch) using (branch)
  left join least_ on pair = case when contains(branch, 'pseudogene/') then 'pseudogene/' else '' end || 'paired/' || regexp_extract(branch, '[^/]*$')),
told as (
  select branch, case when kept then 'Independent' else 'Recorded QC' end as selection, locus,
         case when kept then case when on_r then 'pass' else 'fail' end when on_p then 'pass' when on_f then 'fail' else 'not_evaluated' end as status,
         list_concat(string_split(coalesce(issues, ''), ';'), case when kept and parsimony_informative_sites < threshold then ['{resolve.BELOW}'] else [] end) as list,
         case when kept then threshold end as threshold from met where "row" is not null
  union all select branch, 'Paired', locus, case when status in ('pass', 'fail') then status else 'not_evaluated' end, string_split(coalesce(reasons, ''), ';'), null
  from (select *, row_number() over (partition by branch, locus order by "row") as k from pairs) where k = 1),
status as (
  select branch, selection, locus, status, case when status != 'fail' then [] else list_sort(list_distinct(list_filter(list, lambda x: x not in ('', 'NA')))) end as found, threshold from told),
resolved as (
  select * replace (case when status = 'fail' and len(found) = 0 then ['{resolve.UNKNOWN}'] else found end as found) from status)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars", *[x.strip() for x in _columns(_ROW.format(locus="(doc_id div 8)").replace('"row"', "row"))])


def _columns(text: str) -> list[str]:
    """Expressions at the commas outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _rows(spark, sf_dir)
    details = rows.selectExpr("concat(inside, seqtype, '/', lang) as branch", "row", "file", "seqtype", "parsimony_informative_sites", "issues")
    marked = details.join(v.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "row"), "row")
    lists = marked.selectExpr("branch", "case when quality = 1 then 'pass' else 'fail' end as kind", "file as path")
    lists = lists.union(marked.where("toxic = 0 and branch rlike '(en|de)$'").selectExpr("branch", "'retained'", "file"))
    lists = lists.union(details.where("branch = 'prot/fr'").selectExpr("branch", "'retained'", "cast(null as string)").distinct())
    pairs = rows.where("doc_id % 3 = 0").selectExpr(
        "concat(inside, 'paired/', lang) as branch", "row", "concat('locus', doc_id div 8) as locus", "case n_chars % 3 when 0 then 'pass' when 1 then 'fail' else 'skipped' end as status",
        "case n_chars % 4 when 0 then 'protein:gap_ratio;codon:stop' when 1 then 'NA' end as reasons", "100 + doc_id % 100 as minimum_codon_pis", "50 + doc_id % 100 as minimum_protein_pis",
    )
    return details, lists, pairs


@query(f"with {REPORTS_SQL} select branch, selection, locus, status, array_to_string(found, ';') as reasons, threshold::bigint as threshold from resolved")
def report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved(*_reports(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ";"))


@query(f"""with {REPORTS_SQL}
select branch, locus, unnest(list_filter([case when n > 1 then 'row repeated' end, case when on_p and on_f then 'passed and failed' end, case when paths > 1 then 'paths share a name' end,
  case when "row" is null then 'listed without a row' end, case when "row" is not null and on_r and threshold is null then 'no threshold' end], lambda x: x is not null)) as fault from met
union all select branch, locus, 'row repeated' from pairs group by all having count(*) > 1""")
def report_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.report_faults(*_reports(spark, sf_dir))


@query(f"""with {REPORTS_SQL} select branch, selection, sum((status != 'not_evaluated')::int)::bigint as evaluated, sum((status = 'pass')::int)::bigint as passed,
  sum((status = 'fail')::int)::bigint as failed, sum((status = 'not_evaluated')::int)::bigint as not_evaluated from resolved group by all""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.branch_summary(resolve.resolved(*_reports(spark, sf_dir)))


def _combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = resolve.resolved(*_reports(spark, sf_dir)).where("status = 'fail'")
    return failed.groupBy("branch", F.array_join("reasons", " + ").alias("combination")).agg(F.count(F.lit(1)).alias("n"))


_COMBINATIONS_SQL = f"{REPORTS_SQL}, combinations as (select branch, array_to_string(found, ' + ') as combination, count(*)::bigint as n from resolved where status = 'fail' group by all)"


@query(f"with {_COMBINATIONS_SQL} select * from combinations order by n desc, branch, combination limit 10")
def top_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leading(_combinations(spark, sf_dir), "n", ["branch", "combination"], 10)


@query(f"with {_COMBINATIONS_SQL} select *, row_number() over (partition by branch order by n desc, combination)::int as place from combinations qualify place <= 2")
def top_combinations_by_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leading(_combinations(spark, sf_dir), "n", ["combination"], 2, ["branch"])


#: Reports of changes made from events: each user is a locus, of a source file or of an aligner's export.
_KINDS = "case event_type when 'click' then 'terminal_stop' when 'view' then 'internal_stop' when 'error' then 'protein_terminal_stop' when 'purchase' then 'protein_internal_stop' else 'nucleotide_ambiguity' end"
_CHANGE = f"""event_id as report_row, case when user_id % 5 = 0 then 'macse_alignment' else 'source' end as input_kind,
  case when user_id % 13 = 0 and event_id % 2 = 0 then '/other' else '/in/./' end || '/locus' || user_id || case when user_id % 5 = 0 then '.macse_original.NT.fasta' else '.fasta' end as input_file,
  case when user_id % 11 = 0 then 'NA' else 'sp' || (event_id % 8) end as taxa_id, case event_id % 3 when 0 then 'NA' when 1 then '' else 'sp' || ((event_id + 1) % 8) end as mapped_taxa_id, {_KINDS} as event,
  case when value < 5 then 'NA' when value < 10 then '' else cast(cast(floor(value) as bigint) as {{text}}) end as source_nt_positions, cast(user_id % 90 as {{text}}) as source_aa_positions,
  case when event_id % 2 = 0 then 'TAA' when event_id % 7 != 0 then 'TGA' end as original"""
CHANGES_SQL = f"""changes as (select {_CHANGE.format(text="varchar")} from events),
stop_rows as (
  select 'locus' || regexp_extract(input_file, 'locus([0-9]+)', 1) as locus_key, replace(replace(input_file, '/./', '/'), '//', '/') as source,
         case when mapped_taxa_id in ('', 'NA') then taxa_id else mapped_taxa_id end as taxon, case when event like '%internal%' then 'internal' else 'terminal' end as category, report_row,
         case when source_nt_positions in ('', 'NA') then source_aa_positions else source_nt_positions end || '-' || coalesce(original, 'NA') as note from changes where event like '%stop'),
stop_index as (
  select locus_key, taxon, string_agg(note, ';' order by report_row) filter (where category = 'terminal') as audited_terminal_stop,
         string_agg(note, ';' order by report_row) filter (where category = 'internal') as audited_internal_stop from stop_rows group by all)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "events").selectExpr(*_columns(_CHANGE.format(text="string")))


@query(f"with {CHANGES_SQL} select * from stop_index")
def provenance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.stop_index(_changes(spark, sf_dir))


@query(f"""with {CHANGES_SQL} select locus_key, string_agg(source, ' ' order by source) as sources from (select distinct locus_key, source from stop_rows) group by all having count(*) > 1""")
def provenance_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.collisions(_changes(spark, sf_dir)).withColumn("sources", F.array_join("sources", " "))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alignment's file of every locus; trimmed ones and others."""
    return v.table(spark, sf_dir, "documents").selectExpr("doc_id as locus", "concat('/aln/locus', doc_id, case when doc_id % 2 = 0 then '.mafft.codon.trimmed.aln.fasta' else '.aln.fasta' end) as file")


_AUDITED_SQL = f"""{CHANGES_SQL}, audited as (
  select locus, record_order, seq_id, coalesce(audited_terminal_stop, 'NA') as audited_terminal_stop, coalesce(audited_internal_stop, 'NA') as audited_internal_stop
  from records left join stop_index on locus_key = 'locus' || locus and taxon = seq_id)"""


@query(f"with {v.NUCL_SQL}, {_AUDITED_SQL} select * from audited")
def audited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = v.records(spark, sf_dir).select("locus", "record_order", "seq_id")
    found = provenance.with_provenance(records, _files(spark, sf_dir), provenance.stop_index(_changes(spark, sf_dir)))
    return found.select("locus", "record_order", "seq_id", "audited_terminal_stop", "audited_internal_stop")


_DETAILS_GATE_SQL = _GATE_SQL.replace("ended as (", f"{_AUDITED_SQL}, plain_ended as (").replace(
    "tested as (", "ended as (select locus, coalesce(t, false) as t, coalesce(i, false) or locus in (select locus from audited where audited_internal_stop != 'NA') as i from summary left join plain_ended using (locus)),\ntested as (", 1
)
_text = lambda what, table, between="": f"coalesce((select string_agg(seq_id || '-{between}' || {what}, ';' order by record_order) from {table} x where x.locus = gate.locus and {what} is not null and {what} != 'NA'), 'NA')"


@query(f"""with {_DETAILS_GATE_SQL},
patterns as (select locus, count(distinct pattern)::bigint as n from (select locus, pos, string_agg(ch, '' order by record_order) as pattern from cells group by all) group by locus)
select gate.locus, passed, '/aln/locus' || gate.locus || case when gate.locus % 2 = 0 then '.mafft.codon.trimmed.aln.fasta' else '.aln.fasta' end as "File", 'codon' as "Seqtype",
  sequence_count as "Sequence_count", alignment_length as "Alignment_length", n_ratio as "N_ratio", gap_ratio as "Gap_ratio", variable_sites as "Variable_sites",
  parsimony_informative_sites as "Parsimony_informative_sites", n as "Distinct_patterns", singleton_sites as "Singleton_sites", constant_sites as "Constant_sites", missing_ratio as "Missing_ratio",
  {_text("terminal_stop", "stops")} as "Terminal_stop", {_text("internal_stops", "stops", "inter-")} as "Internal_stop_count",
  {_text("audited_terminal_stop", "audited")} as "Audited_terminal_stop", {_text("audited_internal_stop", "audited")} as "Audited_internal_stop", reasons as "Issues"
from gate join patterns using (locus)""")
def qc_details_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc_details(v.records(spark, sf_dir), _files(spark, sf_dir), GATE, provenance.stop_index(_changes(spark, sf_dir)))


_EXPORT_SQL = f"""{v.RAW_SQL},
made as (select *, translate(upper(seq), 'URYSWKMBDHV', 'TNNNNNNNNNN') as out from records),
edits as (
  select locus, record_order, seq_id, pos, ch from (select *, unnest(string_split(seq, '')) as ch, unnest(range(1, length(seq) + 1)) as pos from records) where contains('URYSWKMBDHV', upper(ch))),
dims as (select locus, count(*) as ntax, max(length(seq)) as nchar, max(length(seq_id)) as width, max(record_order) as last from records group by all)"""


@query(f"""with {_EXPORT_SQL}
select locus, 'phylip' as sink, 0::bigint as major, 0::bigint as minor, ntax || ' ' || nchar as line from dims
union all select locus, 'phylip', record_order + 1, 0, seq_id || '  ' || out from made
union all select locus, 'nexus', 0, 0, concat('#NEXUS', chr(10), chr(10), 'begin data;', chr(10), '  dimensions ntax=', ntax, ' nchar=', nchar, ';', chr(10), '  format datatype=dna missing=? gap=- interleave;', chr(10), '  matrix') from dims
union all select locus, 'nexus', block + 1, record_order, concat(rpad(seq_id, width::int, ' '), ' ', substr(out, (70 * block + 1)::int, 70), case when record_order = last then chr(10) else '' end)
  from (select *, unnest(range((length(out) + 69) // 70)) as block from made) join dims using (locus)
union all select locus, 'nexus', (nchar + 69) // 70 + 1, 0, '  ;' || chr(10) || 'end;' from dims
union all select locus, 'changes', 0, 0, concat_ws(chr(9), 'input_file', 'taxa_id', 'event', 'source_nt_positions', 'original', 'replacement', 'action', 'genetic_code', 'input_kind') from (select distinct locus from edits)
union all select locus, 'changes', record_order + 1, pos, concat_ws(chr(9), concat('/in/', locus, '.fasta'), seq_id, case when upper(ch) = 'U' then 'uracil_to_thymine' else 'nucleotide_ambiguity' end,
  pos || '-' || pos, ch, case when upper(ch) = 'U' then 'T' else 'N' end, 'replace', 'NA', 'source') from edits""")
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = export.prepared(v.records(spark, sf_dir, v.RAW))
    return export.export_lines(kept, export.counts(kept), file=F.concat(F.lit("/in/"), "locus", F.lit(".fasta")))


@query(f"""with {_concat_sql("pad-gaps")}, ends as (select max("end") as nchar, (select count(*) from taxa) as ntax from parts),
m as (select seq_id as taxon, "start", "end", seq as fragment from records join parts using (locus) union all select taxon, "start", "end", repeat('?', length) from blocks)
select {stream.HEAD}::bigint as first_locus, 0 as first_record, 0::bigint as "start", ntax || ' ' || nchar || chr(10) as text from ends
union all select first // 100, (first % 100)::int, "start", concat(case when "start" = 1 then taxon || ' ' else '' end, fragment, case when "end" = nchar then chr(10) else '' end) from m join taxa using (taxon), ends""")
def phylip_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = v.occupied_records(spark, sf_dir)
    return stream.phylip_pieces(concat.supermatrix(records), concat.taxa(records), concat.partitions(records))


#: Sequence files made from documents: every third line is a header.
_LINES_SQL = """lines as (
  select file, line, case when line % 3 = 1 then '>' || raw else raw end as value
  from (select doc_id as file, unnest(string_split(coalesce(text, ''), chr(10))) as raw, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as line from documents))"""


def _document_lines(spark: SparkSession, sf_dir: str, header: Column) -> DataFrame:
    lines = v.spread(v.table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "raw"))
    return lines.select("file", (F.col("pos") + 1).cast("long").alias("line"), F.when(header, F.concat(F.lit(">"), "raw")).otherwise(F.col("raw")).alias("value"))


@query(f"""with {_LINES_SQL},
placed as (
  select *, sum((value[1] = '>')::int) over (partition by file order by line)::bigint as record, value[1] = '>' as header,
         regexp_extract(substr(value, 2), '([^ \\t\\x0b\\f\\r\\n]+)', 1) as seq_id, regexp_replace(value, '[ \\t\\x0b\\f\\r]+', '', 'g') as chunk from lines),
recs as (
  select file, record, min(line) as line, max(seq_id) filter (where header) as seq_id, coalesce(sum(length(chunk)) filter (where not header), 0) as length from placed where record > 0 group by all),
known as (select *, min(record) over (partition by file, seq_id) as earliest, arg_min(length, record) over (partition by file) as due from recs)
select file, line, record, case when header and strlen(value) + 1 > 200 then 'header is too long' when header and seq_id = '' then 'empty id'
  when record = 0 and not header and chunk != '' then 'sequence before the first header' when not header and regexp_matches(chunk, '[^\\x00-\\x7f]') then 'letters beyond ASCII' end as fault from placed where fault is not null
union all select file, line, record, unnest(list_filter([case when record > earliest and seq_id != '' then 'id of an earlier record' end, case when length = 0 then 'empty record' end,
  case when length > 0 and length != due then 'not as long as the first record' end], lambda x: x is not null)) from known
union all select file, 0, 0, 'no records' from placed group by file having max(record) = 0""")
def sequence_file_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spool.spool_faults(_document_lines(spark, sf_dir, F.col("pos") % 3 == 0), piece=64, header_bytes=200)


@query(f"with {v.RAW_SQL} select locus as file, record_order, seq_id, upper(seq) as seq from records where length(seq) % 2 = 0")
def spooled_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of even length come back from lines of 60 letters; a file of the others has a line before its first header."""
    records = v.records(spark, sf_dir, v.RAW)
    early = (F.length("seq") % 2 == 1) & (F.col("record_order") == 0)
    cut = F.concat(F.when(early, F.array(F.lit("ACGT"))).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit(">"), "seq_id", F.lit(" of the locus"))), F.regexp_extract_all("seq", F.lit("(?s).{1,60}"), F.lit(0)))
    # a thousand million lines for every record, so that lines are in order though they aren't dense
    lines = records.select(F.col("locus").alias("file"), "record_order", F.when(early, 0).otherwise(1).alias("first"), F.posexplode(cut).alias("pos", "value"))
    numbered = lines.select("file", (F.col("record_order") * F.lit(1_000_000_000).cast("long") + F.col("pos") + F.col("first")).alias("line"), "value")
    return spool.spooled_records(numbered, spool.spool_faults(numbered))


@query("""with m as (
  select doc_id, lang, sha256(coalesce(text, '')) as input, case when doc_id % 11 = 0 then '1' else '2' end as done_version, case when doc_id % 13 = 0 then 'old' else lang end as done_configuration,
         case when doc_id % 17 = 0 then '' else sha256(coalesce(text, '')) end as done_input from documents)
select doc_id as unit, case when doc_id % 7 = 0 then 'new' when done_version != '2' then 'version' when done_input != input then 'input' when done_configuration is distinct from lang then 'configuration'
  when doc_id % 19 = 0 then 'output missing' when doc_id % 23 = 0 then 'output changed' end as reason from m where reason is not null""")
def units_to_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    wanted = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.lit("2").alias("version"), digest.alias("input_sha256"), F.col("lang").alias("configuration"))
    old = {"version": F.when(F.col("unit") % 11 == 0, "1").otherwise(F.col("version")), "configuration": F.when(F.col("unit") % 13 == 0, "old").otherwise(F.col("configuration")), "input_sha256": F.when(F.col("unit") % 17 == 0, "").otherwise(F.col("input_sha256"))}
    made = wanted.where("unit % 7 != 0").withColumns(old).withColumn("kind", F.explode(F.array(F.lit("fasta"), F.lit("tsv"))))
    made = made.withColumns({"output": F.concat_ws(".", "unit", "kind"), "output_sha256": F.sha2(F.concat_ws(".", "unit", "kind"), 256)})
    now = made.where("unit % 19 != 0 or kind = 'fasta'").select("output", F.when((F.col("unit") % 23 == 0) & (F.col("kind") == "tsv"), "other").otherwise(F.col("output_sha256")).alias("sha256"))
    return snapshot.to_resume(wanted, made.drop("kind"), now)


@query("""with rows_ as (select c_custkey as line, c_custkey % 5 > 0 as two, 'id_' || (c_custkey % 977) as original_id, case when c_custkey % 31 = 0 then 'x_y' else 'n' || (c_custkey % 977) end as renamed_id from customer)
select line, 'two columns are needed' as fault from rows_ where not two
union all select max(line), 'more than one name for ' || original_id from rows_ where two group by original_id having count(distinct renamed_id) > 1""")
def mapping_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "concat('id:', c_custkey % 977, case when c_custkey % 5 > 0 then concat('\\t', case when c_custkey % 31 = 0 then 'x(y' else concat('n', c_custkey % 977) end) else '' end)"
    lines = v.table(spark, sf_dir, "customer").selectExpr("c_custkey as line", f"{told} as value")
    return snapshot.mapping_faults(snapshot.mapping_rows(lines))


_SIDES_SQL = f"""{_site_sql(v.NUCL_SQL, "ACGT")},
c as (select locus, '/c/' || locus as file, locus % 7 != 0 as passed, parsimony_informative_sites as n from classes where locus % 17 != 0),
p as (with {_site_sql(v.PROT_SQL, "ACDEFGHIKLMNPQRSTVWYOU")} select locus, '/p/' || locus as file, locus % 5 != 0 as passed, parsimony_informative_sites as n from classes where locus % 19 != 0)"""


def _paired(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Both sides with files; each lacks some loci of the other."""
    sides = zip(_sides(spark, sf_dir), ("/c/", "/p/"), (17, 19), strict=True)
    return [side.where(F.col("locus") % lacks != 0).withColumn("file", F.concat(F.lit(at), "locus")) for side, at, lacks in sides]


@query(f"""with {_SIDES_SQL}, j as (
  select coalesce(c.locus, p.locus) as locus, c.file as cf, p.file as pf, coalesce(c.passed, false) as cp, coalesce(p.passed, false) as pp, c.n as cn, p.n as pn,
         coalesce(c.n is not null and p.n is not null and (c.n >= 60 or p.n >= 30), false) as ok from c full join p on c.locus = p.locus)
select locus as "Locus", coalesce(cf, 'NA') as "Codon_file", coalesce(pf, 'NA') as "Protein_file", case when cp then 'pass' else 'fail' end as "Codon_nonPIS_QC",
  case when pp then 'pass' else 'fail' end as "Protein_nonPIS_QC", coalesce(cn::varchar, 'NA') as "Codon_PIS", coalesce(pn::varchar, 'NA') as "Protein_PIS", 60::bigint as "Minimum_codon_PIS",
  30::bigint as "Minimum_protein_PIS", 'either' as "PIS_policy", case when ok then 'pass' else 'fail' end as "PIS_status", case when cp and pp and ok then 'pass' else 'fail' end as "Paired_status",
  coalesce(nullif(concat_ws(';', case when not cp then 'codon_qc_failed' end, case when not pp then 'protein_qc_failed' end, case when not ok then 'pis_policy_failed' end), ''), 'NA') as "Reasons" from j""")
def paired_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.paired_report(*_paired(spark, sf_dir), policy="either", min_codon=60, min_protein=30)


@query(f"with {_SIDES_SQL} select locus, n as parsimony_informative_sites from c where passed and n >= 60")
def independent_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.independent(_paired(spark, sf_dir)[0], 60).select("locus", "parsimony_informative_sites")


@query(f"with {_SIDES_SQL} select coalesce(c.locus, p.locus) as locus, case when c.locus is null then 'missing' else 'unexpected' end as fault from c full join p on c.locus = p.locus where c.locus is null or p.locus is null")
def paired_site_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.site_faults(*_paired(spark, sf_dir))


@query(f"""with {_PRE_SQL},
base as (select cells.* from cells join marked m using (locus, record_order, seq_id) where (pos - 1) // 3 + 1 = site and not stop),
events as (
  select seq_id, locus, case when site = last then 'terminal_stop' else 'internal_stop' end as event, (3 * site - 2)::int as "start", (3 * site)::int as "end", codon as original,
         case when site = last then '-' else 'NNN' end as replacement, case when site = last then 'delete' else 'replace' end as action from marked where stop
  union all by name select * exclude (record_order) from ({_BASE_EVENT.replace("from cells", "from base")})
  union all by name select locus, seq_id, 'validation_error' as event, null as "start", null as "end", 'NA' as original, 'NA' as replacement, 'skip' as action from marked where last = 1 and stop)
select '/in/' || locus || '.fasta' as input_file, seq_id as taxa_id, event, coalesce("start" || '-' || "end", 'NA') as source_nt_positions, original, replacement, action, '1' as genetic_code, 'source' as input_kind from events""")
def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalize.codon_events(v.records(spark, sf_dir, v.RAW))
    return reports.change_report(events, F.concat(F.lit("/in/"), "locus", F.lit(".fasta")), 1)


#: Orthogroups are orders, genes of a taxon are parts; a sequence is the first letters of a document, and some parts have none.
_SET_SQL = """members as (
  select l_orderkey as orthogroup, 't' || (l_suppkey % 10) as taxon, (l_suppkey % 10)::int as taxon_order, case when l_partkey % 50 = 0 then 'g ' else 'g' end || (l_partkey % 97) as gene, l_linenumber::int as gene_order from lineitem),
sequences as (
  select 't' || t as taxon, case when k % 5 = 0 and t % 2 = 0 then 'g ' else 'g' end || k as gene, substr('ACGTNACGGTNNACG', (k % 4 + 1)::int, (t + k % 9 + 1)::int) as seq
  from (select distinct l_suppkey % 10 as t, l_partkey % 97 as k from lineitem where l_partkey % 97 != 13)),
held as (
  select m.*, seq, {name} as export_id, length(regexp_replace(seq, '[^ACGTU]', '', 'g')) as n from members m join sequences using (taxon, gene))"""


def _set(spark: SparkSession, sf_dir: str, keep_taxon: bool, longest: bool) -> orthoset.OrthoSet:
    lines = v.table(spark, sf_dir, "lineitem")
    members = lines.selectExpr(
        "l_orderkey as orthogroup", "concat('t', l_suppkey % 10) as taxon", "cast(l_suppkey % 10 as int) as taxon_order", "concat(case when l_partkey % 50 = 0 then 'g ' else 'g' end, l_partkey % 97) as gene", "cast(l_linenumber as int) as gene_order"
    )
    genes = lines.where("l_partkey % 97 != 13").selectExpr("l_suppkey % 10 as t", "l_partkey % 97 as k").distinct()
    sequences = genes.selectExpr("concat('t', t) as taxon", "concat(case when k % 5 = 0 and t % 2 = 0 then 'g ' else 'g' end, k) as gene", "substr('ACGTNACGGTNNACG', cast(k % 4 + 1 as int), cast(t + k % 9 + 1 as int)) as seq")
    return orthoset.prepared(members, sequences, keep_taxon, longest)


@query(f"""with {_SET_SQL.format(name="gene")}
select orthogroup, taxon, gene, 'no sequence' as fault from members anti join sequences using (taxon, gene)
union all select orthogroup, taxon, gene, 'white space in the name' from held where contains(export_id, ' ')
union all select x.orthogroup, x.taxon, x.gene, 'name used twice' from (select min({{'orthogroup': orthogroup, 'taxon': taxon, 'gene': gene}}) as x from held group by orthogroup, export_id having count(*) > 1)
union all select x.orthogroup, x.taxon, x.gene, 'name of several taxa' from (select min({{'orthogroup': orthogroup, 'taxon': taxon, 'gene': gene}}) as x from held group by export_id having count(distinct taxon) > 1)""")
def orthogroup_set_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set(spark, sf_dir, False, False).faults


@query(f"""with {_SET_SQL.format(name="taxon || '_' || gene")}
select orthogroup, taxon, gene as gene_id, length(seq)::int as length, n::int as effective_length, 'codon' as sequence_type,
       case when gene = first_value(gene) over (partition by orthogroup, taxon order by n desc, gene) then 'yes' else 'no' end as selected from held""")
def copy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set(spark, sf_dir, True, True).selection


@query(f"""with {_SET_SQL.format(name="taxon || '_' || gene")}
select orthogroup, taxon_order, gene_order, concat('>', export_id, ' taxon=', taxon, ' orthogroup=', orthogroup, chr(10), seq) as text from held""")
def orthogroup_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orthoset.fasta_lines(_set(spark, sf_dir, True, False).rows)


#: All queries and their SQL, those of plans.queries among them.
__all__ = ["ORACLE_SQL", "QUERIES"]
