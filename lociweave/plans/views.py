"""Alignments, orthogroups and edits made from the general tables, whole tables and whole texts, in Spark and in SQL.

Every document is a locus.  Its letters, in order, are dealt to TAXA rows of equal length, the last one filled up
with gaps, and each letter is mapped to a symbol, those beyond A to Z as an n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions import columns

TAXA = 8
TAXON_IDS = [f"sp{k}" for k in range(TAXA)]
ABC = "abcdefghijklmnopqrstuvwxyz"
NUCL = "ACGTACGTNACGT-ACGTACRT?ACG"
RAW = "ACGTacgtNACGTuACGURCyT?ACG"
PROT = "ACDEFGHIKLMNPQRSTVWYX-?*BU"
FIRST, SECOND, THIRD = "GGCACTGGCACTGGCACTGGCACTGGG", "CGTTTCCGTTTCCGTTTCCGTTTCCGC", "ACGTACGTACGTACGTACGTAC?TAC?"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df on all cores: a file of a few megabytes is read as one piece, and much of the work that follows needs no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _dealt(spark: SparkSession, sf_dir: str, unit: int, rows: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """records: rows makes TAXA sequences, as bytes, of the letters of a document, dealt to TAXA rows of numbers from 0 (a) to 25 (z), 26 for what fills the last ones up."""
    places = np.full(256, ABC.index("n"), dtype=np.uint8)
    for k, c in enumerate(ABC):
        places[[ord(c), ord(c.upper())]] = k

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in columns.slices(batches):
            made, sizes = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = columns.lookup(places, columns.letters(text))
                n = max(1, -(-len(found) // (TAXA * unit))) * unit
                made.append(rows(np.concatenate([found, np.full(TAXA * n - len(found), 26, dtype=np.uint8)]).reshape(TAXA, n)))
                sizes.append(made[-1].size // TAXA)
            ends = np.concatenate([[0], np.cumsum(np.repeat(sizes, TAXA))])
            for start in range(0, len(sizes) * TAXA, TAXA * 256):
                stop = min(start + TAXA * 256, len(sizes) * TAXA)
                data = np.concatenate([m.ravel() for m in made[start // TAXA : stop // TAXA]])
                seq = pa.StringArray.from_buffers(stop - start, pa.py_buffer((ends[start : stop + 1] - ends[start]).astype(np.int32)), pa.py_buffer(data))
                order = np.tile(np.arange(TAXA, dtype=np.int32), (stop - start) // TAXA)
                locus = batch.column(0).take(pa.array(np.arange(start, stop) // TAXA))
                yield pa.RecordBatch.from_arrays([locus, pa.array(order), pa.array(TAXON_IDS).take(pa.array(order)), seq], names=["locus", "record_order", "seq_id", "seq"])

    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("locus"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", "").alias("letters"))
    return docs.mapInArrow(deal, f"locus {dict(docs.dtypes)['locus']}, record_order int, seq_id string, seq string")


def _symbols(symbols: str) -> np.ndarray:
    return np.frombuffer(symbols.encode(), dtype=np.uint8)


def records(spark: SparkSession, sf_dir: str, symbols: str = NUCL, unit: int = 3) -> DataFrame:
    known = _symbols(symbols + "-")
    return _dealt(spark, sf_dir, unit, lambda rows: known[rows])


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, PROT, 1)


def codon_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets whose first two bases come from the locus's first row and whose third from the own one; some are ???."""
    first, second, third = map(_symbols, (FIRST, SECOND, THIRD))

    def woven(rows: np.ndarray) -> np.ndarray:
        seq = np.stack([np.broadcast_to(first[rows[0]], rows.shape), np.broadcast_to(second[rows[0]], rows.shape), third[rows]], axis=2)
        seq[seq[..., 2] == ord("?")] = ord("?")
        return seq

    return _dealt(spark, sf_dir, 1, woven)


def codon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codon records two by two: four loci of two records from each of eight."""
    return codon_records(spark, sf_dir).selectExpr("locus * 4 + record_order div 2 as locus", "record_order % 2 as record_order", "seq_id", "seq")


def occupied_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nucleotide records less those without any letter: loci with missing taxa."""
    return records(spark, sf_dir).where("seq rlike '[^-]'")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orthogroups are orders, taxa come from suppliers, genes from lines, their effective length from quantities."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as orthogroup", "concat('t', l_suppkey % 10) as taxon", "concat(l_orderkey, '_', l_linenumber, '_', l_partkey) as gene", "l_quantity as effective_length"
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('file', user_id % 7) as input_file", "case when user_id % 11 = 0 then 'NA' else concat('taxon', user_id % 20) end as taxa_id", "event_type as event",
        "case when value < 5 then 'delete' else 'replace' end as action",
        "case when value < 1 then 'NA' else concat(cast(floor(value) as bigint), '-', cast(floor(value) as bigint) + user_id % 3) end as source_nt_positions",
    )


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("concat('sp', n_nationkey) as original_id", "n_name as renamed_id")


def _records_sql(symbols: str, unit: int) -> str:
    return f"""
dealt as (
  select locus, i as record_order, 'sp' || i as seq_id, letters, n, substr(letters, i * n + 1, n) as own
  from (select *, (greatest(1, ceil(length(letters) / {TAXA * unit}.0)) * {unit})::int as n
        from (select doc_id as locus, lower(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g'), '[^A-Za-z]', 'n', 'g')) as letters from documents)) s,
       (select unnest(range({TAXA}))::int as i) t),
records as (select locus, record_order, seq_id, rpad(translate(own, '{ABC}', '{symbols}'), n, '-') as seq from dealt)"""


NUCL_SQL, RAW_SQL, PROT_SQL = _records_sql(NUCL, 3), _records_sql(RAW, 3), _records_sql(PROT, 1)
CODON_SQL = (
    _records_sql(PROT, 1).replace("records as (", "unused as (")
    + f""",
lettered as (select *, rpad(substr(letters, 1, n), n, '#') as a, rpad(own, n, '#') as b from dealt),
records as (
  select locus, record_order, seq_id, regexp_replace(array_to_string(list_transform(list_zip(
      string_split(translate(a, '{ABC}#', '{FIRST}'), ''), string_split(translate(a, '{ABC}#', '{SECOND}'), ''),
      string_split(translate(b, '{ABC}#', '{THIRD}'), '')), lambda x: x[1] || x[2] || x[3]), ''), '[A-Z]{{2}}\\?', '???', 'g') as seq
  from lettered)"""
)
PAIRS_SQL = CODON_SQL.replace("records as (\n", "eight as (\n") + ", records as (select locus * 4 + record_order // 2 as locus, record_order % 2 as record_order, seq_id, seq from eight)"
CELLS_SQL = "cells as (select locus, record_order, seq_id, unnest(string_split(seq, '')) as ch, unnest(range(1, length(seq) + 1)) as pos from records)"
CODONS_SQL = "codons as (select locus, record_order, seq_id, substr(seq, 3 * site::int - 2, 3) as codon, site from (select *, unnest(range(1, length(seq) // 3 + 1)) as site from records))"
OCCUPIED_SQL = NUCL_SQL.replace("records as (", "all_records as (") + ", records as (select * from all_records where regexp_matches(seq, '[^-]'))"
MEMBERS_SQL = "members as (select l_orderkey as orthogroup, 't' || (l_suppkey % 10) as taxon, l_orderkey || '_' || l_linenumber || '_' || l_partkey as gene, l_quantity as effective_length from lineitem)"
EDITS_SQL = """edits as (
  select 'file' || (user_id % 7) as input_file, case when user_id % 11 = 0 then 'NA' else 'taxon' || (user_id % 20) end as taxa_id, event_type as event,
         case when value < 5 then 'delete' else 'replace' end as action,
         case when value < 1 then 'NA' else floor(value)::bigint || '-' || (floor(value)::bigint + user_id % 3) end as source_nt_positions
  from events)"""
