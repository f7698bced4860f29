"""Reports of branches, provenance, details, one-call exports, streamed rows, checked files and snapshots."""

from __future__ import annotations

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lociweave.functions.ordered import leading, ordered_text
from lociweave.model import EVENT_FIELDS
from lociweave.operators import concat, normalize, orthoset, paired, provenance, resolve
from lociweave.operators.details import columns, finding_texts, path_lists, qc_details
from lociweave.operators.qc import Gate
from lociweave.sinks import reports
from lociweave.sinks.export import counts, export_formats, export_lines, prepared
from lociweave.sinks.stream import phylip_pieces, write_pieces
from lociweave.sources import snapshot, spool, tables

DETAILS = "branch string, row long, file string, seqtype string, parsimony_informative_sites long, issues string"
LISTS = "branch string, kind string, path string"
PAIRS = "branch string, row long, locus string, status string, reasons string, minimum_codon_pis long, minimum_protein_pis long"


def _resolved(spark, details, lists, pairs=()):
    tables = spark.createDataFrame(details, DETAILS), spark.createDataFrame(lists, LISTS), spark.createDataFrame(list(pairs), PAIRS)
    status = {(r["branch"], r["locus"]): (r["status"], r["reasons"]) for r in resolve.resolved(*tables).collect()}
    return status, {tuple(r) for r in resolve.report_faults(*tables).collect()}


def test_retained_lists_decide_and_thresholds_come_from_the_paired_branch(spark):
    details = [("codon/x", 1, "/a/g1.fa", "codon", 5, "NA"), ("codon/x", 2, "C:\\b\\g2.fa", "codon", 9, "gap;;gap"), ("codon/x", 3, "g3.fa", "codon", 20, None), ("codon/x", 4, "z/g1.fa", "codon", 99, "late")]
    lists = [("codon/x", "retained", "/q/g3.fa"), ("codon/x", "pass", "/q/g1.fa"), ("codon/x", "fail", "/r/g1.fa")]
    pairs = [("paired/x", 7, "g1", "pass", "r", 50, 3), ("paired/x", 2, "g9", "fail", "", 10, 4), ("pseudogene/paired/x", 1, "g1", "odd", None, 99, 99)]
    status, faults = _resolved(spark, details, lists, pairs)
    assert status["codon/x", "g1.fa"] == ("fail", [resolve.BELOW])
    assert status["codon/x", "g2.fa"] == ("fail", [resolve.BELOW, "gap"])
    assert status["codon/x", "g3.fa"] == ("pass", [])
    assert status["paired/x", "g9"] == ("fail", [resolve.UNKNOWN]) and status["pseudogene/paired/x", "g1"] == ("not_evaluated", [])
    assert faults == {("codon/x", "g1.fa", "row repeated"), ("codon/x", "g1.fa", "passed and failed")}


def test_lists_that_are_empty_or_missing(spark):
    details = [("prot", 1, "g1", "prot", 5, "a"), ("nucl", 1, "g1", "nucl", 5, "a"), ("nucl", 2, "g2", "nucl", 5, "b"), ("nucl", 3, "g3", "nucl", 5, "b")]
    lists = [("prot", "retained", None), ("nucl", "pass", "x/g1"), ("nucl", "pass", "y/g1"), ("nucl", "fail", "x/g2"), ("nucl", "fail", "x/g4"), ("lost", "retained", "x/g5")]
    status, faults = _resolved(spark, details, lists)
    assert status == {("prot", "g1"): ("fail", ["a"]), ("nucl", "g1"): ("pass", []), ("nucl", "g2"): ("fail", ["b"]), ("nucl", "g3"): ("not_evaluated", [])}
    assert faults == {("nucl", "g1", "paths share a name"), ("nucl", "g4", "listed without a row"), ("lost", "g5", "listed without a row")}
    assert _resolved(spark, [], []) == ({}, set())


def test_ordered_text_in_pieces_and_leading_rows(spark):
    rows = [("a", k, f"t{k}") for k in (9, 3, 7, 1, 5)] + [("b", 2, None), ("a", 4, None)]
    df = spark.createDataFrame(rows, "key string, at long, text string")
    for piece in (1, 2, 4096):
        assert [tuple(r) for r in ordered_text(df, ["key"], "at", "text", piece=piece).collect()] == [("a", "t1;t3;t5;t7;t9")]
    n = spark.createDataFrame([("a", "x", 2), ("a", "y", 2), ("a", "w", 1), ("b", "z", 3), ("b", None, 3)], "g string, k string, n int").repartition(3)
    assert [(r["g"], r["k"]) for r in leading(n, "n", ["g", "k"], 3).collect()] == [("b", "z"), ("b", None), ("a", "x")]
    top = leading(n, "n", ["k"], 1, ["g"])
    assert sorted((r["g"], r["k"], r["place"]) for r in top.collect()) == [("a", "x", 1), ("b", "z", 1)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in leading(n, "n", ["g", "k"], 3)._jdf.queryExecution().executedPlan().toString()


CHANGES = "report_row long, input_file string, input_kind string, taxa_id string, mapped_taxa_id string, event string, source_nt_positions string, source_aa_positions string, original string"


def _changes(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], CHANGES)


def test_provenance_reaches_alignments_by_file_and_mapped_name(spark, records):
    changes = _changes(
        spark,
        ("/in/g1.fasta", "source", "a", "A", "terminal_stop", "7-9", None, "TAA"), ("/in//g1.fasta", None, "a", "A", "internal_stop", "4-6", None, "TGA"), ("/in/./g1.fasta", "source", "a", "A", "internal_stop", "1-3", None, "TAG"),
        ("/in/g2.macse_original.NT.fasta", "macse_alignment", "b", "NA", "protein_internal_stop", "NA", "5", "*"), ("/in/g1.fasta", "source", "a", "A", "nucleotide_ambiguity", "2", None, "R"), ("", "source", "c", "", "terminal_stop", "", None, None),
    )
    index = provenance.stop_index(changes, piece=1)
    files = spark.createDataFrame([(1, "/out/g1.mafft.codon.trimmed.aln.fasta"), (2, "g2.aln.fasta"), (3, "other.fasta")], "locus long, file string")
    found = provenance.with_provenance(records({1: [("A", "-"), ("a", "-")], 2: [("b", "-")], 3: [("A", "-")]}), files, index)
    got = {(r["locus"], r["seq_id"]): (r["audited_terminal_stop"], r["audited_internal_stop"]) for r in found.collect()}
    assert got == {(1, "A"): ("7-9-TAA", "4-6-TGA;1-3-TAG"), (1, "a"): ("NA", "NA"), (2, "b"): ("NA", "5-*"), (3, "A"): ("NA", "NA")}
    provenance.check_collisions(changes)
    with pytest.raises(ValueError, match="g1: /in/g1.fasta, /other/g1.fa"):
        provenance.check_collisions(changes.union(_changes(spark, ("/other/g1.fa", "source", "a", "A", "terminal_stop", "1", None, "TAA"))))
    with pytest.raises(ValueError, match="original"):
        provenance.stop_index(changes.drop("original"))


def test_details_have_fixed_columns_and_ordered_findings(spark, records):
    r = records({1: [("a", "ATGTAAGCT"), ("b", "TGATAGTAA"), ("c", "ATGGCTGCA")], 2: [("a", "ATGGCA"), ("b", "ATGGCC")]})
    files = spark.createDataFrame([(1, "/o/g1.fasta"), (2, "/o/g2.fasta")], "locus long, file string")
    index = provenance.stop_index(_changes(spark, ("/in/g2.fasta", "source", "b", "NA", "internal_stop", "4-6", None, "TAA")))
    for piece in (1, 4096):
        rows = {x["locus"]: x for x in qc_details(r, files, Gate("codon"), index, piece).collect()}
        assert rows[1]["Terminal_stop"] == "b-TAA" and rows[1]["Internal_stop_count"] == "a-inter-2-TAA;b-inter-1-TGA;2-TAG"
        assert rows[2]["Audited_internal_stop"] == "b-4-6-TAA" and rows[2]["Audited_terminal_stop"] == "NA" and rows[2]["Issues"] == "internal_stop"
    details = qc_details(r, files, Gate("nucl"))
    assert details.columns == ["locus", "passed", *columns("nucl")] and "Terminal_stop" not in details.columns
    passed, failed = path_lists(details)
    assert sorted(x["file"] for x in passed.collect()) == ["/o/g1.fasta", "/o/g2.fasta"] and failed.count() == 0
    assert columns("prot")["X_ratio"] == "x_ratio" and list(columns("prot"))[-3:] == ["Audited_terminal_stop", "Audited_internal_stop", "Issues"]
    assert finding_texts(r.withColumn("what", F.lit("NA")), "what").count() == 0


def _text(folder):
    """What the part files of a folder hold, one after the other."""
    parts = sorted(x for x in os.listdir(folder) if x.startswith("part-"))
    return "".join(open(os.path.join(folder, x), encoding="utf-8").read() for x in parts)


def test_one_scan_writes_both_formats_and_the_changes(spark, records, tmp_path):
    r = records({1: [("tax 1", "acgu" * 40), ("b", "RCG?" * 40)], 2: [("x", "AC"), ("y", "-T")]})
    r = r.withColumn("seq_id", F.replace("seq_id", F.lit(" "), F.lit("-")))
    done = export_formats(r, str(tmp_path / "out"), "DNA", F.concat(F.lit("/in/"), "locus"))
    assert (done.records, done.edits) == (4, 80)
    assert {tuple(x) for x in done.loci.collect()} == {(1, 2, 160, 80), (2, 2, 2, 0)}
    folder = f"{tmp_path}/out/lines/sink="
    assert _text(f"{folder}phylip/locus=1") == f"2 160\ntax-1  {'ACGT' * 40}\nb  {'NCG?' * 40}\n"
    blocks = "".join(f"'tax-1' {('ACGT' * 40)[k : k + 70]}\nb       {('NCG?' * 40)[k : k + 70]}\n\n" for k in (0, 70, 140))
    head = "#NEXUS\n\nbegin data;\n  dimensions ntax=2 nchar=160;\n  format datatype=dna missing=? gap=- interleave;\n  matrix\n"
    assert _text(f"{folder}nexus/locus=1") == f"{head}{blocks}  ;\nend;\n"
    changes = _text(f"{folder}changes/locus=1").splitlines()
    assert len(changes) == 81 and changes[0].startswith("input_file\ttaxa_id\tevent") and changes[1] == "/in/1\ttax-1\turacil_to_thymine\t4-4\tu\tT\treplace\tNA\tsource"
    assert changes[41] == "/in/1\tb\tnucleotide_ambiguity\t1-1\tR\tN\treplace\tNA\tsource"
    assert not os.path.exists(f"{folder}changes/locus=2")


@pytest.mark.parametrize("kind, seq, out, edit", [("RNA", "ACGT", "ACGU", "i\ta\tthymine_to_uracil\t4-4\tT\tU\treplace\tNA\tsource"), ("protein", "acB?", "ACX?", "i\ta\tprotein_unsupported_residue\tNA\tB\tX\treplace\tNA\tsource\t3-3")])
def test_exports_of_other_kinds(records, tmp_path, kind, seq, out, edit):
    export_formats(records({1: [("a", seq)]}), str(tmp_path / "out"), kind, F.lit("i"))
    assert f"a  {out}\n" in _text(f"{tmp_path}/out/lines/sink=phylip/locus=1")
    assert _text(f"{tmp_path}/out/lines/sink=changes/locus=1").splitlines()[1:] == [edit]


@pytest.mark.parametrize("rows, fault", [([("a", "AC"), ("a", "AC")], "duplicate ids"), ([("a", "AC"), ("b", "A")], "unequal lengths"), ([("a", "")], "empty")])
def test_exports_refuse_what_is_no_alignment(records, tmp_path, rows, fault):
    with pytest.raises(ValueError, match=f"locus 4: {fault}"):
        export_formats(records({4: rows}), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out/lines")


@pytest.mark.parametrize("kind", ["DNA", "RNA", "protein"])
def test_lines_of_edits_are_made_without_shuffling_edits(records, kind):
    """An edit is a row of the result only: before, arrays of all edits passed through the shuffles."""
    loci = {1: [("a-1", "acgu" * 40), ("b", "RCG?" * 40)], 2: [("x", "\u017fc\u00e9-t\u0131u"), ("y", "u1RT*.B")], 3: [("p", "A"), ("q", "")]}
    spool = prepared(records(loci), kind)
    assert dict(spool.dtypes)["edits"] == "int"
    found = export_lines(spool, counts(spool), kind, F.lit("f"), width=7)
    assert "array<struct<pos" not in found._jdf.queryExecution().analyzed().treeString()
    keep, event, to = {"DNA": ("", "uracil_to_thymine", "T"), "RNA": ("", "thymine_to_uracil", "U"), "protein": ("ACDEFGHIKLMNPQRSTVWYX?-", "", "")}[kind]
    wanted = set()
    for locus in (1, 2):
        rows, some = loci[locus], False
        for k, (name, seq) in enumerate(rows):
            out = ""
            for at, c in enumerate(seq, 1):
                up, edit = c.upper(), None
                if kind == "protein":
                    edit = None if up in keep else ("protein_unsupported_residue", "X", "NA", f"\t{at}-{at}")
                elif up == ("T" if kind == "RNA" else "U"):
                    edit = (event, to, f"{at}-{at}", "")
                elif up in "RYSWKMBDHV":
                    edit = ("nucleotide_ambiguity", "N", f"{at}-{at}", "")
                out += edit[1] if edit else up
                if edit:
                    some = True
                    wanted.add((locus, "changes", k + 1, at, f"f\t{name}\t{edit[0]}\t{edit[2]}\t{c}\t{edit[1]}\treplace\tNA\tsource{edit[3]}"))
            wanted.add((locus, "phylip", k + 1, 0, f"{name}  {out}"))
            label = (f"'{name}'" if "-" in name else name).ljust(5 if locus == 1 else 1)
            wanted |= {(locus, "nexus", i // 7 + 1, k, f"{label} {out[i : i + 7]}" + "\n" * (k == len(rows) - 1)) for i in range(0, len(out), 7)}
        n = len(rows[0][1])
        head = f"#NEXUS\n\nbegin data;\n  dimensions ntax=2 nchar={n};\n  format datatype={'protein' if kind == 'protein' else kind.lower()} missing=? gap=- interleave;\n  matrix"
        wanted |= {(locus, "phylip", 0, 0, f"2 {n}"), (locus, "nexus", 0, 0, head), (locus, "nexus", -(-n // 7) + 1, 0, "  ;\nend;")}
        if some:
            wanted.add((locus, "changes", 0, 0, "\t".join([*EVENT_FIELDS, *["source_aa_positions"] * (kind == "protein")])))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_rows_are_streamed_over_several_parts(spark, records, tmp_path):
    r = records({k: [(f"t{j}", "ACGT"[j % 4] * (50 + k)) for j in range(6) if (j + k) % 5] for k in range(40)})
    m = concat.supermatrix(r)
    pieces = phylip_pieces(m, concat.taxa(r), concat.partitions(r))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_pieces(pieces, str(tmp_path / "matrix"), "first_locus", "first_record", "start")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = {x["taxon"]: x["seq"] for x in concat.rows(m).collect()}
    order = [x["taxon"] for x in concat.taxa(r).orderBy("first").collect()]
    wanted = f"{len(order)} {len(whole[order[0]])}\n" + "".join(f"{t} {whole[t]}\n" for t in order)
    assert _text(tmp_path / "matrix") == wanted
    parts = [x for x in os.listdir(tmp_path / "matrix") if x.startswith("part-")]
    assert len(parts) > 1 and any(not open(tmp_path / "matrix" / x).read().endswith("\n") for x in parts)
    with pytest.raises(Exception, match="has parts already"):
        write_pieces(pieces, str(tmp_path / "matrix"), "first_locus", "first_record", "start")
    write_pieces(pieces.limit(1), str(tmp_path / "matrix"), "start", overwrite=True)
    assert _text(tmp_path / "matrix") == "6 2780\n" and sorted(os.listdir(tmp_path / "matrix")) == ["_SUCCESS", "part-0000000"]


def _faults(spark, text, **more):
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(text.split("\n"), 1)], "file string, line long, value string")
    return {(r["line"], r["fault"]) for r in spool.spool_faults(lines, **more).collect()}


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_faults_of_sequence_files(spark, piece):
    assert _faults(spark, ">a x\nAC\n\n G T\t\n>b\nacgt", piece=piece) == set()
    text = "AC\n>a\nACGT\n>b\nAC\nG\n>\nACGT\n>a\nAC\u00e9T\n>c\n>d\nACGT"
    wanted = {(1, "sequence before the first header"), (4, "not as long as the first record"), (7, "empty id"), (9, "id of an earlier record"), (10, "letters beyond ASCII"), (11, "empty record")}
    assert _faults(spark, text, piece=piece) == wanted
    assert _faults(spark, "\n \n", piece=piece) == {(0, "no records")}
    assert _faults(spark, ">" + "a" * 30 + "\nA", piece=piece, header_bytes=31) == {(1, "header is too long")}
    assert _faults(spark, ">" + "a" * 29 + "\nA", piece=piece, header_bytes=31) == set()


def test_lines_of_files_read_in_pieces_make_records(spark, tmp_path):
    wanted = {}
    for k in range(3):
        rows = [(f"t{j}", "".join("ACGT"[(i * i + j + k) % 4] for i in range(700))) for j in range(5)]
        wanted[f"f{k}.fa"] = rows
        (tmp_path / f"f{k}.fa").write_text("".join(f">{n} text\n" + "\n".join(s[i : i + 61] for i in range(0, 700, 61)) + "\n" for n, s in rows))
    (tmp_path / "bad.fa").write_text(">x\nA\n>x\nA\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = spool.file_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        faults = spool.spool_faults(lines)
        assert [(r["file"].rsplit("/", 1)[1], r["line"]) for r in faults.collect()] == [("bad.fa", 3)]
        got = {}
        for r in spool.spooled_records(lines, faults, piece=7).orderBy("record_order").collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["seq_id"], r["seq"]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == wanted


def test_lines_are_read_twice_at_most_and_shuffled_once(spark, tmp_path):
    """Before, every branch of the checks and records read and shuffled all lines for itself."""
    rng = random.Random(5)
    for k in range(12):
        n = rng.choice([3, 40, 200])
        some = [">" + rng.choice(["a", "b", "c\tx", " d", "", "\u00e9"]) + str(rng.randrange(9)) * rng.randrange(2) if rng.random() < 0.2 else rng.choice(["AC", "", " A\x0bC\r", "G\u00e9", "-" * 90]) for _ in range(n)]
        (tmp_path / f"f{k}.fa").write_text("\n".join(some if k % 3 else [">only", *["ACGT "] * n]), newline="")
    lines = spark.read.text(str(tmp_path), wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value")).selectExpr("file", "line + 1L as line", "value")
    found = spool.spooled_records(lines, spool.spool_faults(lines, piece=7), piece=7)
    rows = {tuple(r) for r in found.collect()}
    wanted, faults = set(), set()
    for name, whole in ((r["file"], r["value"]) for r in spark.read.text(str(tmp_path), wholetext=True).select(F.input_file_name().alias("file"), "value").collect()):
        records, ids, bad = [], {}, set()
        for at, value in enumerate(whole.split("\n"), 1):
            chunk = re.sub(r"[ \t\x0b\f\r]+", "", value)
            if value.startswith(">"):
                seq_id = re.search(r"[^ \t\x0b\f\r\n]+|$", value[1:]).group()
                records.append([at, seq_id, ""])
                bad |= {(at, len(records), "empty id")} if not seq_id else set()
                bad |= {(at, len(records), "id of an earlier record")} if seq_id and ids.setdefault(seq_id, at) != at else set()
                continue
            if not records and chunk:
                bad.add((at, 0, "sequence before the first header"))
            elif not chunk.isascii():
                bad.add((at, len(records), "letters beyond ASCII"))
            if records:
                records[-1][2] += chunk
        for k, (at, _, seq) in enumerate(records, 1):
            bad |= {(at, k, "empty record")} if not seq else {(at, k, "not as long as the first record")} if len(seq) != len(records[0][2]) else set()
        bad |= set() if records else {(0, 0, "no records")}
        faults |= {(name, *b) for b in bad}
        wanted |= set() if bad else {(name, k, i, seq.upper()) for k, (_, i, seq) in enumerate(records)}
    got = [(r["file"], r["line"], r["record"], r["fault"]) for r in spool.spool_faults(lines, piece=7).collect()]
    assert len(got) == len(faults) and set(got) == faults
    assert rows == wanted and len(rows) >= 4
    plan = found._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan
    marks = re.findall(r"Scan text|ReusedExchange", plan.toString().split("Initial Plan")[0])
    assert marks.count("Scan text") <= 2 and "ReusedExchange" in marks


def test_mapping_snapshot_hashes_what_it_parses(spark, tmp_path):
    import hashlib

    path = tmp_path / "map.tsv"
    path.write_bytes(b"#old\tnew\r\na:1\tA(1)\nb\tB\n\nb\tB\n")
    mapping, signature = snapshot.mapping_snapshot(spark, str(path), str(tmp_path / "w1"))
    assert sorted(tuple(r) for r in mapping.collect()) == [("a_1", "A_1_"), ("b", "B")]
    row = signature.first()
    assert (row["size"], row["sha256"]) == (path.stat().st_size, hashlib.sha256(path.read_bytes()).hexdigest())
    path.write_text("a\tA\na\tB\nc\n")
    with pytest.raises(ValueError, match=":2: more than one name for a"):
        snapshot.mapping_snapshot(spark, str(path), str(tmp_path / "w2"))


def test_files_that_change_while_they_are_read_are_refused(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in "abc":
        (folder / name).write_text(name)
    now = snapshot.stamps

    def meddled(session, path):
        time.sleep(0.01)
        (folder / "a").write_text("longer")
        (folder / "b").unlink()
        (folder / "d").write_text("new")
        return now(session, path)

    monkeypatch.setattr(snapshot, "stamps", meddled)
    with pytest.raises(ValueError, match="/a was changed"):
        snapshot.snapshot(spark, str(folder), str(tmp_path / "w"))
    table = spark.read.parquet(str(tmp_path / "w"))
    assert {(r["path"][-1], r["fault"]) for r in snapshot.changed(table, now(spark, str(folder))).collect()} == {("a", "changed"), ("b", "removed"), ("d", "added")}


def test_units_without_outputs_are_done(spark):
    wanted = spark.createDataFrame([("u", "1", "s", None), ("w", "1", "s", "c")], "unit string, version string, input_sha256 string, configuration string")
    manifest = wanted.withColumns({"output": F.lit(None).cast("string"), "output_sha256": F.lit(None).cast("string")})
    now = spark.createDataFrame([], "output string, sha256 string")
    assert snapshot.to_resume(wanted, manifest, now).count() == 0
    assert {tuple(r) for r in snapshot.to_resume(wanted, manifest.where("unit = 'u'"), now).collect()} == {("w", "new")}


def test_paired_report_and_what_a_side_keeps(spark):
    side = "locus string, file string, passed boolean, parsimony_informative_sites long"
    codon = spark.createDataFrame([("a", "/c/a", True, 5), ("b", "/c/b", True, 9), ("d", "/c/d", False, 9), ("e", "/c/e", True, 1)], side)
    protein = spark.createDataFrame([("a", "/p/a", True, 3), ("b", "/p/b", True, 0), ("c", "/p/c", True, 9), ("e", "/p/e", True, 1)], side)
    for policy, passed in (("both", {"a"}), ("either", {"a", "b"}), ("codon", {"a", "b"}), ("protein", {"a"})):
        rows = {r["Locus"]: r for r in paired.paired_report(codon, protein, policy, 5, 3).collect()}
        assert {k for k, r in rows.items() if r["Paired_status"] == "pass"} == passed and set(rows) == set("abcde")
    assert (rows["c"]["Codon_file"], rows["c"]["Codon_PIS"], rows["c"]["Reasons"]) == ("NA", "NA", "codon_qc_failed;pis_policy_failed")
    assert rows["d"]["Reasons"] == "codon_qc_failed;protein_qc_failed;pis_policy_failed" and rows["a"]["Reasons"] == "NA"
    assert tuple(paired.paired_report(codon, protein).columns) == paired.COLUMNS
    assert sorted(r["locus"] for r in paired.independent(codon, 5).collect()) == ["a", "b"]
    assert {tuple(r) for r in paired.site_faults(codon.union(codon.limit(1)), protein).collect()} == {("c", "missing"), ("d", "unexpected"), ("a", "twice")}


@pytest.mark.parametrize("args", [("codon", "most"), ("prot", "both", 1), ("nucl", "both", None, 0), ("nucl", "either"), ("codon", "both", -1)])
def test_options_that_do_not_apply_are_refused(args):
    with pytest.raises(ValueError):
        paired.check_options(*args)
    paired.check_options("pseudogene", "either", 0, 3)


MEMBERS, SEQUENCES = "orthogroup string, taxon string, taxon_order int, gene string, gene_order int", "taxon string, gene string, seq string"


def test_orthogroup_sets_are_checked_and_written_whole(spark, tmp_path):
    members = [("OG1", "t:x", 0, "g1", 0), ("OG1", "t:x", 0, "g2", 1), ("OG1", "b", 1, "h", 0), ("OG2", "b", 1, "h2", 0)]
    sequences = spark.createDataFrame([("t:x", "g1", "ACGN"), ("t:x", "g2", "acgtRR"), ("b", "h", "AC"), ("b", "h2", "AAA")], SEQUENCES)
    found = orthoset.prepared(spark.createDataFrame(members, MEMBERS), sequences, longest=True)
    assert found.faults.count() == 0
    orthoset.write_set(found, str(tmp_path / "set"), longest=True)
    assert _text(tmp_path / "set/sequences/orthogroup=OG1") == ">t_x_g2 taxon=t:x orthogroup=OG1\nacgtRR\n>b_h taxon=b orthogroup=OG1\nAC\n"
    assert _text(tmp_path / "set/map") == "t_x_g2\tt:x\nb_h\tb\nb_h2\tb\n" and _text(tmp_path / "set/paths").count("orthogroup=OG") == 2
    assert "OG1\tt:x\tg1\t4\t3\tcodon\tno" in _text(tmp_path / "set/copy_selection") and "OG1\tt:x\tg2\t6\t4\tcodon\tyes" in _text(tmp_path / "set/copy_selection")
    odd = [("OG1", "a", 0, "g", 0), ("OG1", "b", 1, "g", 0), ("OG2", "a", 0, "no", 0), ("OG3", "b", 1, "s p", 0)]
    sequences = spark.createDataFrame([("a", "g", "A"), ("b", "g", "C"), ("b", "s p", "C")], SEQUENCES)
    found = orthoset.prepared(spark.createDataFrame(odd, MEMBERS), sequences, keep_taxon=False)
    assert {tuple(r) for r in found.faults.collect()} == {("OG1", "a", "g", "name used twice"), ("OG1", "a", "g", "name of several taxa"), ("OG2", "a", "no", "no sequence"), ("OG3", "b", "s p", "white space in the name")}
    with pytest.raises(ValueError, match="OG1: name of several taxa: g of a"):
        orthoset.write_set(found, str(tmp_path / "odd"))
    assert not (tmp_path / "odd").exists()
    twice = orthoset.prepared(spark.createDataFrame(members[:2] + members[:1], MEMBERS), spark.createDataFrame([("t:x", "g1", "A"), ("t:x", "g2", "C")], SEQUENCES), longest=True)
    assert [r["fault"] for r in twice.faults.collect()] == ["gene named twice"]


def test_taxon_lists_json_reports_and_marked_headers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# taxa\n\n Homo sapiens \n#x\nMus\n")
    (tmp_path / "b.txt").write_text("Mus\n")
    (tmp_path / "none.txt").write_text("#\n \n")
    assert tables.taxon_list(spark, str(tmp_path / "a.txt")) == ["Homo sapiens", "Mus"]
    with pytest.raises(ValueError, match="more than once: Mus"):
        tables.taxon_list(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
    with pytest.raises(ValueError, match="no taxa"):
        tables.taxon_list(spark, str(tmp_path / "none.txt"))
    (tmp_path / "r.json").write_text('{"version": 1,\n "items": [1, 2]}')
    assert tables.json_report(spark, str(tmp_path / "r.json"), "version").first()["items"] == [1, 2]
    with pytest.raises(ValueError, match="missing fields: other"):
        tables.json_report(spark, str(tmp_path / "r.json"), "other")
    (tmp_path / "d.tsv").write_bytes("﻿File\tIssues\n/x\tNA\n".encode())
    assert tables.qc_details(spark, str(tmp_path / "d.tsv"), "File").columns == ["File", "Issues"]


def test_change_reports_of_proteins_have_residue_positions(spark, records):
    report = reports.change_report(normalize.protein_events(records({1: [("a", "AB*")]})), F.lit("/in/x"), protein=True)
    assert report.columns == [*EVENT_FIELDS, "source_aa_positions"]
    assert {(r["event"], r["source_nt_positions"], r["source_aa_positions"], r["genetic_code"]) for r in report.collect()} == {("protein_unsupported_residue", "NA", "2-2", "NA"), ("protein_terminal_stop", "NA", "3-3", "NA")}
