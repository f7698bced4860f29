"""Aligning loci with an external program, one locus a task group.

The program gets the path of a FASTA file and the path to write to.  What comes back must hold the same residues
under the same ids; otherwise the locus is reported, not kept.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from lociweave.model import RECORDS
from lociweave.sources.fasta import parse

#: Command lines by name; {input}, {output} and {threads} are filled in.
PROGRAMS = {
    "mafft": "mafft --quiet --auto --thread {threads} {input}",
    "muscle": "muscle -align {input} -output {output} -threads {threads}",
    "prank": "prank -d={input} -o={output}",
    "clustalw2": "clustalw2 -INFILE={input} -OUTFILE={output} -OUTPUT=FASTA",
}
RESULT = RECORDS + ", fault string"


def command(program: str, threads: int = 1) -> Callable[[str, str], None]:
    """Runs one of PROGRAMS, or a path to a program with the arguments input and output; standard output counts if it writes no file."""
    template = PROGRAMS.get(program, program + " {input} {output}")

    def run(source: str, target: str) -> None:
        words = [w.format(input=source, output=target, threads=threads) for w in template.split()]
        if shutil.which(words[0]) is None:
            raise FileNotFoundError(f"{words[0]} is not installed on this executor")
        done = subprocess.run(words, capture_output=True, check=True)
        if not Path(target).exists():
            Path(target).write_bytes(done.stdout)

    return run


def align(records: DataFrame, run: Callable[[str, str], None]) -> DataFrame:
    """records of aligned loci, and a row with a fault for each locus that the program has not kept whole.

    A locus is one group and has to fit in a task: an alignment program needs it whole as well.
    """

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("record_order")
        locus = pdf["locus"].iloc[0]
        names, before = list(pdf["seq_id"]), [s.replace("-", "").upper() for s in pdf["seq"]]
        try:
            with tempfile.TemporaryDirectory() as folder:
                source, target = Path(folder, "in.fasta"), Path(folder, "out.fasta")
                source.write_text("".join(f">{n}\n{s}\n" for n, s in zip(names, before, strict=True)))
                run(str(source), str(target))
                found = dict(parse(target.read_text().splitlines()))
            fault = None if sorted(found) == sorted(names) and all(found[n].replace("-", "").upper() == s for n, s in zip(names, before, strict=True)) else "content changed"
            fault = fault or (None if len({len(x) for x in found.values()}) == 1 else "unequal lengths")
        except (OSError, ValueError, subprocess.CalledProcessError) as error:
            found, fault = {}, f"{type(error).__name__}: {error}"[:300]
        rows = [(locus, k, n, found[n], None) for k, n in enumerate(names)] if fault is None else [(locus, None, None, None, fault)]
        return pd.DataFrame(rows, columns=["locus", "record_order", "seq_id", "seq", "fault"]).astype({"record_order": "Int32"})

    return records.select("locus", "record_order", "seq_id", "seq").groupBy("locus").applyInPandas(one, RESULT)
