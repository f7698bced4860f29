"""Secret scans over a stored ledger of content-addressed blobs, with Spark SQL functions only.

Every version of every path is addressed by the SHA-256 of its text.  The ledger, a folder of two tables, says which
rule, in which version, has been run over which blob, and what was found.  Only pairs that it lacks are scanned, each
blob once however many paths hold it; findings, new and old, are joined back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociweave.llm.bloom import among, parted
from lociweave.llm.common import scratch_dir, with_groups, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those whose group has fewer than least characters don't count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Letters in either case, spelled out: an ignore-case flag would bring in letters beyond ASCII in some engines.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}", least=16),  # a run of 16 or more is what [0-9a-f]+ matches there
)
#: What the ledger's rule set has beyond the base.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE

SEEN, FOUND = "blob binary, rule string", "blob binary, rule string, start int, end int"


def address(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _matches(text: Column, rule: Rule, pending: Column) -> Column:
    """array<struct<gap, length, ok>> in order: gap is the text between a match and the one before."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    if rule.group:
        length = lambda m: F.length(F.regexp_extract(m, f"^(?:{rule.pattern})", rule.group))
    else:
        length = F.length
    # the piece after the last match pairs with a null, which the filter drops
    zipped = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("length"), (length(m) >= rule.least).alias("ok")))
    zipped = F.filter(zipped, lambda x: x["length"].isNotNull())
    return F.when(pending & F.regexp_like(text, pattern), zipped)


def _named(rules: tuple[Rule, ...], value) -> Column:
    return F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, value(k, r))])[F.col("rule")]


def scan(versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(additions, findings): the pairs of blob and rule that seen (blob, rule) lacks, and what scanning them found.

    findings: blob, rule, start, end (code points, end exclusive).  A null text is the empty blob.  A text that one
    row has is scanned where it lies; of one that several rows have a copy is taken, grouped before and after a
    shuffle.  With seen, a filter of bounded size over the lacking pairs tells in place which rules a text is for;
    the few pairs that pass it without being lacking are dropped afterwards.
    """
    rows = versions.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("blob", address(F.col("text")))
    counts = rows.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    lacking = counts.select("blob", "n", F.explode(F.array(*[F.lit(r.name) for r in rules])).alias("rule"))
    if seen is not None:
        lacking = lacking.join(seen.select("blob", "rule"), ["blob", "rule"], "left_anti")
    lacking = written(lacking)
    if seen is not None:
        rows = parted(rows, "blob", written(lacking.select("blob").distinct()))[1]
    alone, copies = parted(rows, "blob", written(lacking.where("n > 1").select("blob").distinct()))
    blobs = alone.select("blob", "text").union(copies.groupBy("blob").agg(F.first("text").alias("text")).select("blob", "text"))
    pending = [F.lit(True)] * len(rules)
    if seen is not None:
        for k, r in enumerate(rules):
            blobs = among(blobs, "blob", written(lacking.where(F.col("rule") == r.name).select("blob")), f"p{k}")
        pending = [F.col(f"p{k}") for k in range(len(rules))]
    each = [F.struct(F.lit(r.name).alias("rule"), _matches(F.col("text"), r, p).alias("matches")) for r, p in zip(rules, pending, strict=True)]
    scanned = written(blobs.select("blob", F.explode(F.array(*each)).alias("x")).select("blob", "x.*").where("matches is not null"))
    if seen is not None:
        scanned = scanned.join(lacking, ["blob", "rule"], "left_semi")
    one = scanned.select("blob", "rule", F.posexplode("matches").alias("k", "m"))
    upto = Window.partitionBy("blob", "rule").orderBy("k")
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(upto).cast("int")
    findings = one.withColumn("end", end).where("m.ok").select("blob", "rule", (F.col("end") - F.col("m.length")).alias("start"), "end")
    return lacking.select("blob", "rule"), findings


def _stored(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{schema}, batch string").parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(seen, findings) of a ledger; null for both of a new one.

    A batch counts once its pairs are there, which are written last: one that broke off is scanned anew.
    """
    seen = _stored(spark, folder, "seen", SEEN)
    if seen is None:
        return None, None
    findings = _stored(spark, folder, "findings", FOUND)
    return seen, findings.join(F.broadcast(seen.select("batch").distinct()), "batch", "left_semi")  # one row a run of update()


def update(folder: str, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger in folder lacks and adds it there; returns the added pairs (blob, rule).

    Runs may overlap or be repeated: each adds a batch of its own, and what two of them have found is the same.
    """
    spark = versions.sparkSession
    seen, _ = stored(spark, folder)
    added, findings = scan(versions, text, rules, seen)
    batch = f"b{uuid.uuid4().hex}"
    findings.write.parquet(f"{folder}/findings/batch={batch}")
    added.write.parquet(f"{folder}/seen/batch={batch}")
    return added


def findings_by_path(versions: DataFrame, findings: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Per row of versions: path, n_<kind> for the base kinds, base_sha256 of the base spans and spans, all of them.

    findings: blob, rule, start, end; those of other rules or versions don't count, and repeated ones count once.  A span is kind:start:end; spans
    are ordered by start, then by the rank of the kind in rules, and joined by commas.
    """
    kinds = [r.kind for r in base]
    ranked = findings.where(F.col("rule").isin([r.name for r in rules])).select("blob", "start", _named(rules, lambda k, r: k).alias("rank"), "end", _named(rules, lambda k, r: r.kind).alias("kind"))
    # a set: runs that scanned a blob at the same time have both kept its findings
    spans = F.array_sort(F.collect_set(F.struct("start", "rank", "end", "kind")))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    per_blob = ranked.groupBy("blob").agg(spans.alias("all"))
    per_blob = written(per_blob.select("blob", *map(count, kinds), line(F.filter("all", lambda x: x["kind"].isin(kinds))).alias("base"), line(F.col("all")).alias("spans")))
    held = versions.select(F.col(f"`{path}`").alias("path"), address(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("blob"))
    clean, maybe = parted(held, "blob", per_blob.select("blob"))
    maybe = written(maybe)
    groups = written(maybe.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).join(per_blob, "blob", "left"))
    empty = {"n": F.lit(0).cast("long"), **{f"n_{k}": F.lit(0).cast("long") for k in kinds}, "base": F.lit(""), "spans": F.lit("")}
    joined = clean.withColumns(empty).unionByName(with_groups(maybe, groups, "blob", "n"))
    return joined.select(
        F.col("path").alias(path),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def scan_documents(docs: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, folder: str | None = None) -> DataFrame:
    """The findings of every row of docs, by way of the ledger in folder: what it lacks is scanned and added first.

    One row a row of docs, repeated ones too, in the columns of findings_by_path(); other columns aren't read.  A null
    text is an empty one and has no findings; a null path is returned as it is.  Matches that start at the same place
    are ordered by the rank of their rule.  Without a folder the ledger is a new one in the shared folder.  The scan
    runs and the ledger grows when this is called.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    update(folder, docs, text, rules)
    return findings_by_path(docs, stored(spark, folder)[1], path, text, rules)
