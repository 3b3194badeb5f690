"""Secret scans through an incremental ledger of blobs.

Every version of a text is a blob, addressed by the SHA-256 of its content; the rows that hold it are its paths. The
ledger is a Parquet table with a row for each scan of a blob: which versions of which rules were run, and what
they found. A scan takes the distinct blobs of its input, leaves out the pairs of blob and rule version
that the ledger has, runs the others, appends them, and joins findings back to all paths.

Defined results: null counts as empty. Rows are paths, so repeated rows and null ids each get their findings. An empty
table gives an empty result and appends nothing. Texts of any length are scanned whole; every rule's time is in proportion to the text. Other columns are carried along. Findings of different rules may overlap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pylist, shared_dir, slices, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least characters of the group; shorter matches are dropped.
    least: int = 0
    group: int = 0
    any_case: bool = False
    #: The group that is the secret; what stands before it in a match only places it.
    span: int = 0

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr(self).encode()).hexdigest()[:12]}"

    def spans(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        return [m.span(self.span) for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base rules, in the order that their findings at one place have, and the ones that the method adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    # From BEGIN to the END line of the same label; where that is missing, or another BEGIN comes first, to the end of the headers and base64 that follow.
    Rule("pem", r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1-----|(?:(?:\s|\\[rn])*(?:(?:Proc-Type|DEK-Info):[^\n]*|[A-Za-z0-9+/]{16,}={0,2}))*(?:\s*\n[A-Za-z0-9+/]{1,15}={0,2}(?=\s*(?:\n|\Z)))?)"),
    Rule("vcs", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    # Tried once a run of letters, from its first eyJ: a later one in the run has the same dots after it.
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", span=1),
    Rule("cloud", "AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + ADDED
SCANS = "blob string, versions array<string>, findings array<struct<version string, start int, end int>>"


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger's rows; none where nothing was ever scanned."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(SCANS).parquet(path) if fs.exists(where) else spark.createDataFrame([], SCANS)


def scan_into(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Appends to the ledger all pairs of a blob of `docs` and a rule version that it lacks."""
    spark = docs.sparkSession
    wanted = [r.version for r in rules]
    blobs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    seen = read_ledger(spark, ledger).select("blob", F.explode("versions").alias("version")).where(F.col("version").isin(wanted)).groupBy("blob").agg(F.collect_set("version").alias("seen"))
    unseen = blobs.join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(wanted))
    kind = pa.list_(pa.struct([("version", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        compiled = [(r, r.version, r.compiled()) for r in rules]
        for batch in slices(batches, "text"):
            versions, findings = [], []
            for text, had in zip(pylist(batch, "text"), pylist(batch, "seen")):
                todo = [x for x in compiled if not had or x[1] not in had]
                versions.append([v for _, v, _ in todo])
                findings.append([{"version": v, "start": a, "end": b} for r, v, p in todo for a, b in r.spans(text, p)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(versions, pa.list_(pa.string())), pa.array(findings, kind)], names=["blob", "versions", "findings"])

    unseen.select("blob", "text", "seen").mapInArrow(run, SCANS).write.mode("append").parquet(ledger)


def found_in(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of `docs`, and `found`: array<struct<start, rank, kind, end>> in order of start and rule, from the ledger. A column `found` of `docs` is named `found own`."""
    spark = docs.sparkSession
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.version, k)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    findings = (
        read_ledger(spark, ledger)
        .select("blob", F.explode("findings").alias("f"))
        .where(F.col("f.version").isin([r.version for r in rules]))
        .withColumn("rank", order[F.col("f.version")])
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(F.struct("f.start", "rank", F.element_at(kinds, F.col("rank") + 1).alias("kind"), "f.end"))).alias("found"))
    )
    paths = docs.withColumnsRenamed({c: f"{c} own" for c in docs.columns if c.lower() == "found"}).withColumn("blob of text", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    # Nothing above this join needs a blob's paths together, so that adaptive execution can split a blob with many paths.
    return paths.join(findings.withColumnRenamed("blob", "blob of text"), "blob of text", "left").drop("blob of text")


def scanned(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of `docs` and `found`. Without a ledger, one is begun in the shared folder."""
    ledger = ledger or f"{shared_dir(docs.sparkSession)}/secret-ledger-{uuid.uuid4().hex}"
    scan_into(docs, ledger, rules)
    return found_in(docs, ledger, rules)


def redacted(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with every found span, overlapping ones as one, replaced by [secret]; texts without findings stay as they are, null included."""
    own = {c: f"{c} own" for c in docs.columns if c.lower() == "found"}
    found = scanned(docs, ledger, rules)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def clean(text, ss):
            if text is None or ss is None:
                return text
            out, at = [], 0
            for s in ss:
                if s["end"] <= at:
                    continue
                if s["start"] >= at:
                    out += [text[at : s["start"]], "[secret]"]
                at = s["end"]
            return "".join([*out, text[at:]])

        return pd.Series([clean(t, s) for t, s in zip(texts, spans)], dtype=object)

    return found.withColumn("text", cleaned(F.col("text").cast("string"), "found")).drop("found").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))
    base = F.filter(found, lambda x: x["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scanned(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"))
