"""Incremental secret scans over a ledger of content-addressed blobs.

Every historical version of a text is addressed by its SHA-256. A ledger, a stored table, has one row for each pair of
blob and rule version that was ever scanned, with the spans found. A scan selects the unseen pairs with slim rows only,
scans one representative row of each, appends to the ledger and joins the findings back to all paths of each blob;
copies and old versions are never scanned twice.

Texts that lack every anchor of the rules (a screen by one expression in the same pass that addresses them) enter the
ledger without a further scan, so only texts with an anchor whose blob is unseen are ever moved.

Spans are code points with the end exclusive, leftmost and without overlap within a kind. Defined results: null is an
empty text; rows with a null or a repeated doc_id keep their own result rows; very long texts are scanned whole; an
empty table gives an empty result and adds nothing to the ledger; a ledger whose rows were appended twice counts them
once; columns other than doc_id (or the named keys) and text are ignored by ``scan`` and passed through by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.chunks import bounded_batches, texts_of
from tideline.session import Scratch

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs; shorter ones than 24 would be dropped in any case.
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex")
COUNTS = ("n_assign", "n_access", "n_hex")
RULES = hashlib.sha256("\n".join((ASSIGN.pattern, ACCESS.pattern, HEX.pattern, "6 20 24")).encode()).hexdigest()[:16]
#: What a text with a secret of each kind has at least, the cheapest first; for Java, whose (?i) is about ASCII.
ANCHORS = (
    (("=", ":"), (r"""[dtnyDTNY]["']?\x20*[:=]""", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""")),
    (("AKIA",), ("AKIA[A-Z0-9]{16}",)),
    ((), ("[0-9a-f]{24}",)),
)
LEDGER = "blob string, rules string, n_assign long, n_access long, n_hex long, spans string"


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, number of the kind in KINDS and end of every secret, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def suspect(text: Column) -> Column:
    """Whether a text has an anchor of a rule; without one it has no secret."""
    found = F.lit(False)
    for parts, patterns in ANCHORS:
        one = reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts)) if parts else F.lit(True)
        found = found | reduce(lambda a, b: a & b, (text.rlike(p) for p in patterns), one)
    return F.coalesce(found, F.lit(False))


def _scan(batches):
    for batch in batches:
        spans = [find_spans(t) for t in texts_of(batch.column("text")).to_pylist()]
        counts = [pa.array([sum(s[1] == k for s in x) for x in spans], pa.int64()) for k in range(3)]
        rules = pa.array([RULES] * len(spans), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("blob").cast(pa.string()), rules, *counts, pa.array(map(as_text, spans), pa.string())], ["blob", "rules", "n_assign", "n_access", "n_hex", "spans"])


class Ledger:
    """The stored ledger below a path, a Parquet table partitioned by rules."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All rows of the present rules; none before the first append."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path).where(F.col("rules") == RULES)

    def append(self, new: DataFrame) -> None:
        new.write.mode("append").partitionBy("rules").parquet(self.path)


def load_versions(spark: SparkSession, versions: dict[str, str]) -> DataFrame:
    """The rows of several versions of a table (name and path of each), with their version and path."""
    found = [spark.read.parquet(path).withColumn("version", F.lit(name)).withColumn("path", F.lit(path)) for name, path in versions.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def scan(docs: DataFrame, ledger: Ledger, keys: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Findings (keys, blob, n_assign, n_access, n_hex, spans) of all rows, and the rows added to the ledger."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "secrets")
    addressed = docs.select(*keys, "text", blob_of(F.col("text")).alias("blob"), F.xxhash64(*keys).alias("pick"), suspect(F.col("text")).alias("suspect"))
    paths = scratch.save(addressed.select(*keys, "blob", "pick", "suspect"))
    blobs = paths.groupBy("blob").agg(F.min("pick").alias("pick"), F.max("suspect").alias("suspect"))
    unseen = scratch.save(blobs.join(ledger.read().select("blob"), "blob", "left_anti"))
    # rows that share blob and keys may be fetched together; their entries are equal
    fetched = addressed.where("suspect").select("blob", "pick", "text").join(unseen.where("suspect"), ["blob", "pick"], "left_semi")
    scanned = fetched.mapInArrow(_scan, LEDGER).dropDuplicates(["blob"])
    none = unseen.where("NOT suspect").select("blob", F.lit(RULES).alias("rules"), *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit("").alias("spans"))
    new = scratch.save(scanned.unionByName(none))
    ledger.append(new)
    return findings(paths, ledger).select(*keys, "blob", *COUNTS, "spans"), new


def hits_of(ledger: Ledger) -> DataFrame:
    """blob, counts and spans of the blobs with a secret."""
    return ledger.read().where("spans != ''").drop("rules").dropDuplicates(["blob"])


def findings(rows: DataFrame, ledger: Ledger) -> DataFrame:
    """rows, which have a column blob, with what the ledger has of their blobs."""
    hits = Scratch(rows.sparkSession, "hits").save(hits_of(ledger))  # a plain side, so that AQE can split a frequent blob
    found = rows.join(hits, "blob", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return found.select(*rows.columns, *counts, F.coalesce("spans", F.lit("")).alias("spans"))


def redacted(text: str, spans: str) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named for the first."""
    out, at = [], 0
    for kind, a, b in (s.split(":") for s in spans.split(",") if s):
        a, b = int(a), int(b)
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """docs with secrets replaced in text; n_chars, where there is one, counts the new text. No row goes, and only rows
    with an anchor of a rule are moved."""
    names, kinds = docs.columns, dict(docs.dtypes)
    ledger = ledger or Ledger(docs.sparkSession, Scratch(docs.sparkSession, "ledger").base)
    scan(docs, ledger)
    hits = Scratch(docs.sparkSession, "hits").save(hits_of(ledger).select("blob", F.col("spans").alias("found")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    clear = rows.where(~suspect(F.col("row.text"))).select(*(F.col("row").getField(c).alias(c) for c in names))
    joined = rows.where(suspect(F.col("row.text"))).withColumn("blob", blob_of(F.col("row.text"))).join(hits, "blob", "left")

    @F.pandas_udf("string")
    def clean(text, found):
        import pandas as pd

        return pd.Series([t if not s else redacted(t, s) for t, s in zip(text, found, strict=True)], dtype=object)

    done = joined.withColumn("cleaned", clean(F.col("row.text"), F.col("found")))
    new_values = {"text": F.col("cleaned"), "n_chars": F.when(F.col("found").isNull(), F.col("row.n_chars")).otherwise(F.char_length("cleaned")) if "n_chars" in names else None}
    return clear.unionByName(done.select(*((new_values[c].cast(kinds[c]) if c in new_values else F.col("row").getField(c)).alias(c) for c in names)))
