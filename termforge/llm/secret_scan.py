"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame operations only.

Every historical version of a path is a blob named by the SHA-256 of its bytes. The ledger keeps which pairs of blob
and rule version have been scanned, and what was found. A scan takes the distinct blobs of the new versions, leaves
out the pairs that the ledger has, scans each remaining blob once whatever the number of paths that hold it, appends
to the ledger, and joins findings back to all paths and versions.

Positions come from splitting: what ``split`` leaves between the matches and what ``regexp_extract_all`` gives as the
matches alternate, so running sums of their lengths are the starts, in code points.

Defined cases: null text is the empty blob, without findings; rows with the same path or text are all kept; an empty
table gives no rows; other columns pass by. Only texts with findings are on the other side when findings are joined back, and
a blob of very many rows is split by Spark's skew join, as no aggregation follows. Java's ``(?i)`` folds ASCII letters only, as asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.llm.common import Scratch, shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, group whose length counts, least length; order breaks ties between equal starts."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool
    version: int = 1


# Kinds, patterns and least lengths of the base rules.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 16, True),
    Rule("hex", r"([0-9a-f]+)", 1, 32, True),
    Rule("pem", r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)", 1, 1, False),
)
# Cheaper tests that every text with a span passes; they spare the others the splitting.
_PROBE = {"hex": r"[0-9a-f]{32}", "access": r"AKIA[A-Z0-9]{12}"}

SCANNED = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, ord int, base boolean, start long, end long"


def blobs_of(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with the blob address of each row's text in column ``blob``; columns blob and found are replaced."""
    return versions.drop("blob", "found").withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def spans_of(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All spans of (blob, text, kinds): leftmost non-overlapping matches of each kind, those long enough."""
    parts = []
    for order, r in enumerate(rules):
        p = F.lit(r.pattern)
        found = F.col("text").rlike(_PROBE.get(r.kind, r.pattern)) & F.array_contains("kinds", r.kind)
        cut = F.arrays_zip(
            F.split("text", r.pattern, -1).alias("gap"), F.regexp_extract_all("text", p, F.lit(0)).alias("hit"), F.regexp_extract_all("text", p, F.lit(r.group)).alias("part")
        )
        parts.append(F.when(found, F.transform(cut, _cut_row(order, r))))
    rows = blobs.select("blob", F.array(*parts).alias("by_rule")).select("blob", F.explode("by_rule").alias("cuts")).where("cuts is not null")
    rows = rows.select("blob", F.inline("cuts"))
    before = Window.partitionBy("blob", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(before)
    return rows.withColumn("end", end).where("ok").select("blob", "kind", "version", "ord", "base", (F.col("end") - F.col("hit")).alias("start"), "end")


def _cut_row(order: int, r: Rule):
    def row(x, i):
        return F.struct(
            F.lit(order).alias("ord"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.base).alias("base"), i.alias("i"),
            F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("hit"), (F.length(x["part"]) >= r.least).alias("ok"),
        )

    return row


class Ledger:
    """Tables of scanned (blob, rule version) pairs and of findings, appended to in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "ledger")
        for name, schema in (("scanned", SCANNED), ("findings", FINDINGS)):
            if not self._exists(name):
                spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(SCANNED).parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        return self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings")

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, text, kinds): distinct blobs with the kinds whose current version has not scanned them."""
        current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        done = self.scanned().groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
        texts = blobs_of(versions).select("blob", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
        left = F.array_except(current, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>")))
        return texts.join(done, "blob", "left").select("blob", "text", F.transform(left, lambda x: x["kind"]).alias("kinds")).where(F.size("kinds") > 0)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is unseen. Findings are appended first: a run that fails between the two appends is
        repeated as a whole, and ``matched`` counts a finding once however often it was appended."""
        work = Scratch(self.spark)
        new = work.write(self.unseen(versions, rules), "unseen")
        spans_of(new, rules).write.mode("append").parquet(f"{self.path}/findings")
        versions_by = {r.kind: r.version for r in rules}
        mapped = F.create_map(*[F.lit(x) for kv in versions_by.items() for x in kv])
        done = new.select("blob", F.explode("kinds").alias("kind"))
        done.select("blob", "kind", mapped[F.col("kind")].cast("int").alias("version")).write.mode("append").parquet(f"{self.path}/scanned")
        work.clear()

    def by_blob(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """One row per blob with spans: its spans at the rules' versions, ordered by start and then by kind."""
        live = self.spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
        spans = self.findings().join(F.broadcast(live), ["kind", "version"], "left_semi").distinct()
        return spans.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end", "kind", "base"))).alias("found"))

    def matched(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Every row of ``versions`` with its blob address and ``found``, the spans of its text (empty if none)."""
        none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string,base:boolean>>")
        return blobs_of(versions).join(self.by_blob(rules), "blob", "left").withColumn("found", F.coalesce("found", none))


def digest(matched: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base spans and all spans as text, per row."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return matched.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def redact(matched: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``matched`` with every span of ``text`` replaced by ``mask`` (overlapping spans by one mask)."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        keep = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["out"], keep, F.lit(mask)).alias("out"))
        inside = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["start"] >= acc["at"], fresh).otherwise(inside)

    done = F.aggregate("found", start, step)
    rest = F.concat(done["out"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.lit(2147483647)))
    return matched.withColumn("text", F.when(F.size("found") > 0, rest).otherwise(F.col("text")))
