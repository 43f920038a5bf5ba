"""Secret scans with a ledger of blobs: every version is addressed by its content and scanned once per rule.

``Ledger`` is two tables in one folder: which (blob, rule version) pairs were scanned, and the findings.
A scan of versions looks only at pairs the ledger lacks; findings then join back to every path that ever
held the blob. Copies and unchanged versions cost nothing, and a changed rule scans old blobs again.

All of it is DataFrame functions. Places of matches come from cutting the text at them: the pieces between
matches and the matches themselves alternate, so running lengths give starts and ends in code points.

A null text is the empty blob. A path may be null or repeat; each row of the versions comes back once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.shared import unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` finds candidates, leftmost first and without overlap; those pass whose group ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: The order here is the order of kinds that start at one place. ``hex`` runs are maximal, so its bound stands in the pattern.
BASE_RULES = (
    Rule("assign", 1, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)

FOUND = "array<struct<kind: string, start: int, end: int>>"


def blob_id(text: str | Column) -> Column:
    """The content address of a version."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<kind, start, end>> of the rule's findings, in order."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    sizes = F.zip_with(F.transform(whole, lambda m: F.length(m)), F.transform(tested, lambda g: F.length(g) >= rule.least), lambda size, ok: F.struct(size.alias("size"), ok.alias("ok")))
    turns = F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), sizes, lambda piece, match: F.struct(
        F.length(piece).alias("gap"), match["size"].alias("size"), match["ok"].alias("ok")))
    none = F.array().cast("array<struct<end: int, size: int, ok: boolean>>")
    placed = F.aggregate(turns, none, lambda done, turn: F.concat(done, F.array(F.struct(
        (F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + turn["gap"] + turn["size"]).alias("end"), turn["size"].alias("size"), turn["ok"].alias("ok")))))
    found = F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.struct(F.lit(rule.kind).alias("kind"), (x["end"] - x["size"]).alias("start"), x["end"].alias("end")))
    return F.when(F.rlike(text, pattern), found).otherwise(F.array().cast(FOUND))


class Ledger:
    """Scanned (blob, rule version) pairs and their findings below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/scanned"

    def scanned(self) -> DataFrame:
        """One row per pair: blob_id, rule (``kind@version``) and its findings, which may be none."""
        try:
            return self.spark.read.schema(f"blob_id binary, rule string, found {FOUND}").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.sql(f"SELECT CAST(NULL AS BINARY) AS blob_id, '' AS rule, CAST(NULL AS {FOUND}) AS found WHERE false")

    def scan(self, versions: DataFrame, text: str = "text", rules: Sequence[Rule] = BASE_RULES) -> None:
        """Scan the pairs of ``versions`` and ``rules`` that the ledger lacks, and append them.

        Rules that miss the same blobs share one pass over the texts. The rows of one call are committed
        together, so a call that dies appends nothing.
        """
        names = {f"{r.kind}@{r.version}": r for r in rules}
        have = self.scanned().where(F.col("rule").isin(*names)).groupBy("blob_id").agg(F.collect_set("rule").alias("have"))
        blobs = versions.select(blob_id(text).alias("blob_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        new = blobs.join(have, "blob_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>"))).where(F.size("have") < len(names))
        new = new.groupBy("blob_id").agg(F.first("text").alias("text"), F.first("have").alias("have"))
        results = [F.struct(F.lit(name).alias("rule"), F.when(~F.array_contains("have", name), matches(F.col("text"), rule)).alias("found"))
                   for name, rule in names.items()]
        rows = new.select("blob_id", F.explode(F.array(*results)).alias("r")).select("blob_id", "r.rule", "r.found")
        rows.where("found is not null").write.mode("append").parquet(self.path)

    def findings(self, rules: Sequence[Rule] = BASE_RULES) -> DataFrame:
        """(blob_id, found): the blobs with findings under these rule versions, ordered by start, then by kind as listed."""
        names = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
        rows = self.scanned().where(F.array_contains(names, F.col("rule")) & (F.size("found") > 0)).select("blob_id", F.transform("found", lambda x: F.struct(
            x["start"].alias("start"), F.array_position(names, F.col("rule")).alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("found"))
        return rows.groupBy("blob_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))

    def of_paths(self, versions: DataFrame, columns: Sequence[str], text: str = "text", rules: Sequence[Rule] = BASE_RULES, out: str = "found") -> DataFrame:
        """``columns`` of every version, and ``out``: the findings of its blob, an empty array without any."""
        blob = unused("blob", [*columns, out])
        paths = versions.select(*columns, blob_id(text).alias(blob))
        found = self.findings(rules).select(F.col("blob_id").alias(blob), F.col("found").alias(out))
        return paths.join(found, blob, "left").select(*columns, F.coalesce(out, F.array().cast(found.schema[out].dataType)).alias(out))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """``text`` with every found span, or run of overlapping spans, replaced by ``mark``."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(found, begin, lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark)).alias("out"))))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
