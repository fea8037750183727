"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a text is a blob, addressed by the SHA-256 of its content. The ledger
holds the findings of each (blob, rule version) pair scanned so far. A scan takes the distinct blobs
of the given paths, drops the pairs that the ledger has, scans only the rest, adds them to the
ledger, and joins findings back to every path that holds the blob, in whatever version.

Spans are code points, end exclusive; matches of a kind are leftmost and don't overlap. A match that
fails its rule's length is dropped but still uses up its text. Null texts count as empty; repeated
rows are paths of their own; an empty table gives no rows and leaves the ledger as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from .common import cut, is_written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts, the least length, and a version; before: the class
    of characters that must not stand right before a match."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    before: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns and lengths of the three base rules.
ASSIGN = Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 0, 18)
HEX = Rule("hex", r"[0-9a-f]+", 0, 16)
BASE = (ASSIGN, ACCESS, HEX)
#: Rules that are tried beside the base ones.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
    # at the start of its run only, so that no run is read again from each place inside it
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 30, before="[A-Za-z0-9_-]"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}", 0, 24),
)
RULES = BASE + MORE

EMPTY_LEDGER = "blob string, rule string, spans array<struct<start:bigint,end:bigint>>"


def _candidates(rule: Rule) -> str:
    """A pattern without captures that finds the same matches, or only those long enough where that's the same.

    For one run of a character class, and for a prefix with a run, a match shorter than the least
    holds no longer one, so the length can stand in the pattern.
    """
    if rule is HEX:
        return r"[0-9a-f]{16,}"
    if rule is ACCESS:
        return r"AKIA[A-Z0-9]{14,}"
    return f"(?<!{rule.before}){rule.pattern}" if rule.before else rule.pattern


def spans(text: str, rule: Rule) -> Column:
    """The matches of a rule in a text column: an array of (start, end).

    split() gives what stands between matches, regexp_extract_all() the matches; running sums of their lengths are the
    places, so a text with many matches takes little longer than one with few. Matches that are too short go last.
    """
    pattern = S.raw(_candidates(rule).replace('"', r"\x22"))
    all_of = lambda group: f"regexp_extract_all({text}, {pattern}, {group})"
    placed = S.found(text, pattern)
    if rule.group:
        counted = f"zip_with({placed}, transform({all_of(rule.group)}, c -> length(c)), (s, n) -> named_struct('start', s.start, 'end', s.end, 'n', n))"
        placed = f"IF(rlike({text}, {pattern}), transform(filter({counted}, s -> s.n >= {rule.least}), s -> struct(s.start, s.end)), {S.NONE})"
    else:
        placed = f"filter({placed}, s -> s.end - s.start >= {rule.least})"
    return F.expr(placed).cast("array<struct<start:bigint,end:bigint>>")


def blobs(paths: DataFrame, text: str) -> DataFrame:
    """paths with columns blob (SHA-256 of the text) and content."""
    return paths.withColumn("content", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).withColumn("blob", F.sha2("content", 256))


def scan(paths: DataFrame, doc_id: str, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings by path (doc_id, found: map from kind to spans), and the ledger with the new pairs.

    Only blobs that lack some rule version are read for that rule. A blob is scanned once however
    many paths hold it: copies are put together within each task before the shuffle.
    """
    ledger = ledger if ledger is not None else paths.sparkSession.createDataFrame([], EMPTY_LEDGER)
    grown = cut(ledger.select("blob", "rule", "spans").unionByName(new_pairs(paths, doc_id, text, ledger, rules)))
    return findings(paths, doc_id, text, grown, rules), grown


def scan_into(folder: str, paths: DataFrame, doc_id: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings by path, from the ledger kept in a folder: only (blob, rule version) pairs that it lacks are scanned,
    and added to it. A folder that isn't there yet is an empty ledger. One scan at a time may write to it."""
    spark = paths.sparkSession
    read = spark.read.schema(EMPTY_LEDGER)
    ledger = read.parquet(folder) if is_written(spark, folder) else spark.createDataFrame([], EMPTY_LEDGER)
    new_pairs(paths, doc_id, text, ledger, rules).write.mode("append").parquet(folder)
    return findings(paths, doc_id, text, read.parquet(folder), rules)


def new_pairs(paths: DataFrame, doc_id: str, text: str, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, rule, spans of the pairs that the ledger lacks."""
    own = blobs(paths.select(F.col(f"`{doc_id}`").alias("path"), F.col(f"`{text}`").alias("text")), "text")
    known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("known"))
    distinct = own.groupBy("blob").agg(F.first("content").alias("content"))
    unseen = distinct.join(known, "blob", "left").select("blob", "content", F.coalesce("known", F.array().cast("array<string>")).alias("known"))
    unseen = unseen.where(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), "known")) > 0)
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    tried = unseen.select("blob", F.map_from_entries(F.array(*[F.struct(F.lit(r.key), F.when(~F.array_contains("known", r.key), spans("content", r)).otherwise(none)) for r in rules])).alias("tried"))
    return tried.select("blob", F.explode("tried").alias("rule", "spans")).where("spans is not null")


def findings(paths: DataFrame, doc_id: str, text: str, grown: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, blob, found: what the ledger has for each path's blob."""
    own = blobs(paths.select(F.col(f"`{doc_id}`").alias("path"), F.col(f"`{text}`").alias("text")), "text")
    kinds = {r.key: r.kind for r in rules}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("rule"))
    # written before the join, so that it is one of two plain shuffles and a blob of many paths can be split
    found = cut(grown.where(F.col("rule").isin(list(kinds)) & (F.size("spans") > 0)).groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct(kind, "spans"))).alias("found")))
    back = own.select("path", "blob").join(found, "blob", "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<struct<start:bigint,end:bigint>>>"))
    return back.select(F.col("path").alias(doc_id), "blob", F.coalesce("found", empty).alias("found"))


def listed(found: str, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of all spans of rules, by start, then in the order of rules, joined by commas."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def shown(order: int, rule: Rule) -> Column:
        one = lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.concat_ws(":", F.lit(rule.kind), s["start"].cast("string"), s["end"].cast("string")).alias("shown"))
        return F.transform(F.coalesce(F.col(found)[rule.kind], none), one)

    each = [shown(i, r) for i, r in enumerate(rules)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: s["shown"]), ",")


def count(found: str, rule: Rule) -> Column:
    return F.coalesce(F.size(F.col(found)[rule.kind]), F.lit(0)).cast("bigint")
