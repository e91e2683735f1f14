"""Operator 6, secret scans: an incremental ledger of content-addressed blobs, by DataFrame functions only.

Every version of a text is a blob, named by its SHA-256. The ledger holds, for a blob and a rule version, the spans
found. A scan reads the ledger, looks only at blobs that have no entry under the current rule version (one copy of
each), appends what it finds, and joins the entries back to all paths with that content.

Kinds are matched leftmost and without overlap, each on its own; positions are code points, the end exclusive. Null
texts count as empty and have an entry without spans. Repeated rows each get their row; an empty table gives an
empty result; other columns are ignored by ``scan`` and carried along by ``redact``, whatever their names.

A ledger is a folder that outlives runs. Runs that overlap may both append an entry for a blob; entries for the same blob
and rule version are equal, and one of them is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import free_name, may_be_among, scratch_path, written


@dataclass(frozen=True)
class Kind:
    """A pattern; ``needed``: a text without any of these strings can't match; ``value``, ``least``: matches whose group
    is shorter are dropped after matching."""

    name: str
    pattern: str
    needed: tuple[str, ...] = ()
    value: int = 0
    least: int = 0


#: What stands between the lines of a key; line ends may be escaped.
_GAP = r"(?:[ \t\r\n]|\\[rn])*+"
#: A whole private key: its header, lines of attributes or of at least 16 base-64 characters, and its end line with what is
#: left before it. Without an end line the key ends with the last such line. Possessive, so that no text makes it deep.
PRIVATE_KEY = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_GAP}(?:[A-Z][A-Za-z-]*+: [^\n\\]*+|[A-Za-z0-9+/=]{{16,}}+))*+(?:{_GAP}[A-Za-z0-9+/=]*+{_GAP}-----END [A-Z ]*PRIVATE KEY-----)?"

#: The base kinds in their order, then those that the method adds. Runs of hex digits and of upper-case
#: letters are matched whole, so their least length is part of the pattern.
KINDS = (
    Kind("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", value=2, least=8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", ("AKIA",)),
    Kind("hex", r"[0-9a-f]{32,}"),
    Kind("private_key", PRIVATE_KEY, ("PRIVATE KEY-----",)),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = "1.1"
#: The session setting that names the ledger's folder.
LEDGER_SETTING = "spark.packetloom.secrets.ledger"
LEDGER = "blob string, rule_version string, spans array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """array<struct<start, rank, kind, end>>: the text between matches and the matches give the positions."""
    matched = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value)) if kind.value else matched
    rows = F.arrays_zip(between.alias("b"), matched.alias("m"), value.alias("v"))
    # one struct a match with all before it summed up: the last entry is the text after the last match
    pieces = F.transform(rows, lambda r: F.struct(F.length(r["b"]).alias("gap"), F.length(r["m"]).alias("width"), F.length(r["v"]).alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.coalesce(p["width"], F.lit(0))
        one = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end")))
        keep = p["width"].isNotNull() & (p["value"] >= kind.least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(pieces, start, step, lambda acc: acc["found"])
    possible = text.rlike(kind.pattern)
    if kind.needed:
        wanted = F.lit(False)
        for part in kind.needed:
            wanted = wanted | F.contains(text, F.lit(part))
        possible = wanted & possible
    return F.when(possible, found).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))


def all_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*(spans_of(text, kind, rank) for rank, kind in enumerate(KINDS))))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def ledger_path(spark: SparkSession) -> str:
    """The durable ledger that the session names; where it names none, a new one that goes with the driver."""
    return spark.conf.get(LEDGER_SETTING, None) or scratch_path(spark, "ledger")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update_ledger(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> None:
    """Scan the blobs of ``versions`` (path, text) that the ledger lacks under ``rule_version``, and append them.

    First names only are shuffled, to pick one path for each unseen blob; then the texts, by (blob, path), which no
    group of copies makes uneven. A run that is repeated after a failure finds what is still unseen.
    """
    spark = versions.sparkSession
    known = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob").distinct()
    named = versions.select("path", F.coalesce("text", F.lit("")).alias("text"), blob(F.col("text")).alias("blob"))
    unseen = named.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
    chosen = named.alias("n").join(unseen.alias("u"), F.expr("n.blob = u.blob AND n.path <=> u.path"), "left_semi")
    found = chosen.select("blob", F.lit(rule_version).alias("rule_version"), all_spans(F.col("text")).alias("spans"))
    # rows that repeat path and text give the same entry
    found.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)


def known_entries(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """(blob, spans), one for each blob, even if runs that overlapped have appended it twice."""
    return read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob", "spans").dropDuplicates(["blob"])


def findings(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, spans) for each row of ``versions``, from the ledger; copies share an entry."""
    return versions.select("path", blob(F.col("text")).alias("blob")).join(known_entries(versions.sparkSession, ledger, rule_version), "blob", "left")


def scan(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Bring the ledger up to date with ``versions`` (path, text), and give (path, blob, spans) for all of them."""
    update_ledger(versions, ledger, rule_version)
    return findings(versions, ledger, rule_version)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``. Spans are sorted by start."""

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.when(ahead, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced, after bringing the ledger up to date; all columns are kept.

    Only entries with findings are joined, by content, and only texts that may have one move to that join; all others stay
    where they are. ``docs`` is read for each part, so it should be a table.
    """
    update_ledger(docs.select(F.col(path).alias("path"), F.col(text).alias("text")), ledger, rule_version)
    blob_, spans_ = free_name(docs, "blob"), free_name(docs, "spans")
    entries = known_entries(docs.sparkSession, ledger, rule_version).where(F.size("spans") > 0)
    entries = written(entries.select(F.col("blob").alias(blob_), F.col("spans").alias(spans_)), "findings")
    possible = may_be_among(entries, blob_)(blob(F.col(text)))
    joined = docs.where(possible).join(entries, blob(F.col(text)) == F.col(blob_), "left")
    clean = F.when(F.col(spans_).isNotNull(), redacted(F.col(text), F.col(spans_))).otherwise(F.col(text))
    return joined.select(*(clean.alias(c) if c == text else F.col(c) for c in docs.columns)).union(docs.where(~possible))
