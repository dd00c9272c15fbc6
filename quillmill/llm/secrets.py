"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its content. The ledger holds the
(blob, rule, rule version) triples that were scanned; a scan goes over those that are new and
no others, however many paths share a blob, and findings are joined back to all paths. Adding
paths, versions or rules later scans only what they bring.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

Spans = list[tuple[int, int]]

#: The base patterns; in `assign` the words before the value match in either case.
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Further kinds: the tokens and key files of public services, by their published forms.
PEM = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
HOST_TOKEN = r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})"


@dataclass(frozen=True)
class Rule:
    """find gives the spans (code points, end exclusive) of a text, leftmost and apart. A changed rule takes a new version."""

    kind: str
    version: int
    find: Callable[[str], Spans]


def _matches(pattern: str, keep: Callable[[re.Match], bool] = lambda m: True, hints: tuple[str, ...] = ()) -> Callable[[str], Spans]:
    """Spans of a pattern's matches; hints are strings one of which any match holds (compared in lower case)."""
    rx = re.compile(pattern)

    def find(text: str) -> Spans:
        if hints:
            low = text.lower()
            if not any(h in low for h in hints):
                return []
        return [m.span() for m in rx.finditer(text) if keep(m)]

    return find


def base_rules() -> list[Rule]:
    """The three base kinds, in their order. Too short matches are dropped after they have matched, so they still bar overlaps."""
    hexes = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this finds the runs of HEX that are long enough
    return [
        Rule("assign", 1, _matches(ASSIGN, lambda m: len(m[2]) >= 6, ("password", "passwd", "secret", "token", "apikey", "api_key"))),
        Rule("access", 1, _matches(ACCESS, lambda m: len(m[0]) >= 20, ("akia",))),
        Rule("hex", 1, lambda text: [m.span() for m in hexes.finditer(text)]),
    ]


def all_rules() -> list[Rule]:
    return [
        *base_rules(),
        Rule("pem", 1, _matches(PEM, hints=("-----begin ",))),
        Rule("jwt", 1, _matches(JWT, hints=("eyj",))),
        Rule("host_token", 1, _matches(HOST_TOKEN, hints=("_", "glpat-", "xox"))),
    ]


LEDGER_DDL = "blob string, kind string, version int"
FINDING_DDL = "blob string, kind string, version int, rank int, start int, stop int"


def blobs_of(versions: DataFrame) -> DataFrame:
    """versions (path, text and whatever names a version) with blob, the SHA-256 of the text; a null text is empty."""
    return versions.withColumn("blob", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))


def named(rules: list[Rule]) -> list[str]:
    return [f"{r.kind}:{r.version}" for r in rules]


def unseen(versions: DataFrame, rules: list[Rule], ledger: DataFrame | None = None) -> DataFrame:
    """blob, path (the least that has it) and done (the rules, as kind:version, that it has met) of the blobs that some rule hasn't met.

    Found from digests alone. A null path ranks as an empty one.
    """
    first = blobs_of(versions.select(F.coalesce("path", F.lit("")).alias("path"), "text")).groupBy("blob").agg(F.min("path").alias("path"))
    none = F.array().cast("array<string>")
    if ledger is None:
        return first.withColumn("done", none)
    key = F.concat_ws(":", "kind", "version")
    seen = ledger.filter(key.isin(named(rules))).groupBy("blob").agg(F.collect_set(key).alias("done"))  # at most as many as there are rules
    return first.join(seen, "blob", "left").withColumn("done", F.coalesce("done", none)).filter(F.size("done") < len(rules))


def scan_unseen(versions: DataFrame, rules: list[Rule], todo: DataFrame) -> DataFrame:
    """Findings of the (blob, rule) pairs of todo (from unseen): blob, kind, version, rank (of the rule), start, stop.

    One row of each blob is scanned, so texts move once and copies, however many, cost one scan.
    """
    texts = blobs_of(versions.select(F.coalesce("path", F.lit("")).alias("path"), "text")).join(todo.hint("shuffle_hash"), ["blob", "path"]).select("blob", "text", "done")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for blob, text, done in zip(*batch.columns, strict=True):
                name, body, skip = blob.as_py(), text.as_py() or "", set(done.as_py() or ())
                for rank, rule in enumerate(rules):
                    if f"{rule.kind}:{rule.version}" not in skip:
                        out += [(name, rule.kind, rule.version, rank, a, b) for a, b in rule.find(body)]
            if out:
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["blob", "kind", "version", "rank", "start", "stop"])

    # repeated rows of one path and blob are scanned alike
    return texts.mapInArrow(scan, FINDING_DDL).distinct()


def join_back(versions: DataFrame, findings: DataFrame, names: list[str], rules: list[Rule]) -> DataFrame:
    """names (columns of versions), blob and spans, the array of struct(start, rank, kind, stop) in order, for every version, found in or not.

    Only findings of these rules, in these versions, count; a rule's place in the list is its rank.
    """
    ranks = F.create_map(*(F.lit(x) for k, name in enumerate(named(rules)) for x in (name, k)))
    wanted = findings.withColumn("rank", ranks[F.concat_ws(":", "kind", "version")]).filter("rank IS NOT NULL").select("blob", "start", "rank", "kind", "stop").distinct()
    per_blob = wanted.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "stop"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    return blobs_of(versions).select(*names, "blob").join(per_blob, "blob", "left").select(*names, "blob", F.coalesce("spans", empty).alias("spans"))


class Ledger:
    """A ledger kept as two Parquet tables under a path: scanned pairs and findings."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str, ddl: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], ddl)

    def scanned(self) -> DataFrame:
        return self._read("scanned", LEDGER_DDL)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDING_DDL).distinct()

    def update(self, versions: DataFrame, rules: list[Rule]) -> int:
        """Scans what is new and says how many pairs that was. Findings are written before the
        pairs are marked, so a run that dies in between is repeated and loses nothing: what it
        wrote is written again, and counts once."""
        todo = materialize(unseen(versions, rules, self.scanned()), "unseen")
        kinds = F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules)))
        new = todo.select("blob", "done", kinds.alias("r")).filter(~F.array_contains("done", F.concat_ws(":", "r.kind", "r.version"))).select("blob", "r.kind", "r.version")
        scan_unseen(versions, rules, todo).write.mode("append").parquet(f"{self.path}/findings")
        new.write.mode("append").parquet(f"{self.path}/scanned")
        return new.count()


def spans_text(spans, kinds: list[str] | None = None):
    """kind:start:end of the spans, comma-joined, of these kinds or of all."""
    kept = F.filter(spans, lambda s: s["kind"].isin(kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, batches: int = 2) -> DataFrame:
    """Each document as one version of the path doc_id, brought into a ledger and joined back to what it found.

    The documents come in batches by path, as versions of a corpus do: a blob that an earlier
    batch has had, or that the given ledger knows, isn't scanned again. Without a ledger a new
    one is kept in the shared folder. Returns doc_id, n_assign, n_access, n_hex, base_sha256,
    spans (all kinds) and blob. A null text is empty; repeated rows, and rows without an id, each
    get the findings of their text; a very long text is scanned whole, in one task; spans that
    start together are in the order of the kinds. No row is lost and an empty table gives none;
    other columns are ignored, whatever their names.
    """
    spark, rules = docs.sparkSession, all_rules()
    ledger = ledger or Ledger(spark, new_path(spark, "ledger"))
    versions = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("path"), "doc_id", "text")
    for k in range(batches):
        ledger.update(versions.filter(F.pmod(F.xxhash64("path"), F.lit(batches)) == k), rules)
    found = join_back(versions, ledger.findings(), ["doc_id"], rules)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = [r.kind for r in base_rules()]
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(spans_text(F.col("spans"), base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), "blob")
