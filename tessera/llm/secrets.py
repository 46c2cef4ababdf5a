"""Secret scanning with an incremental ledger of blobs.

Every version of a text is a blob, named by the SHA-256 of its UTF-8 bytes. The ledger, a Parquet table that is only ever
appended to, says which rules (by a version derived from their pattern) have seen which blob, and what they found. A scan
first sends names only, and drops those whose (blob, rule version) pairs the ledger already has. A bitmap of fixed size over
the names that are left goes to all tasks, so that the texts of known blobs stay where they are, but for few that the bitmap
mistakes. Each other text goes once a task to the executor that owns its name; the missing rules run, the outcome is appended,
and findings are joined back to all rows (paths) that hold the blob. Changing one rule rescans for that rule alone; a new copy
of a known blob costs no scan.

Nulls: a null text is an empty text; a null doc_id keeps its row. Repeated rows are reported each. Empty table: no rows.
Spans that begin at the same place stand in the order of the rules. Very long texts are scanned whole. Further columns of the
input, whatever their names, play no part.
Offsets are code points, end exclusive. Each rule's matches are leftmost and do not overlap; those below the rule's
minimum length are dropped after matching.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, released_shuffles, scratch, slices, text_of, utf8_bytes


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # its fewest characters

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]}"


BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # a shorter run has no match inside
)
#: Formats that the base rules miss.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    # begins where a run of its characters begins: at every eyJ inside one, a search to its end would take quadratic time
    Rule("signed_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE_RULES + MORE_RULES

_LEDGER = "blob_id binary, versions array<string>, spans array<struct<rule: string, start: int, stop: int>>"
_ARROW = pa.schema([("blob_id", pa.binary()), ("versions", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))])


def find(text: str, rules: Iterable[Rule]) -> list[tuple[str, int, int]]:
    """(kind, start, stop) by start, then in the order of the rules."""
    out = []
    for k, rule in enumerate(rules):
        if rule.kind == "access" and "AKIA" not in text:
            continue
        for m in re.compile(rule.pattern).finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), k, m.end(), rule.kind))
    return [(kind, start, stop) for start, _, stop, kind in sorted(out)]


#: Bits of the bitmap over unseen names: 2 MB, whatever the input. Full, it lets all texts through.
_BITS = 1 << 24


def _bits_of(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(n[:4] for n in names), "<u4") % np.uint32(_BITS)


def _bitmap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names, or bitmaps, of one task in; one bitmap out."""
    bits = np.zeros(_BITS // 8, np.uint8)
    for batch in slices(batches, 1024):
        found = batch.column(1).to_pylist()
        if batch.schema.field(1).name == "bits":
            for other in found:
                bits |= np.frombuffer(other, np.uint8)
        elif found:
            at = _bits_of(found)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    if bits.any():
        yield pa.RecordBatch.from_arrays([pa.array([int(bits[:8].view(np.uint64)[0] % 16)], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["lot", "bits"])


def _blobs(seek=None, with_text: bool = True):
    """(blob_id[, text]), each blob once a task; only what the bitmap holds, if there is one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        bits = np.frombuffer(seek.value, np.uint8) if seek is not None else None
        for batch in slices(batches):
            every = [hashlib.sha256(raw).digest() for raw in utf8_bytes(batch.column(1))]
            wanted = [True] * len(every)
            if bits is not None and every:
                at = _bits_of(every)
                wanted = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).tolist()
            names, keep = [], []
            for at, (name, use) in enumerate(zip(every, wanted, strict=True)):
                if use and name not in met:
                    met.add(name)
                    names.append(name)
                    keep.append(at)
            if keep:
                ids = pa.array(names, pa.binary())
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).take(pa.array(keep))] if with_text else [ids], names=["blob_id", "text"] if with_text else ["blob_id"])

    return run


def _scan(rules: tuple[Rule, ...], known: bool):
    """Rows (blob_id, text[, done]) of one owner of blobs in, ledger rows of the pairs not done yet out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        version = {r.kind: r.version for r in rules}
        for batch in slices(batches):
            rows = []
            done = batch.column(2).to_pylist() if known else [None] * batch.num_rows
            for name, text, had in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), done, strict=True):
                if name in met:
                    continue
                met.add(name)
                todo = [r for r in rules if r.version not in (had or ())]
                if todo:
                    spans = find(text, todo)
                    rows.append({"blob_id": name, "versions": [r.version for r in todo], "spans": [{"rule": version[k], "start": a, "stop": b} for k, a, b in spans]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


def ledger_exists(spark: SparkSession, ledger: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at this path lacks, append it, and return the ledger."""
    spark, texts = docs.sparkSession, text_of(docs)
    known = ledger_exists(spark, ledger)
    if known:
        done = spark.read.schema(_LEDGER).parquet(ledger).select("blob_id", F.explode("versions").alias("v")).groupBy("blob_id").agg(F.collect_set("v").alias("done"))
        wanted = F.array(*(F.lit(r.version) for r in rules))
        names = texts.mapInArrow(_blobs(with_text=False), "blob_id binary").distinct()
        unseen = names.join(done, "blob_id", "left").filter(F.size(F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))) > 0)
        unseen = materialize(spark, unseen, "unseen-blobs")
        maps = unseen.select(F.lit(0).alias("lot"), "blob_id").mapInArrow(_bitmap, "lot int, bits binary")
        whole = maps.repartition("lot").mapInArrow(_bitmap, "lot int, bits binary").collect()  # at most 16 bitmaps
        seek = np.zeros(_BITS // 8, np.uint8)
        for r in whole:
            seek |= np.frombuffer(r.bits, np.uint8)
        blobs = texts.mapInArrow(_blobs(spark.sparkContext.broadcast(seek.tobytes())), "blob_id binary, text string")
        # dealt by name, so that copies from several tasks meet and are scanned once
        blobs = blobs.repartition("blob_id").join(unseen.hint("merge"), "blob_id").select("blob_id", "text", "done")
    else:
        blobs = texts.mapInArrow(_blobs(), "blob_id binary, text string").repartition("blob_id")
    with released_shuffles(spark):
        blobs.mapInArrow(_scan(rules, known), _LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(_LEDGER).parquet(ledger)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for every row, spans as ``find`` orders them. Blobs without findings take no part in the join."""
    kinds, versions = F.array(*(F.lit(r.kind) for r in rules)), F.array(*(F.lit(r.version) for r in rules))
    spans = ledger.filter(F.size("spans") > 0).select("blob_id", F.explode("spans").alias("s")).withColumn("k", F.array_position(versions, F.col("s.rule"))).filter("k > 0")
    by_blob = spans.groupBy("blob_id").agg(F.collect_set(F.struct(F.col("s.start").alias("start"), "k", F.col("s.stop").alias("stop"), F.element_at(kinds, F.col("k").cast("int")).alias("kind"))).alias("s"))
    # a table of its own, so that the rows of one blob with very many copies can be split
    by_blob = materialize(docs.sparkSession, by_blob, "blob-findings")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("blob_id"))
    return rows.join(by_blob.select("blob_id", F.array_sort("s").alias("spans")), "blob_id", "left").select("doc_id", F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, k: bigint, stop: int, kind: string>>)")).alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``; without a ledger path a new ledger is begun in the shared folder."""
    ledger = ledger or scratch(docs.sparkSession, "ledger")
    return findings(docs, update_ledger(docs, ledger, rules), rules)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the base rules' spans, and all spans as text."""
    kinds = [r.kind for r in BASE_RULES]
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    of = lambda names: F.filter("spans", lambda x: x["kind"].isin(names))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(said(of(kinds)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
