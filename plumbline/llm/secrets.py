"""Secret scans with an incremental ledger of scanned blobs.

Every version of a text is a blob, named by its content. The ledger lists the pairs of
blob and rule version that were scanned before; only unseen pairs are scanned, each blob
once however many documents hold it, and the findings are joined back to all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

# The base rules, and the length a match needs to count.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex")

#: Rules beyond the base: key blocks, signed web tokens, tokens with a vendor prefix, logins in addresses.
MORE_RULES = {
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "vendor": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,})"),
    "login": re.compile(r"[a-z][a-z0-9+]{1,9}://[^\s:/@]+:[^\s:/@]{4,}@[A-Za-z0-9.-]+"),
}
#: A text that holds none of a rule's hints has no match of it: each alternative has one of them as its fixed part.
HINTS = {
    "pem": ("-----BEGIN",),
    "jwt": ("eyJ",),
    "vendor": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_"),
    "login": ("://",),
}
ORDER = {kind: n for n, kind in enumerate([*KINDS, *MORE_RULES])}
RULE_VERSION = hashlib.sha256(
    "\n".join(
        [ASSIGN.pattern, ACCESS.pattern, HEX.pattern, f"{ASSIGN_LENGTH} {ACCESS_LENGTH} {HEX_LENGTH}"]
        + [f"{kind} {rule.pattern}" for kind, rule in MORE_RULES.items()]
    ).encode()
).hexdigest()[:16]

ENOUGH_HEX = re.compile(f"[0-9a-f]{{{HEX_LENGTH},}}")
ENOUGH_ACCESS = re.compile(f"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

SPAN = "kind string, start int, end int"
FINDINGS = f"blob string, spans array<struct<kind:string,start:int,end:int>>"


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind; offsets in code points, end exclusive."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        # a greedy run that is too short hides no longer one, so the length can stand in the pattern
        found += [("access", *m.span()) for m in ENOUGH_ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in ENOUGH_HEX.finditer(text)]
    for kind, rule in MORE_RULES.items():
        if any(h in text for h in HINTS[kind]):
            found += [(kind, *m.span()) for m in rule.finditer(text)]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        blobs, found = [], []
        for blob, text in zip(batch.column("blob"), batch.column("text")):
            spans = find_spans(text.as_py())
            blobs.append(blob.as_py())
            found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(found, kind)], names=["blob", "spans"])


def with_blob(docs: DataFrame) -> DataFrame:
    """Add the content address of the text; a null text is the empty blob."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("text", text).withColumn("blob", F.sha2(text, 256))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of the blobs of ``docs`` that the ledger does not list under this rule version.

    ``ledger`` has (blob, rule_version, spans); the result has the same columns and is
    what a caller appends to it. One document stands for each blob; documents that share
    a doc_id and text are scanned once.
    """
    named = with_blob(docs.select("doc_id", "text"))
    unseen = named.groupBy("blob").agg(F.min(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_id"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        unseen = unseen.join(known, "blob", "left_anti")
    # keyed by blob and document, so that a blob with very many copies is not one hot key
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = named.withColumn("_id", key).join(unseen, ["_id", "blob"], "left_semi").select("blob", "text")
    found = texts.mapInArrow(_scan, FINDINGS)
    return found.dropDuplicates(["blob"]).withColumn("rule_version", F.lit(rule_version)).select("blob", "rule_version", "spans")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Every document with the spans of its text: doc_id, blob, spans.

    Blobs in the ledger are not read again. A null or empty text has no spans. Rows with
    one doc_id are separate documents; a null doc_id is kept. Other columns of ``docs``
    are ignored. No documents give no rows.
    """
    fresh = scan_unseen(docs, ledger, rule_version)
    if ledger is not None:
        fresh = fresh.unionByName(ledger.where(F.col("rule_version") == rule_version).select(fresh.columns))
    hits = materialize(fresh.where(F.size("spans") > 0).select("blob", "spans"), "findings")
    return with_blob(docs.select("doc_id", "text")).select("doc_id", "blob").join(hits, "blob", "left")


def joined(spans: Column, kinds=None) -> Column:
    """``kind:start:end`` of the spans, joined by commas, in their order."""
    spans = F.coalesce(spans, F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by ``[SECRET]``; spans come by start."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state, s):
        gap = F.when(s["start"] >= state["at"], F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("[SECRET]"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], gap).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, empty, step)
    clean = F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))
    return F.when(F.size(F.coalesce(spans, F.array())) > 0, clean).otherwise(text)
