"""Secret scan with multipart credential linking.

Certain secrets (assignments to secret names, access keys, long hexadecimal strings) are always reported.
Weak candidates are parts of a credential: identifiers, mixed strings that could be secrets, endpoints. Each
has a scope, the text at most ``REACH`` code points around it; an interval join inside a document, made as
a sweep by range windows, counts the complementary parts in that scope. A weak identifier needs a secret, a
weak secret needs an identifier or an endpoint, an endpoint needs both.

Null texts are empty; repeated rows are reported alike; an empty table gives an empty result. ``redacted``
keeps the columns it is given. Spans count code points, their ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossweave.session import staged

from .common import arrow_pass, text_of

REACH = 200
# The patterns of certain secrets with the least length of the marked group.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones can be passed over at once
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}

# The shapes of weak parts.
NAMED_ID = re.compile(r"""(?:user(?:_?name)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""", re.IGNORECASE | re.ASCII)
ID_NAMES = ("user", "login", "client", "account", "access")
MAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
URL_TAIL = re.compile(r"[^\s\"'<>]+")
PORT = re.compile(r":[0-9]{2,5}(?![0-9])")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
MAIL_CHARS, SCHEME_CHARS, HOST_CHARS = ALNUM | set("._%+-"), frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-"), ALNUM | set(".-")
LEAST_ENTROPY = 3.5


def certain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of certain secrets, leftmost and non-overlapping within a kind, sorted."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _run_before(text: str, end: int, least: int, chars: frozenset[str]) -> int:
    """Where the run of ``chars`` that stops at ``end`` begins, not before ``least``."""
    at = end
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def mails(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses. Found from their domains backwards: a search from the left rereads a long run at each of its characters."""
    free = 0
    for m in MAIL_END.finditer(text):
        start = _run_before(text, m.start(), free, MAIL_CHARS)
        if start < m.start():
            yield start, m.end()
            free = m.end()


def urls(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a scheme that starts with a letter."""
    free, at = 0, text.find("://")
    while at >= 0:
        start = _run_before(text, at, free, SCHEME_CHARS)
        while start < at and not "a" <= text[start] <= "z":
            start += 1
        tail = URL_TAIL.match(text, at + 3) if start < at else None
        if tail:
            free = tail.end()
            yield start, free
        at = text.find("://", max(free, at + 1))


def hosts(text: str) -> Iterator[tuple[int, int]]:
    """Dotted host names with a port: labels joined by single dots, as far back as they reach."""
    free = 0
    for m in PORT.finditer(text):
        run = text[_run_before(text, m.start(), free, HOST_CHARS) : m.start()]
        name = run[run.rfind("..") + 2 :] if ".." in run else run
        name = name.removeprefix(".")
        if "." in name and not name.endswith("."):
            yield m.start() - len(name), m.end()
            free = m.end()


def weak(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak parts that no certain secret, and no weak part before them, overlaps."""
    found = []
    if any(k in text.lower() for k in ID_NAMES):
        found += [(m.start(1), 3, m.end(1)) for m in NAMED_ID.finditer(text)]
    if "@" in text:
        found += [(start, 3, end) for start, end in mails(text)]
    if "://" in text:
        found += [(start, 5, end) for start, end in urls(text)]
    if ":" in text:
        found += [(start, 5, end) for start, end in hosts(text)]
    for m in MIXED.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s) and entropy(s) >= LEAST_ENTROPY:
            found.append((m.start(), 4, m.end()))
    kept, free = [], 0
    blocks, at = [(s, e) for s, _, e in taken], 0
    for start, kind, end in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        while at < len(blocks) and blocks[at][1] <= start:
            at += 1
        clash = any(s < end and start < e for s, e in blocks[at : at + 8])
        if start >= free and not clash:
            kept.append((start, kind, end))
            free = end
    return kept


PART = "struct<kind:string,start:long,end:long>"


def parts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the certain spans and the weak candidates of every whole text."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure, maybe = [], []
            for text in batch.column("text").to_pylist():
                one = certain(text or "")
                sure.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in one])
                maybe.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in weak(text or "", one)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sure, span), pa.array(maybe, span)], names=[*keep, "certain", "weak"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return arrow_pass(docs.select(*keep, "text"), rows, ", ".join([*kinds, f"certain array<{PART}>, weak array<{PART}>"]))


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(_row, linked): the weak parts of each row whose scope holds the complementary parts. ``found`` has _row, certain, weak."""
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    part = F.explode(F.concat("certain", "weak")).alias("p")
    rows = found.where(F.size("weak") > 0).select("_row", part).select("_row", "p", role[F.col("p.kind")].alias("role"), F.col("p.start").alias("start"))
    scope = Window.partitionBy("_row").orderBy("start").rangeBetween(-reach, reach)
    near = {r: F.sum((F.col("role") == r).cast("int")).over(scope) for r in ("identifier", "secret", "endpoint")}
    counted = rows.select("_row", "p", *[c.alias(f"_{r}") for r, c in near.items()])
    complete = (
        F.when(F.col("p.kind") == "identifier", F.col("_secret") > 0)
        .when(F.col("p.kind") == "secret", (F.col("_identifier") > 0) | (F.col("_endpoint") > 0))
        .when(F.col("p.kind") == "endpoint", (F.col("_secret") > 0) & (F.col("_identifier") > 0))
        .otherwise(False)
    )
    return counted.where(complete).groupBy("_row").agg(F.collect_list("p").alias("linked"))


def _sorted(spans):
    """By start, then by kind as listed."""
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scanned(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), reach: int = REACH) -> DataFrame:
    """``keep`` columns with certain and all spans, sorted."""
    # the written table fixes the row numbers
    found = staged(parts(docs, keep).withColumn("_row", F.monotonically_increasing_id()))
    whole = found.join(linked(found, reach), "_row", "left")
    spans = F.when(F.col("linked").isNull(), F.col("certain")).otherwise(_sorted(F.concat("certain", "linked")))
    return whole.select(*keep, "certain", spans.alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every reported span replaced; n_chars, where present, follows the new text."""
    own = F.xxhash64("text")
    hits = scanned(docs.select("doc_id", "text", own.alias("_hash")), ("doc_id", "_hash")).where(F.size("spans") > 0)
    hits = hits.dropDuplicates(["doc_id", "_hash"]).select(F.struct(F.col("doc_id").alias("id"), F.col("_hash").alias("hash")).alias("_llm_key"), F.col("spans").alias("_llm_spans"))
    keyed = docs.withColumn("_llm_own", F.struct(F.col("doc_id").alias("id"), own.alias("hash")))
    rows = keyed.join(hits, F.col("_llm_own").eqNullSafe(F.col("_llm_key")), "left")
    # from the back, so that earlier offsets stay; a span inside or across a later cut only goes up to it
    start = F.struct(F.lit("").alias("tail"), F.char_length(text_of()).cast("long").alias("upto"))

    def cut(state, s):
        end = F.least(s["end"], state["upto"])
        after = F.substring(F.col("text"), (end + 1).cast("int"), (state["upto"] - end).cast("int"))
        mended = F.struct(F.concat(F.lit(mark), after, state["tail"]).alias("tail"), s["start"].alias("upto"))
        return F.when(s["end"] > state["upto"], F.struct(state["tail"].alias("tail"), F.least(s["start"], state["upto"]).alias("upto"))).otherwise(mended)

    done = F.aggregate(F.reverse("_llm_spans"), start, cut, lambda s: F.concat(F.substring(F.col("text"), F.lit(1), s["upto"].cast("int")), s["tail"]))
    out = rows.withColumn("text", F.when(F.col("_llm_spans").isNull(), F.col("text")).otherwise(done))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_llm_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)
