"""Quality rules by tokeniser fertility.

Public vocabularies measure a text: code points per token (byte-level BPE), the share of its bytes that a
piece vocabulary can only spell byte by byte, and the entropy of its tokens. A text outside the band of
its language is rejected; texts without a language have one band for each script. Words are encoded once per
worker and looked up afterwards; the tokens of a text are those of its words, each with one leading space.

Null texts have no words and fail; rows without a language are grouped by script, apart from every named language;
repeated rows are judged alike, rows that share an id each by its own text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossweave.session import lookup_join, staged

from .common import arrow_pass
from .packing import CACHE_WORDS, LONGEST_KEPT, VOCABULARY, load_encoding

PIECES = "piece_bpe_32k.model"
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 0.5

# Parameters: outer bands by script: least and most code points per token, most byte-fallback share,
# least bits of token entropy. Inside them each language has a band of its own, taken over all documents
# that pass the base rules: median plus or minus SPREAD robust deviations, where a deviation counts as at
# least LEAST_DEVIATION of the median. At every size, median and deviation are shrunk towards the mean of the
# languages of the script, which counts as PRIOR documents and adds the distance between languages to the deviation.
OUTER = {"latin": (1.2, 8.0, 0.05, 3.0), "other": (0.3, 6.0, 0.6, 3.0)}
SPREAD, LEAST_DEVIATION, PRIOR = 4.0, 0.02, 10
ACCURACY = 10_000
ENTROPY_WINDOW = 64  # tokens; the least words of a text make about as many

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, fallback_share double, token_entropy double, entropy_share double, latin boolean"
)


class Vocabulary:
    """Ids of words, remembered up to a bound, and which characters the piece vocabulary has to spell in bytes."""

    def __init__(self, bpe_path: str, piece_path: str):
        self.bpe, self.pieces = load_encoding(bpe_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.ids: dict[bytes, bytes] = {}
        self.spelled: dict[str, bool] = {}

    def learn(self, word: bytes) -> bytes:
        if len(self.ids) >= CACHE_WORDS:
            self.ids.clear()
        found = array("I", self.bpe.encode_ordinary(" " + word.decode())).tobytes()
        if len(word) <= LONGEST_KEPT:
            self.ids[word] = found
        return found

    def tokens(self, words: list[bytes]) -> np.ndarray:
        known = self.ids
        return np.frombuffer(b"".join([known.get(w) or self.learn(w) for w in words]), np.uint32)

    def spelled_bytes(self, text: str) -> int:
        """Bytes outside the white space that have no piece: merges start from characters, so none can absorb them."""
        total = 0
        for c in set(text):
            spelled = self.spelled.get(c)
            if spelled is None:
                spelled = self.spelled[c] = c not in SPACES and any(map(self.pieces.is_byte, self.pieces.encode(c)))
            if spelled:
                total += text.count(c) * len(c.encode())
        return total


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that occurs at least twice."""
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    twice = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


DIGESTS = ("_first", "_second")  # 128 bits tell texts apart


def digests() -> list[Column]:
    return [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]


def window_share(ids: np.ndarray, width: int = ENTROPY_WINDOW) -> float:
    """Mean entropy of consecutive windows of ``width`` tokens over the whole text, as a share of the most possible.

    The last window ends with the text and may overlap the one before; a shorter text is one window.
    """
    n = len(ids)
    width = min(n, width)
    if width < 2:
        return 1.0
    whole = n // width
    windows = ids[: whole * width].reshape(whole, width)
    if n % width:
        windows = np.vstack((windows, ids[-width:]))
    windows = np.sort(windows, axis=1)
    new = np.ones(windows.shape, bool)
    new[:, 1:] = windows[:, 1:] != windows[:, :-1]
    runs = np.diff(np.append(np.flatnonzero(new), windows.size))
    return float(1 - (runs * np.log2(runs)).sum() / (windows.size * np.log2(width)))


def measure(text: str, vocabulary: Vocabulary) -> tuple:
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    ids = vocabulary.tokens(words)
    spelled = vocabulary.spelled_bytes(text)
    entropy = share = 0.0
    if len(ids):
        counts = np.unique(ids, return_counts=True)[1]
        p = counts / len(ids)
        entropy = float(-(p * np.log2(p)).sum())
        share = window_share(ids)
    size = len(data) - sum(map(text.count, SPACES))
    # code points below U+0250, by their lead bytes; the continuation bytes of the text are left out
    lead = np.frombuffer(data, np.uint8)
    lead = lead[(lead & 0xC0) != 0x80]
    latin = text.isascii() or 2 * np.count_nonzero((lead < 0x80) | ((lead >= 0xC2) & (lead <= 0xC9))) >= len(lead)
    return (
        len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(ids),
        chars / len(ids) if len(ids) else 0.0, spelled / size if size else 0.0, entropy, float(share), bool(latin),
    )


def measured(docs: DataFrame, bpe: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, lang, two digests of the text and the measures of every whole text."""
    bpe, pieces = bpe or public_tokenizers.path(VOCABULARY), pieces or public_tokenizers.path(PIECES)
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang")]
    fields = [(x.split()[0], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]]) for x in METRICS.split(", ")]

    own = ["doc_id", "lang", *DIGESTS]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(bpe, pieces)
        for batch in batches:
            found = [measure(t or "", vocabulary) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[k] for r in found], kind) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), *columns], names=[*own, *(n for n, _ in fields)])

    return arrow_pass(docs.select("doc_id", "lang", "text", *(c.alias(n) for n, c in zip(DIGESTS, digests()))), rows, ", ".join([*kinds, *(f"{n} long" for n in DIGESTS), METRICS]))


def language_bands(good: DataFrame, spread: float) -> DataFrame:
    """_band with _few, _many and _flat: the least and most code points per token and the least entropy share."""
    both = {"chars_per_token": "c", "entropy_share": "e"}
    quarters = [F.percentile_approx(c, [0.25, 0.5, 0.75], ACCURACY).alias(x) for c, x in both.items()]
    own = good.groupBy("_band").agg(F.count("*").alias("_n"), (F.avg(F.col("latin").cast("int")) >= 0.5).alias("_latin"), *quarters)
    own = own.withColumn("w", F.col("_n") / (F.col("_n") + PRIOR))
    for x in both.values():
        own = own.withColumn(f"m{x}", F.col(x)[1]).withColumn(f"d{x}", F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, LEAST_DEVIATION * F.col(x)[1]))
    own = staged(own)
    mean = lambda v: F.sum(F.col("w") * v) / F.sum("w")
    parts = [(mean(F.col(f"m{x}")).alias(f"M{x}_"), mean(F.col(f"d{x}")).alias(f"D{x}_"), mean(F.col(f"m{x}") ** 2).alias(f"S{x}_")) for x in both.values()]
    script = own.groupBy("_latin").agg(*[p for some in parts for p in some])

    def limit(x: str, sign: int):
        w, rest = F.col("w"), 1 - F.col("w")
        apart = F.greatest(F.col(f"S{x}_") - F.col(f"M{x}_") ** 2, F.lit(0.0))
        deviation = F.sqrt((w * F.col(f"d{x}") + rest * F.col(f"D{x}_")) ** 2 + rest**2 * apart)
        return w * F.col(f"m{x}") + rest * F.col(f"M{x}_") + sign * spread * deviation

    return own.join(script, "_latin").select("_band", limit("c", -1).alias("_few"), limit("c", 1).alias("_many"), limit("e", -1).alias("_flat"))


def judged(docs: DataFrame, spread: float = SPREAD, **paths: str) -> DataFrame:
    """The measures with base_failed, the first limit a text breaks (``rejected_by``) and kept."""
    return _judged(docs, spread, **paths).drop(*DIGESTS)


def _judged(docs: DataFrame, spread: float = SPREAD, **paths: str) -> DataFrame:
    script = F.when(F.col("latin"), "~latin").otherwise("~other")  # texts without a language are a group of their script
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    m = staged(measured(docs, **paths).withColumn("base_failed", failed).withColumn("_band", F.coalesce(F.concat(F.lit("="), "lang"), script)))
    bands = language_bands(m.where("not base_failed"), spread)
    outer = [F.when(F.col("latin"), x).otherwise(y) for x, y in zip(OUTER["latin"], OUTER["other"])]
    rejected = (
        F.when(F.col("chars_per_token") < F.greatest("_few", outer[0]), "few_chars_per_token")
        .when(F.col("chars_per_token") > F.least("_many", outer[1]), "many_chars_per_token")
        .when(F.col("fallback_share") > outer[2], "byte_fallback")
        .when((F.col("token_entropy") < outer[3]) | (F.col("entropy_share") < F.col("_flat")), "low_entropy")
    )
    out = lookup_join(m, bands, ["_band"]).withColumn("rejected_by", rejected)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("_band", "_few", "_many", "_flat")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    The verdict follows from language and text, so rows that share an id, or have none, are told apart by both.
    """
    bad = _judged(docs, **options).where("not kept").select(*[F.col(c).alias(f"bad_{c}") for c in ("doc_id", "lang", *DIGESTS)]).distinct()
    keys = {"doc_id": F.col("doc_id"), "lang": F.col("lang"), **dict(zip(DIGESTS, digests()))}
    made = docs.select(F.struct(*docs.columns).alias("_d"), *[c.alias(f"own_{n}") for n, c in keys.items()])
    same = [F.col(f"own_{n}").eqNullSafe(F.col(f"bad_{n}")) for n in keys]
    return made.join(bad, same, "left_anti").select("_d.*")
