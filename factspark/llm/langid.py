"""Language identification by compression.

One zstandard raw-content dictionary per language holds labelled text. A text is
compressed with each; the language whose dictionary gives the smallest result is
the prediction, and a narrow margin over the second is a rejection.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, small_batches, table, tidy

#: Bounded sample: about so many labelled rows a language reach the driver; a dictionary takes so many bytes
#: of them, and so many of one text at most, so that no single text fills it.
SAMPLE_ROWS = 400
DICT_BYTES = 131_072
TEXT_BYTES = 16_384
LEVEL = 9
#: A margin below this share of the second-best size is narrow.
NARROW = 0.0005
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def fit_dictionaries(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary for each language of rows that are not held out.

    Rows are taken by a hash of their id, at a rate that gives about SAMPLE_ROWS
    a language, so what reaches the driver doesn't grow with the table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 30))
    rate = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1, SAMPLE_ROWS / n)))) for lang, n in counts.items()]) if counts else F.lit(0)
    taken: dict[str, list] = {lang: [] for lang in counts}
    # of a longer text the dictionary could hold no more than its own size
    for r in rows.filter(draw < rate).select("lang", draw.alias("draw"), F.substring("text", 1, DICT_BYTES).alias("text")).collect():
        taken[r["lang"]].append((r["draw"], r["text"]))
    out = {}
    for lang, found in taken.items():
        parts, size = [], 0
        for _, text in sorted(found):
            if size >= DICT_BYTES:
                break
            parts.append(text.encode("utf-8", "surrogatepass")[:TEXT_BYTES])
            size += len(parts[-1])
        if data := b"\n".join(parts)[-DICT_BYTES:]:
            out[lang] = data
    return out


@functools.lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, data in dictionaries:
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False)))
    return out


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float, float]:
    """(language, score, margin); the whole text is compressed, ties go to the first language by name."""
    if not dictionaries or not text or not LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    data = text.encode("utf-8", "surrogatepass")
    sizes = sorted((len(c.compress(data)), lang) for lang, c in _compressors(dictionaries))
    best, lang = sizes[0]
    second = sizes[1][0] if len(sizes) > 1 else 2 * best
    margin = (second - best) / second
    return lang, margin / (margin + 0.02), margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """All columns of docs in one struct `row`, with lang_pred, score (0 to 1) and accepted.

    A null text and one without letters are `und` with score 0, not accepted; so
    is everything if nothing was learned. Only the text is looked at.
    """
    small_batches(docs.sparkSession)
    known = tuple(sorted(dictionaries.items()))

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def tell(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            found = [classify(t, known) for t in text]
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "accepted": [x[0] != UNKNOWN and x[2] >= NARROW for x in found]})
        tidy()

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), tell(F.col(text_col)).alias("told"))
    return rows.select("row", "told.lang_pred", "told.score", "told.accepted")


def _held_out(doc_id):
    return F.pmod(id_crc(doc_id), F.lit(3)) == 1


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit_dictionaries(docs, _held_out))
    return out.select("row.doc_id", _held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
