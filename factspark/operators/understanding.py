"""What questions name: companies, metrics, ratios, scope, operation, scale.

Phrases come from a table (kind, concept, phrase). While it is small it is
broadcast as a dictionary automaton that finds every phrase in one pass over a
text; a table beyond the limits is joined to the texts' own runs of words
instead. Both give the same mentions.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import lexicon as X
from ..functions import periods as P
from ..functions import scalar as S

#: What a lexicon may hold to be broadcast: rows, and characters of all its phrases.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 8_000_000
SPAN = [("first", pa.int32()), ("last", pa.int32()), ("phrase", pa.string())]
NAMED = "array<struct<first: int, last: int, kind: string, concept: string>>"
#: Spans that a worker gives on at once.
SPANS_A_BATCH = 20_000
_automata: dict[str, object] = {}


def longest_first(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans (first, end, phrase) of which the longest win, then the earliest; none overlaps another."""
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []  # in the order of starts
    for span in sorted(set(found), key=lambda s: (s[0] - s[1], s[0])):
        i = bisect_right(starts, span[0])
        if not (i and taken[i - 1][1] > span[0]) and not (i < len(starts) and starts[i] < span[1]):
            starts.insert(i, span[0])
            taken.insert(i, span)
    return taken


def _whole(text: str, first: int, last: int) -> bool:
    inside = lambda c: c.isascii() and c.isalnum()
    return not (first and inside(text[first - 1])) and not (last < len(text) and inside(text[last]))


def _automaton(key: str, phrases):
    """The automaton of a lexicon; a worker builds it once."""
    import ahocorasick

    if key not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for phrase in phrases():
            a.add_word(phrase, phrase)
        if len(a):
            a.make_automaton()
        _automata[key] = a
    return _automata[key]


def _spans_by(automaton, text: str | None) -> list[tuple[int, int, str]]:
    """What an automaton finds in one pass over a text, as whole words."""
    hits = automaton.iter(text) if text and len(automaton) else ()
    spans = [(end + 1 - len(p), end + 1, p) for end, p in hits]
    return longest_first([s for s in spans if _whole(text, s[0], s[1])])


def _spans_of_words(counts: list[int], starts: dict[str, list[int]] | None, text: str | None) -> Iterator[tuple[int, int, str]]:
    """Spans of a text that begin with a word and hold as many words as a phrase may that begins so; starts None: any phrase."""
    words = [m.span() for m in re.finditer("[0-9a-z]+", text or "")]
    for i, (a, b) in enumerate(words):
        for n in counts if starts is None else starts.get(text[a:b], ()):
            if i + n <= len(words):
                yield a, words[i + n - 1][1], text[a : words[i + n - 1][1]]


def _rows_of(spans_of_text):
    """Batches (id, text) to rows (id, first, last, phrase): a text is a Python text only while it is read, and its spans go on in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = spans_of_text()
        for batch in batches:
            at: list[int] = []
            out: list[tuple[int, int, str]] = []
            for i, text in enumerate(batch.column(1)):
                for span in spans(text.as_py()):
                    at.append(i)
                    out.append(span)
                    if len(out) == SPANS_A_BATCH:
                        yield _batch(batch, at, *zip(*out))
                        at, out = [], []
            if out:
                yield _batch(batch, at, *zip(*out))

    return run


def _batch(texts: pa.RecordBatch, at: list[int], *spans) -> pa.RecordBatch:
    """Spans (firsts, ends, phrases) of the texts at these places of a batch, behind the texts' ids."""
    columns = [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, (_, t) in zip(spans, SPAN)]
    return pa.record_batch([texts.column(0).take(pa.array(at, pa.int64())), *columns], schema=pa.schema([texts.schema.field(0), *(pa.field(*f) for f in SPAN)]))


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, spans) of texts to rows (id, first, last, phrase) of the spans that win."""
    for batch in batches:
        spans, ends = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy(zero_copy_only=False).cumsum()
        first, last = (spans.field(i).to_numpy() for i in (0, 1))
        kept: list[int] = []
        at: list[int] = []
        begin = 0
        for i, end in enumerate(ends):
            # copies of a span differ in their places only
            places = {(int(first[j]), int(last[j])): j for j in range(begin, end)}
            won = list(places.values()) if len(places) == 1 else [places[s[:2]] for s in longest_first([(*s, "") for s in places])]
            kept += won
            at += [i] * len(won)
            begin = end
        won_spans = spans.take(pa.array(kept, pa.int64()))
        yield _batch(batch, at, *(won_spans.field(i) for i in range(3)))


def mentions(texts: DataFrame, lexicon: DataFrame, id_col: str, text_col: str, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS, starts: int = BROADCAST_ROWS) -> DataFrame:
    """(id, first, last, phrase, kind, concept) of the phrases that texts hold as whole words; [first, last) are places from 0.

    Texts and phrases are without marks and in lower case; phrases begin and end
    with a letter a-z or a digit, others are never found. The longest phrase
    wins, then the earliest, and no two overlap; a phrase of several concepts
    gives a row for each. Null and empty texts and phrases have no mentions.
    Texts meet a large lexicon in a join, with the runs of words that begin as
    a phrase does; with any run of words where phrases begin in more than `starts` ways.
    """
    spark = texts.sparkSession
    known = lexicon.filter(F.col("phrase").rlike("^[0-9a-z](.*[0-9a-z])?$")).select("kind", "concept", "phrase").distinct()
    phrases = known.select("phrase").distinct()
    size = phrases.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars")).first()
    asked = texts.select(F.col(id_col), F.col(text_col).alias("_text"))
    told = StructType([asked.schema[0]]).add("first", "integer").add("last", "integer").add("phrase", "string")
    if size["n"] <= rows and size["chars"] <= chars:
        shared = spark.sparkContext.broadcast([r["phrase"] for r in phrases.collect()])  # within the limits just checked
        key = uuid.uuid4().hex

        def by_automaton():
            automaton = _automaton(key, lambda: shared.value)
            return lambda text: _spans_by(automaton, text)

        found = asked.mapInArrow(_rows_of(by_automaton), told)
    else:
        words = F.regexp_extract_all("phrase", F.lit("([0-9a-z]+)"), 1)
        begin = phrases.select(words[0].alias("word"), F.size(words).alias("n")).distinct()
        counts = sorted(r["n"] for r in begin.select("n").distinct().collect())  # a number of words each
        ways = begin.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars")).first()
        by_word: dict[str, list[int]] | None = None
        if ways["n"] <= starts and ways["chars"] <= BROADCAST_CHARS:
            by_word = {}
            for r in begin.collect():  # within the limits just checked
                by_word.setdefault(r["word"], []).append(r["n"])
        shared = spark.sparkContext.broadcast(by_word)

        def by_words():
            ways = shared.value
            return lambda text: _spans_of_words(counts, ways, text)

        spans = asked.mapInArrow(_rows_of(by_words), told).join(phrases, "phrase")
        whole = spans.groupBy(id_col).agg(F.collect_list(F.struct("first", "last", "phrase")).alias("all"))  # of one text
        found = whole.mapInArrow(_longest, told)
    return found.join(known, "phrase").select(id_col, "first", "last", "phrase", "kind", "concept")


def named(text: Column, lexicon: list[tuple[str, str, str]]) -> Column:
    """What spans_of(mentions()) tells of a text, [] without mentions, for a small lexicon of (kind, concept, phrase): no row leaves its text's."""
    meant: dict[str, list[tuple[str, str]]] = {}
    for kind, concept, phrase in sorted(set(lexicon)):
        if re.fullmatch("[0-9a-z](.*[0-9a-z])?", phrase or ""):
            meant.setdefault(phrase, []).append((kind, concept))
    key = uuid.uuid4().hex

    @F.pandas_udf(NAMED)
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(key, lambda: meant)
        for texts in batches:
            yield texts.map(lambda text: [{"first": a, "last": b, "kind": kind, "concept": concept} for a, b, p in _spans_by(automaton, text) for kind, concept in meant[p]])

    return told(text)


def spans_of(found: DataFrame, id_col: str) -> DataFrame:
    """(id, spans): the mentions of each text in one sorted array."""
    return found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("first", "last", "kind", "concept"))).alias("spans"))  # of one text


def resolved(spans: Column, kind: str) -> tuple[Column, Column]:
    """(concepts, status) of a kind among the spans of a text: RESOLVED for one concept, AMBIGUOUS where a phrase has several, MULTIPLE for more phrases, UNRESOLVED for none; concepts in the order of the text."""
    own = F.filter(F.coalesce(spans, F.array().cast("array<struct<first: int, last: int, kind: string, concept: string>>")), lambda s: s["kind"] == kind)
    concepts = F.array_distinct(F.transform(own, lambda s: s["concept"]))
    phrases = F.size(F.array_distinct(F.transform(own, lambda s: s["first"])))
    status = F.when(F.size(own) == 0, "UNRESOLVED").when(F.size(own) > phrases, "AMBIGUOUS").when(F.size(concepts) > 1, "MULTIPLE").otherwise("RESOLVED")
    return concepts, status


def resolution(found: DataFrame, kind: str, id_col: str) -> DataFrame:
    """(id, concepts, status) of a kind, see resolved(); texts without a mention have no row here."""
    concepts, status = resolved(F.col("spans"), kind)
    return spans_of(found.filter(F.col("kind") == kind), id_col).select(id_col, concepts.alias("concepts"), status.alias("status"))


def scope(text: Column, context: Column | None = None) -> tuple[Column, Column]:
    """(scope, status) that a lower-case text names; both is AMBIGUOUS, neither is what the context says (INFERRED) or UNRESOLVED."""
    whole, own = (F.coalesce(X.says(text, *X.SCOPES[k]), F.lit(False)) for k in ("HOP_NHAT", "RIENG"))
    context = F.lit(None).cast("string") if context is None else context
    value = F.when(whole & own, F.lit(None)).when(whole, "HOP_NHAT").when(own, "RIENG").otherwise(context)
    status = F.when(whole & own, "AMBIGUOUS").when(whole | own, "RESOLVED").when(context.isNotNull(), "INFERRED").otherwise("UNRESOLVED")
    return value, status


def operation(text: Column, cues: Column) -> Column:
    """The one operation that a lower-case text names; NONE without any, UNKNOWN for several or no text.

    Growth over an explicit change of year beats comparison. Cues, which are
    text without marks, of growth and of aggregation decide before that.
    """
    change = text.rlike(r"(?<![\p{L}\p{N}_])từ\s+\d{4}\s+sang\s+\d{4}(?![\p{L}\p{N}_])")
    named = {k: X.says(text, *words) for k, words in X.OPERATIONS.items()} | {"GROWTH": text.contains("tăng bao nhiêu %")}
    named["COMPARE"] = named["COMPARE"] | change
    n = sum((f.cast("int") for f in named.values()), F.lit(0))
    single = F.coalesce(*[F.when(f, k) for k, f in named.items()])
    told = F.when(F.trim(text) == "", "UNKNOWN").when(n == 0, "NONE").when(n == 1, single).when((n == 2) & named["GROWTH"] & named["COMPARE"] & change, "GROWTH").otherwise("UNKNOWN")
    has = lambda words: reduce(or_, map(cues.contains, words))
    return F.when(has(X.GROWTH_CUES), "growth").when(has(X.AGGREGATE_CUES), "aggregate").otherwise(F.coalesce(told, F.lit("UNKNOWN")))


def requested_scale(text: Column) -> Column:
    """The one scale that a lower-case text asks for; null for none or several."""
    named = {k: X.says(text, *words) for k, words in X.REQUESTED.items()}
    named["PERCENT"] = named["PERCENT"] | text.rlike("(?<!%)%(?!%)")
    n = sum((f.cast("int") for f in named.values()), F.lit(0))
    return F.when(n == 1, F.coalesce(*[F.when(f, k) for k, f in named.items()]))


def unknown_tickers(text: Column, known: Column) -> Column:
    """Three-letter codes of a text that neither are vocabulary nor in the array of known ones, in order."""
    codes = F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9])([A-Z][A-Z0-9]{2})(?![A-Za-z0-9])"), 1)
    return F.array_except(codes, F.concat(F.coalesce(known, F.array().cast("array<string>")), F.array(*map(F.lit, X.NO_TICKERS))))


def understand(questions: DataFrame, companies: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """One row a question: companies, company_status, metrics, ratios, needed metrics, years, scope, operation, ranking, scale, unknown tickers.

    companies is a table (concept, phrase) of names and tickers. Questions are
    rows of a batch; ids are distinct. A null question names nothing.
    """
    asked = questions.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_asked"))
    asked = asked.select("*", F.lower("_asked").alias("_lower"), S.fold(F.col("_asked")).alias("_folded")).withColumn("_terms", X.canonical_phrasing(F.col("_folded"))).withColumn("_named", named(F.col("_terms"), X.terms()))
    names = companies.select(F.lit("company").alias("kind"), F.col("concept").cast("string").alias("concept"), S.fold(F.col("phrase")).alias("phrase"))
    found = mentions(asked, names, id_col, "_folded")
    out = asked.join(spans_of(found, id_col).withColumnRenamed("spans", "_companies"), id_col, "left")
    companies_, company_status = resolved(F.col("_companies"), "company")
    metrics, ratios = (resolved(F.col("_named"), kind)[0] for kind in ("metric", "ratio"))
    out = out.withColumns({"companies": companies_, "company_status": company_status, "metrics": metrics, "ratios": ratios})
    # the words of a ratio's own name are no cues
    blank = lambda t, s: F.concat(F.substring(t, F.lit(1), s["first"]), F.repeat(F.lit(" "), s["last"] - s["first"]), F.substring(t, s["last"] + 1, F.length(t)))
    cues = F.coalesce(F.aggregate(F.filter("_named", lambda s: s["kind"] == "ratio"), F.col("_terms"), blank), F.col("_terms"))
    lower = F.col("_lower")
    parts = F.create_map(*[x for r, (_, needed) in X.RATIOS.items() for x in (F.lit(r), F.array(*map(F.lit, needed)))])
    value, status = scope(lower)
    return out.select(
        F.col(id_col), "companies", "company_status", "metrics", "ratios",
        F.array_distinct(F.concat("metrics", F.flatten(F.transform("ratios", lambda r: F.element_at(parts, r))))).alias("required_metrics"), P.years(F.col("_asked")).alias("years"),
        value.alias("scope"), status.alias("scope_status"), operation(lower, cues).alias("operation"), X.says(F.col("_folded"), *X.RANKING_CUES).alias("ranking"),
        requested_scale(lower).alias("requested_scale"), unknown_tickers(F.col("_asked"), F.transform("companies", lambda c: F.upper(c))).alias("unknown_tickers"),
    )
