"""Scalar functions as column expressions; JVM-side but for the normalisation of other than Latin text, which Spark lacks."""

from __future__ import annotations

import html
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Magnitudes of the scales.
SCALES = {"RAW": 1, "THOUSAND": 1_000, "MILLION": 1_000_000, "BILLION": 1_000_000_000}
#: What stands for a missing figure.
MISSING = ("", "-", "‒", "–", "—", "―", "−")


def _settled(text: str) -> str:
    while (plain := html.unescape(text)) != text:
        text = plain
    return text


@F.pandas_udf(StringType())
def _normalized(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", _settled(unicodedata.normalize("NFKC", x))).split()))


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        marked = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", x).translate({0x111: "d", 0x110: "D"}))
        return " ".join("".join(c for c in marked if not unicodedata.combining(c)).casefold().split())

    return text.map(one)


@F.pandas_udf(StringType())
def _folded_in_place(text: pd.Series) -> pd.Series:
    def one(c: str) -> str:
        if c in "đĐ":
            return "d" if c == "đ" else "D"
        base = unicodedata.normalize("NFD", c)[0]
        return c if unicodedata.combining(base) else base

    return text.map(lambda x: None if x is None else "".join(map(one, x)))


def _folded_char(c: str) -> str:
    return "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d)).translate({0x111: "d", 0x110: "D"}).casefold()


# Latin letters, marks and punctuation whose folding is one character or none, and what it is; folding goes character by character.
_BLOCKS = [(0xA0, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x20A0, 0x20C0)]
_LATIN = [c for a, b in _BLOCKS for c in map(chr, range(a, b)) if len(_folded_char(c)) < 2 and not c.isspace() and _folded_char(c).lower() == _folded_char(c)]
_KEPT = [c for c in _LATIN if _folded_char(c)]
_FROM, _TO = "".join(_KEPT) + "".join(c for c in _LATIN if not _folded_char(c)), "".join(map(_folded_char, _KEPT))
_RUNS = [(a, next(b for b in range(ord(a), 0x110000) if chr(b + 1) not in _LATIN)) for a in _LATIN if chr(ord(a) - 1) not in _LATIN]
_COVERED = "^[\\x00-\\x7F" + "".join(f"\\x{{{ord(a):X}}}-\\x{{{b:X}}}" for a, b in _RUNS) + "]*+\\z"
_SPACES = r"[\t-\r\x1C-\x20]{2,}|[\t-\r\x1C-\x1F]"


def normalize(text: Column) -> Column:
    """NFKC, HTML entities decoded until none is left, white space single; null stays null."""
    return _normalized(text)


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def left_to_python(text: Column) -> Column:
    """Texts that hold other than Latin characters; null for the rest, so that Python gets no more than it must."""
    return F.when(~_ascii(text), F.when(~text.rlike(_COVERED), text))


def fold(text: Column) -> Column:
    """Case-folded text of compatibility characters without marks, single-spaced; đ is d."""
    spaced = lambda c: F.trim(F.regexp_replace(F.lower(c), _SPACES, " "))
    return F.when(_ascii(text), spaced(text)).when(text.rlike(_COVERED), spaced(F.translate(text, _FROM, _TO))).otherwise(_folded(left_to_python(text)))


def fold_punct(text: Column) -> Column:
    """fold() with all but letters a-z and digits as single spaces."""
    return F.trim(F.regexp_replace(fold(text), "[^0-9a-z]+", " "))


def fold_in_place(text: Column) -> Column:
    """Marks stripped character by character, so that places still hold; case stays."""
    return _folded_in_place(text)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _without_notes(words: Column) -> Column:
    """An array of words without the parentheses behind them: what closes at the end is followed back to where it opens."""
    opened = lambda w: F.length(F.regexp_replace(w, r"[^()]", "")) - 2 * F.length(F.regexp_replace(w, r"[^(]", ""))  # noqa: E731  closing less opening ones

    def back(state: Column, word: Column) -> Column:
        depth = state["depth"] + opened(word)
        inside = (state["depth"] > 0) | ((F.size(state["kept"]) == 0) & word.endswith(")"))
        whole = (depth == 0) & word.startswith("(")
        return F.struct(F.when(inside & ~whole, F.greatest(depth, F.lit(0))).otherwise(0).alias("depth"), F.when(inside, state["kept"]).otherwise(F.concat(F.array(word), state["kept"])).alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    return F.aggregate(F.reverse(words), start, back)["kept"]


def label_key(label: Column) -> Column:
    """Folded label without ordinals in front and parentheses behind.

    Ordinals are leading words of digits and dots, of Roman numerals or of one
    letter, with a mark behind, and bare numbers of two digits at most or dotted ones; they go
    until a word is none. Parentheses at the end go with all that they hold.
    """
    spaced = F.regexp_replace(F.regexp_replace(fold(label), r"\(", " ("), r"(?<=[).:])(?=[^\s).:0-9])|(?<=\))(?=[0-9])", " ")
    words = F.filter(F.split(spaced, " +"), lambda w: F.regexp_replace(w, "[:.\\-]", "") != "")
    ordinal = lambda w: w.rlike(r"^([0-9]+(\.[0-9]+)*|[ivxlc]+|[a-z])[.)\-:]$|^[0-9]{1,2}(\.[0-9]{1,2})*$")

    def drop(kept: Column, word: Column) -> Column:
        return F.when((F.size(kept) == 0) & ordinal(word), kept).otherwise(F.concat(kept, F.array(word)))

    return let(F.aggregate(_without_notes(words), F.array().cast("array<string>"), drop), lambda w: F.trim(F.array_join(w, " "), F.lit(" :.-")))


def answer_norm(text: Column) -> Column:
    """Letters, digits, full stops and hyphens of the lower-cased text."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.\-]", "")


def phrase_count(text: Column, phrase: str) -> Column:
    """Times that a folded text holds a phrase as whole words."""
    return F.regexp_count(text, F.lit(rf"(?<![0-9a-z])\Q{phrase}\E(?![0-9a-z])"))


def parse_number(raw: Column) -> tuple[Column, Column, Column]:
    """(status, decimal, percent) of a printed number.

    Dots or single spaces group thousands, a comma starts decimals, parentheses
    or a minus negate, a plus is allowed. MISSING for empty text and dashes;
    AMBIGUOUS for numbers grouped or pointed the other way; MALFORMED for what
    has a sign, parenthesis, percent mark or leading digit but no such form;
    NOT_NUMERIC otherwise. Null counts as missing. Decimals beyond 38 digits or
    18 places are MALFORMED here, as Spark can't hold them.
    """
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\s ]+", " "))
    told = let(text, _number)
    status = told["status"]
    return status, F.when(status == "PARSED", told["value"]), told["percent"]


def _shape(figure: Column) -> Column:
    """How digits are parted: (groups of digits, separators in order); null unless groups and single separators alternate."""
    apart = F.struct(F.split(figure, "[., ]").alias("groups"), F.regexp_replace(figure, "[0-9]", "").alias("marks"))
    return F.when(figure.rlike("^[0-9]+([., ][0-9]+)*$"), apart)


def _thousands(groups: Column) -> Column:
    """Three digits in every group but the first, which has one to three."""
    return (F.length(groups[0]) <= 3) & F.forall(F.slice(groups, F.lit(2), F.greatest(F.size(groups) - 1, F.lit(0))), lambda g: F.length(g) == 3)


def _judged(shape: Column) -> Column:
    """GOOD for grouping dots or spaces and a decimal comma, OTHER for the marks the other way round; null for neither."""
    groups, marks = shape["groups"], shape["marks"]
    whole = F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(1)))  # without what follows the last mark
    good = (marks == "") | (marks == ",") | (marks.rlike(r"^(\.+| +)$") & _thousands(groups)) | (marks.rlike(r"^\.+,$") & _thousands(whole))
    other = (marks == ".") | (marks.rlike("^,,+$") & _thousands(groups)) | (marks.rlike(r"^,+\.$") & _thousands(whole))
    return F.when(shape.isNull(), F.lit(None)).when(good, "GOOD").when(other, "OTHER")


def _number(t: Column) -> Column:
    percent = t.endswith("%")
    body = F.when(percent, F.rtrim(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t)

    def signs(b: Column) -> Column:
        wrapped = b.startswith("(") & b.endswith(")") & (F.length(b) > 2) & ~F.substring(b, F.lit(2), F.length(b) - 2).rlike(r"^[+\-]|[()]")
        signed = b.rlike(r"^[+\-]")
        bare = F.when(wrapped, F.substring(b, F.lit(2), F.length(b) - 2)).when(signed, F.substring(b, F.lit(2), F.length(b))).otherwise(b)
        return F.struct(wrapped.alias("wrapped"), signed.alias("signed"), (wrapped | b.startswith("-")).alias("negative"), bare.alias("bare"), b.alias("body"))

    def judged(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("wrapped", "signed", "negative", "bare", "body")], let(_shape(x["bare"]), _judged).alias("judged"))

    def told(x: Column) -> Column:
        plain = F.translate(F.translate(x["bare"], ". ", ""), ",", ".")
        odd = (~x["wrapped"] & x["body"].rlike(r"^\(|\)$")) | x["body"].contains("%") | (x["bare"] == "")
        status = (
            F.when(t.isin(*MISSING), "MISSING").when(odd, "MALFORMED").when(x["judged"] == "GOOD", "PARSED").when(x["judged"] == "OTHER", "AMBIGUOUS")
            .when(percent | x["wrapped"] | x["signed"] | x["bare"].rlike(r"^[0-9+\-(−]"), "MALFORMED").otherwise("NOT_NUMERIC")
        )
        value = F.when(x["judged"] == "GOOD", F.concat(F.when(x["negative"], "-").otherwise(""), plain).try_cast("decimal(38,6)"))
        return F.struct(status.alias("status"), value.alias("value"), (percent & (t != "%")).alias("percent"))

    return let(let(let(body, signs), judged), told)


def to_scale(value: Column, source: str, target: str) -> Column:
    """Exact change of magnitude; PERCENT only to itself; unknown or missing scales are errors."""
    if source == target == "PERCENT":
        return value.cast("decimal(38,6)")
    if source not in SCALES or target not in SCALES:
        raise ValueError(f"no conversion from {source} to {target}")
    return (value.cast("decimal(28,6)") * SCALES[source] / SCALES[target]).cast("decimal(38,6)")


def figure(raw: Column, label: Column, scale: Column) -> Column:
    """A printed figure in base units: number times scale; lines per share are not scaled, percentages are no figures."""
    status, value, percent = parse_number(raw)
    factor = F.coalesce(*[F.when(scale == name, F.lit(n)) for name, n in SCALES.items()])
    per_share = fold(label).rlike("tren (mot )?co phieu|per share")
    return F.when((status == "PARSED") & ~percent, value * F.when(per_share, F.lit(1)).otherwise(factor))


# Folded words before a unit that scale it, and those that name the currency.
UNIT_SCALES = {"trieu": "MILLION", "nghin": "THOUSAND", "ngan": "THOUSAND", "ty": "BILLION"}
CURRENCIES = ("vnd", "dong")


def unit_scale(text: Column) -> Column:
    """The scale that a folded declaration of the currency unit names last; null without one.

    A declaration is "don vi", "don vi tinh" or "dvt", then a scale or none, then a
    currency, with a colon or spaces between; read word by word.
    """
    words = F.filter(F.split(F.regexp_replace(text, r"[^0-9a-z]+", " "), " "), lambda w: w != "")

    def read(state: Column, word: Column) -> Column:
        asks, scale = state["asks"], F.coalesce(*[F.when(word == k, v) for k, v in UNIT_SCALES.items()])
        begins = (word == "dvt") | ((word == "vi") & (state["before"] == "don"))
        goes_on = asks & ((word == "tinh") & (state["before"] == "vi") | scale.isNotNull() & state["scale"].isNull())
        said = asks & word.isin(*CURRENCIES)
        return F.struct(
            (begins | goes_on).alias("asks"), F.when(begins, F.lit(None).cast("string")).when(goes_on, F.coalesce(scale, state["scale"])).alias("scale"),
            F.when(said, F.coalesce(state["scale"], F.lit("RAW"))).otherwise(state["found"]).alias("found"), word.alias("before"),
        )

    none = F.lit(None).cast("string")
    return F.aggregate(words, F.struct(F.lit(False).alias("asks"), none.alias("scale"), none.alias("found"), F.lit("").alias("before")), read)["found"]


def close(left: Column, right: Column) -> Column:
    """Equal within four units in the last place of the right value, and 1e-12 at least."""
    size = F.greatest(F.abs(right), F.lit(2.2250738585072014e-308))
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(size)) - 52)
    return F.abs(left - right) <= F.greatest(4 * ulp, F.lit(1e-12))


def relatively_close(left: Column, right: Column, tolerance: float) -> Column:
    """Equal within a share of the larger; both zero are equal."""
    return F.abs(left - right) <= tolerance * F.greatest(F.abs(left), F.abs(right))


def perturb(value: Column, i: Column) -> Column:
    """The metamorphic probe of the i-th row."""
    return value * (F.lit(1.1) + (i % 7) / 10) + i % 7 + 17


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def unit_vector(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, norm(a) * norm(b))))


def fact_id(*parts: Column) -> Column:
    return F.concat(F.lit("f_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20))


def canonical_decimal(value: Decimal) -> str:
    """Plain digits without trailing zeros; no minus before zero."""
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text
