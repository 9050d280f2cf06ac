"""Years and periods in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
#: Words of a folded column header without spaces that name the report's year, or the one before.
CURRENT_WORDS = ("namnay", "kynay", "socuoinam", "socuoiky", "cuoinam", "cuoiky")
PRIOR_WORDS = ("namtruoc", "kytruoc", "sodaunam", "sodauky", "daunam", "dauky")
LONGEST_RANGE = 30


# What joins two years to a range.
RANGE_MARKS, RANGE_WORDS, YEAR_WORDS = ("-", "–"), ("đến", "den", "tới", "toi", "to"), ("năm", "nam")


def years(text: Column) -> Column:
    """Distinct years of a text in order; a range of up to 30 years stands for all between.

    Two years make a range if nothing but a dash or a joining word, and a word for
    year behind it, stands between them; a year ends one range at most.
    """
    word = lambda words: "(?:" + "|".join(words) + r")(?!\p{L})"
    joined = rf"\s*(?:[{''.join(RANGE_MARKS)}]|{word(RANGE_WORDS)})\s*(?:{word(YEAR_WORDS)}\s*)?{YEAR}"
    found = F.regexp_extract_all(text, F.lit(f"{YEAR}(?:{joined})?"), 0)

    def spread(x: Column) -> Column:
        first, last = F.left(x, F.lit(4)).cast("int"), F.right(x, F.lit(4)).cast("int")
        return F.when(F.abs(last - first) <= LONGEST_RANGE, F.sequence(F.least(first, last), F.greatest(first, last))).otherwise(F.array(first, last))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, spread))))


def report_years(periods: Column) -> Column:
    """Distinct years, in order, of an array of YYYY, YYYY-Qn and YYYY-nM; others are left out."""
    fine = F.filter(periods, lambda p: p.rlike(r"^\d{4}(-Q[1-4]|-\d{1,2}M)?$"))
    return F.array_sort(F.array_distinct(F.transform(fine, lambda p: F.substring(p, 1, 4).cast("int"))))


def period_label(text: Column) -> Column:
    """YYYY or YYYY-Qn of a label that is a period and nothing else; null otherwise."""
    year = F.regexp_extract(text, r"(?iu)^([0-9]{4})( ?((triệu|nghìn|ngàn) )?(VND|VNĐ|đồng))?$", 1)
    quarter = r"(?iu)^(?:Q|Quý )([1-4])(?:/| năm )([0-9]{4})$"
    spoken = text.rlike(quarter) & ~text.rlike(r"(?iu)^Q[1-4] năm ")
    return F.when(year != "", year).when(spoken, F.concat(F.regexp_extract(text, quarter, 2), F.lit("-Q"), F.regexp_extract(text, quarter, 1)))


def periods(text: Column) -> Column:
    """Canonical periods named in a folded text: quy n/YYYY, luy ke n thang YYYY, and other years."""
    quarter = F.regexp_extract_all(text, F.lit(r"(quy [1-4] ?(?:/|nam) ?(?:19|20)\d{2})"), 1)
    months = F.regexp_extract_all(text, F.lit(r"(luy ke \d{1,2} thang (?:dau )?(?:nam )?(?:19|20)\d{2})"), 1)
    rest = F.regexp_replace(text, r"quy [1-4] ?(?:/|nam) ?(?:19|20)\d{2}|luy ke \d{1,2} thang (?:dau )?(?:nam )?(?:19|20)\d{2}", " ")
    found = F.concat(
        F.transform(quarter, lambda q: F.concat(F.substring(q, -4, 4), F.lit("-Q"), F.substring(q, 5, 1))),
        F.transform(months, lambda m: F.concat(F.substring(m, -4, 4), F.lit("-"), F.regexp_extract(m, r"(\d{1,2}) thang", 1), F.lit("M"))),
        F.regexp_extract_all(rest, F.lit(YEAR), 1),
    )
    return F.array_sort(F.array_distinct(found))


def column_period(header: Column, report_year: Column) -> Column:
    """CURRENT or PRIOR of a folded column header; null if nothing in it tells, or if what tells disagrees.

    Each word of the fixed lists, each date and each other year is a vote: +1 for
    the report's year, -1 for the one before. 1 January of the report's year is
    the end of the year before; other years don't vote.
    """
    compact = F.translate(header, " ", "")
    words = [F.when(compact.contains(w), v) for v, named in ((1, CURRENT_WORDS), (-1, PRIOR_WORDS)) for w in named]
    pieces = F.regexp_extract_all(header, F.lit(r"((?:\d{1,2}\s*[/.\-]\s*\d{1,2}\s*[/.\-]\s*)?(?<!\d)(?:19|20)\d{2}(?!\d))"), 1)

    def vote(piece: Column) -> Column:
        since = report_year - F.substring(piece, -4, 4).cast("int")
        new_year = piece.rlike(r"^0?1\s*[/.\-]\s*0?1\s*[/.\-]")
        return F.when(since == 0, F.when(new_year, -1).otherwise(1)).when((since == 1), -1)

    votes = F.filter(F.concat(F.array(*words), F.transform(pieces, vote)), lambda v: v.isNotNull())
    return F.when(F.size(F.array_distinct(votes)) == 1, F.when(votes[0] > 0, "CURRENT").otherwise("PRIOR"))


def path_period(label: Column, report_year: Column) -> Column:
    """The report's year where a folded label says "nam nay"; "nam truoc" is left unmapped."""
    return F.when(label == "nam nay", report_year)


def current_first(header_a: Column, header_b: Column, report_year: Column) -> Column:
    """Which of two folded columns is the current one: 1, 2, or null where the headers don't tell."""
    a, b = column_period(header_a, report_year), column_period(header_b, report_year)
    first = (a == "CURRENT") & F.coalesce(b != "CURRENT", F.lit(True)) | (b == "PRIOR") & a.isNull()
    second = (b == "CURRENT") & F.coalesce(a != "CURRENT", F.lit(True)) | (a == "PRIOR") & b.isNull()
    return F.when(F.coalesce(first, F.lit(False)), 1).when(F.coalesce(second, F.lit(False)), 2)


def chronological(period: Column) -> Column:
    """Sort key of a period: its year, then its quarter or months; a whole year comes last."""
    sub = F.regexp_extract(period, r"-(?:Q(\d)|(\d{1,2})M)$", 0)
    months = F.when(sub.rlike("Q"), F.regexp_extract(period, r"Q(\d)", 1).try_cast("int") * 3).when(sub.rlike("M"), F.regexp_extract(period, r"-(\d{1,2})M", 1).try_cast("int")).otherwise(13)
    return F.struct(F.substring(period, 1, 4).cast("int").alias("year"), months.alias("months"))
