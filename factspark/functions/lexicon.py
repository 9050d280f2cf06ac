"""Word lists of questions, and phrases that are written in several ways."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import let

# What metrics are called, without marks and in lower case.
METRICS = {
    "GROSS_REVENUE": ["doanh thu ban hang va cung cap dich vu", "doanh thu gop", "gross revenue"],
    "NET_REVENUE": ["doanh thu thuan", "doanh thu", "net revenue", "revenue", "net sales"],
    "COGS": ["gia von hang ban", "gia von", "cogs", "cost of goods sold"],
    "GROSS_PROFIT": ["loi nhuan gop", "lai gop", "gross profit"],
    "FINANCIAL_INCOME": ["doanh thu hoat dong tai chinh", "doanh thu tai chinh", "financial income"],
    "FINANCIAL_EXPENSES": ["chi phi tai chinh", "financial expenses"],
    "INTEREST_EXPENSE": ["chi phi lai vay", "lai vay", "interest expense"],
    "OPERATING_PROFIT": ["loi nhuan thuan tu hoat dong kinh doanh", "loi nhuan tu hoat dong kinh doanh", "operating profit"],
    "PROFIT_BEFORE_TAX": ["loi nhuan truoc thue", "tong loi nhuan ke toan truoc thue", "lntt", "profit before tax", "pbt"],
    "LNST": ["loi nhuan sau thue", "lnst", "net income", "net profit", "profit after tax"],
    "LNST_PARENT": ["loi nhuan sau thue cua co dong cong ty me", "loi nhuan sau thue cong ty me", "lnst cong ty me"],
    "CURRENT_ASSETS": ["tai san ngan han", "current assets"],
    "CASH_AND_EQUIVALENTS": ["tien va cac khoan tuong duong tien", "tien va tuong duong tien", "cash and cash equivalents"],
    "INVENTORIES": ["hang ton kho", "inventories", "inventory"],
    "TOTAL_ASSETS": ["tong tai san", "tong cong tai san", "total assets"],
    "LIABILITIES": ["no phai tra", "tong no phai tra", "tong no", "total liabilities", "liabilities"],
    "CURRENT_LIABILITIES": ["no ngan han", "no phai tra ngan han", "current liabilities"],
    "EQUITY": ["von chu so huu", "tong von chu so huu", "vcsh", "equity", "owners' equity"],
    "CFO": ["luu chuyen tien thuan tu hoat dong kinh doanh", "operating cash flow", "cfo"],
    "CFI": ["luu chuyen tien thuan tu hoat dong dau tu", "investing cash flow"],
    "CFF": ["luu chuyen tien thuan tu hoat dong tai chinh", "financing cash flow"],
}
# What ratios are called, and the metrics they are made of.
RATIOS = {
    "ROE": (["roe", "ty suat loi nhuan tren von chu so huu", "ty suat loi nhuan tren von chu so huu binh quan", "return on equity"], ["LNST", "EQUITY"]),
    "ROA": (["roa", "ty suat loi nhuan tren tong tai san", "ty suat loi nhuan tren tong tai san binh quan", "return on assets"], ["LNST", "TOTAL_ASSETS"]),
    "GROSS_MARGIN": (["bien loi nhuan gop", "bien gop", "ty suat loi nhuan gop", "gross margin"], ["GROSS_PROFIT", "NET_REVENUE"]),
    "NET_MARGIN": (["bien loi nhuan rong", "bien loi nhuan sau thue", "bien rong", "ty suat loi nhuan rong", "net margin"], ["LNST", "NET_REVENUE"]),
    "DEBT_TO_EQUITY": (["no tren von chu so huu", "no phai tra tren von chu so huu", "no/von chu so huu", "d/e", "debt to equity"], ["LIABILITIES", "EQUITY"]),
    "CURRENT_RATIO": (["he so thanh toan hien hanh", "kha nang thanh toan hien hanh", "current ratio"], ["CURRENT_ASSETS", "CURRENT_LIABILITIES"]),
}
# Words that name a scope, an operation, a scale; marks count.
SCOPES = {"HOP_NHAT": ["hợp nhất"], "RIENG": ["riêng", "công ty mẹ"]}
OPERATIONS = {"RATIO": ["roe", "tỷ lệ", "tỷ suất"], "GROWTH": ["tăng bao nhiêu %"], "AGGREGATE": ["trung bình"], "COMPARE": ["so sánh", "so với"]}
REQUESTED = {"THOUSAND": ["nghìn", "ngàn"], "MILLION": ["triệu"], "BILLION": ["tỷ"], "PERCENT": ["phần trăm"]}
# Cues in text without marks.
GROWTH_CUES = ["tang truong", "growth", "tang bao nhieu %"]
AGGREGATE_CUES = ["trung binh", "binh quan", "average", "mean", "tong lnst", "sum"]
RANKING_CUES = ["top", "cao nhat", "lon nhat", "thap nhat", "nho nhat", "xep hang", "nhieu nhat", "it nhat", "highest", "lowest", "largest", "smallest", "rank"]
NO_TICKERS = ["ROE", "ROA", "EPS", "VND", "USD", "CFO", "CFI", "CFF", "PBT", "TOP", "LNST", "COGS", "BCTC"]

#: Phrases and how they are written uniformly, applied in this order to text without marks. [a|b] may be
#: missing, (a|b) is one of these, {a|b} one that {1}, {2} repeat; `unless` names words before or after.
PHRASINGS = [
    ("lai {gop|truoc thue|sau thue|rong}", "loi nhuan {1}", [], []),
    ("loi nhuan ke toan {truoc|sau} thue", "loi nhuan {1} thue", [], []),
    ("loi nhuan rong", "loi nhuan sau thue", ["ty suat", "bien"], []),
    ("[quy mo] tong [gia tri] tai san", "tong tai san", [], []),
    ("von chu", "von chu so huu", [], ["so huu"]),
    ("(luu chuyen tien|dong tien) [thuan] [tu|trong|cua] hoat dong {kinh doanh|dau tu|tai chinh}", "luu chuyen tien thuan tu hoat dong {1}", [], []),
    ("(ty so|ty le|chi so|he so|kha nang) thanh toan (hien hanh|ngan han)", "he so thanh toan hien hanh", [], []),
    ("[ty le|ty so|he so|chi so] no [phai tra] (/|tren) [tong] von chu so huu", "no tren von chu so huu", [], []),
    ("[ty suat|he so] (loi nhuan sau thue|loi nhuan|sinh loi) tren {von chu so huu|tong tai san}", "ty suat loi nhuan tren {1}", [], []),
]


def phrasing_pattern(form: str, before: list[str], after: list[str]) -> str:
    """The regular expression of a form of PHRASINGS, as whole words."""
    out, gap, last = "", "", ""
    for word in re.findall(r"\[[^]]*\]|\([^)]*\)|\{[^}]*\}|[^ ]+", form):
        choices = "|".join(map(re.escape, word.strip("[](){}").split("|"))).replace("\\ ", " ")
        gap = gap and (" ?" if "/" in word + last else " ")
        if word[0] == "[":  # with the space before it, or the one behind it at the start
            out += f"(?:{gap}(?:{choices}))?" if gap else f"(?:(?:{choices}) )?"
        else:
            out += gap + (f"({choices})" if word[0] == "{" else f"(?:{choices})")
            gap = " "
        last = last + word if word[0] == "[" else word
    barred = "".join(f"(?<!{w} )" for w in before)
    return f"(?<![a-z0-9]){barred}{out}(?![a-z0-9])" + "".join(f"(?! {w})" for w in after)


def phrasing_needs(form: str) -> list[str]:
    """Runs of words that every text in a form of PHRASINGS holds."""
    return [run.strip() for run in re.split(r"\[[^]]*\]|\([^)]*\)|\{[^}]*\}", form) if run.strip()]


def canonical_phrasing(folded: Column) -> Column:
    """Text without marks with the phrases of PHRASINGS in their uniform writing; later ones see what earlier ones wrote."""
    for form, uniform, before, after in PHRASINGS:
        pattern, to = phrasing_pattern(form, before, after), re.sub(r"\{(\d)\}", r"$\1", uniform)
        folded = let(folded, lambda t: F.when(reduce(and_, map(t.contains, phrasing_needs(form))), F.regexp_replace(t, pattern, to)).otherwise(t))  # noqa: B023  called at once; the words are told sooner than the pattern
    return folded


def says(text: Column, *phrases: str) -> Column:
    """Whether a text holds one of the phrases as whole words."""
    whole = r"(?<![\p{L}\p{N}_])(" + "|".join(re.escape(p) for p in phrases) + r")(?![\p{L}\p{N}_])"
    return let(text, lambda t: reduce(or_, map(t.contains, phrases)) & t.rlike(whole))  # that none is there is told sooner than by the expression


def terms() -> list[tuple[str, str, str]]:
    """(kind, concept, phrase) of all metrics and ratios, ids with spaces included."""
    metrics = [("metric", m, p) for m, names in METRICS.items() for p in [m.lower().replace("_", " "), *names]]
    return metrics + [("ratio", r, p) for r, (names, _) in RATIOS.items() for p in names]
