"""Queries over questions: what they name, their gates and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query
from .functions import lexicon as X
from .functions import scalar as S
from .operators import planning as G
from .operators import understanding as U
from .sources.scratch import stored

#: How the questions of questions() begin, with the operation; their terms; how they end, with scope and scale.
BEGINNINGS = [("So sánh ", "COMPARE"), ("Trung bình ", "aggregate"), ("Tăng trưởng ", "growth"), ("Cho biết ", "NONE"), ("Top 5 ", "NONE")]
TERMS = [
    ("doanh thu thuần", "metric", "NET_REVENUE"), ("lãi gộp", "metric", "GROSS_PROFIT"), ("lợi nhuận kế toán trước thuế", "metric", "PROFIT_BEFORE_TAX"), ("quy mô tổng giá trị tài sản", "metric", "TOTAL_ASSETS"),
    ("vốn chủ", "metric", "EQUITY"), ("dòng tiền từ hoạt động kinh doanh", "metric", "CFO"), ("tỷ suất lợi nhuận trên vốn chủ sở hữu bình quân", "ratio", "ROE"), ("nợ phải trả trên vốn chủ", "ratio", "DEBT_TO_EQUITY"), ("biên lợi nhuận ròng", "ratio", "NET_MARGIN"),
]
SCOPES = [(" hợp nhất", "HOP_NHAT", "RESOLVED"), (" của công ty mẹ", "RIENG", "RESOLVED"), (" hợp nhất và riêng", None, "AMBIGUOUS"), ("", None, "UNRESOLVED")]
SCALES = [(", theo triệu đồng", "MILLION"), (", theo tỷ đồng", "BILLION"), ("", None), (", theo phần trăm", "PERCENT")]


def _pick(options: list[tuple], field: int, key: str):
    return F.element_at(F.array(*[F.lit(o[field]) for o in options]), F.pmod(F.col(key), F.lit(len(options))).cast("int") + 1)


def _sql_pick(options: list[tuple], field: int, key: str) -> str:
    told = ["NULL" if o[field] is None else f"'{o[field]}'" for o in options]
    return f"[{', '.join(told)}][1 + {key} % {len(options)}]"


def questions(t) -> DataFrame:
    """(question_id, question, year): one question an order, about its customer and its year or that and the one before, worded by the order's number."""
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    n = o.withColumn("e", F.pmod(F.floor(F.col("o_orderkey") / 720), F.lit(2))).withColumn("a", F.col("o_orderkey")).withColumn("b", F.floor(F.col("o_orderkey") / 5)).withColumn("c", F.floor(F.col("o_orderkey") / 45)).withColumn("d", F.floor(F.col("o_orderkey") / 180))
    year = F.year("o_orderdate")
    text = F.concat(_pick(BEGINNINGS, 0, "a"), _pick(TERMS, 0, "b"), F.lit(" của "), F.col("c_name"), F.lit(" năm "), F.when(F.col("e") == 1, F.concat((year - 1).cast("string"), F.lit(" đến "))).otherwise(""), year.cast("string"), _pick(SCOPES, 0, "c"), _pick(SCALES, 0, "d"), F.lit("?"))
    return n.select(F.col("o_orderkey").alias("question_id"), text.alias("question"), year.alias("year"), "o_custkey")


WORDED = "(SELECT o_orderkey AS question_id, o_custkey, CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS a, o_orderkey // 5 AS b, o_orderkey // 45 AS c, o_orderkey // 180 AS d, o_orderkey // 720 % 2 AS e FROM orders JOIN customer ON c_custkey = o_custkey)"


def companies(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("concept"), F.col("c_name").alias("phrase"))


@query(f"SELECT question_id, CAST(o_custkey AS VARCHAR) AS company, 'RESOLVED' AS status FROM {WORDED}")
def nlu_company(t):
    asked = questions(t).select("question_id", S.fold(F.col("question")).alias("folded"))
    names = companies(t).select(F.lit("company").alias("kind"), F.col("concept").cast("string").alias("concept"), S.fold(F.col("phrase")).alias("phrase"))
    found = U.resolution(U.mentions(asked, names, "question_id", "folded"), "company", "question_id")
    return found.select("question_id", F.array_join("concepts", " ").alias("company"), "status")


@query(f"SELECT question_id, CASE WHEN kind = 'metric' THEN term ELSE '' END AS metrics, CASE WHEN kind = 'ratio' THEN term ELSE '' END AS ratios FROM (SELECT question_id, {_sql_pick(TERMS, 1, 'b')} AS kind, {_sql_pick(TERMS, 2, 'b')} AS term FROM {WORDED})")
def nlu_metric(t):
    told = U.understand(questions(t), companies(t))
    return told.select("question_id", F.array_join("metrics", " ").alias("metrics"), F.array_join("ratios", " ").alias("ratios"))


@query(f"SELECT question_id, {_sql_pick(SCOPES, 1, 'c')} AS scope, {_sql_pick(SCOPES, 2, 'c')} AS status FROM {WORDED}")
def nlu_scope(t):
    value, status = U.scope(F.lower("question"))
    return questions(t).select("question_id", value.alias("scope"), status.alias("status"))


@query(f"""SELECT question_id, CASE WHEN told IN ('aggregate', 'growth') THEN told WHEN term = 'ROE' AND told = 'COMPARE' THEN 'UNKNOWN' WHEN term = 'ROE' THEN 'RATIO' ELSE told END AS operation,
  beginning = 'Top 5 ' AS ranking, CASE WHEN term <> 'ROE' THEN scale WHEN coalesce(scale, 'BILLION') = 'BILLION' THEN 'BILLION' END AS requested_scale
  FROM (SELECT question_id, {_sql_pick(BEGINNINGS, 0, 'a')} AS beginning, {_sql_pick(BEGINNINGS, 1, 'a')} AS told, {_sql_pick(TERMS, 2, 'b')} AS term, {_sql_pick(SCALES, 1, 'd')} AS scale FROM {WORDED})""")
def nlu_operation(t):
    return U.understand(questions(t), companies(t)).select("question_id", "operation", "ranking", "requested_scale")


RATIO_NEEDS = " ".join(f"WHEN '{r}' THEN '{' '.join(needed)}'" for r, (_, needed) in X.RATIOS.items())


@query(f"SELECT question_id, CAST(o_custkey AS VARCHAR) AS company, CASE term {RATIO_NEEDS} ELSE term END AS required_metrics, CASE WHEN e = 1 THEN (year - 1) || ' ' ELSE '' END || year AS years, scope, scope_status FROM (SELECT *, {_sql_pick(TERMS, 2, 'b')} AS term, {_sql_pick(SCOPES, 1, 'c')} AS scope, {_sql_pick(SCOPES, 2, 'c')} AS scope_status FROM {WORDED})")
def nlu_understand(t):
    told = U.understand(questions(t), companies(t))
    return told.select("question_id", F.array_join("companies", " ").alias("company"), F.array_join("required_metrics", " ").alias("required_metrics"), F.array_join(F.transform("years", lambda y: y.cast("string")), " ").alias("years"), "scope", "scope_status")


def _plain(c: str):
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))


@query("""
WITH RECURSIVE docs AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS text FROM documents),
items AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM benchmark),
lexicon AS (SELECT DISTINCT item_id, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM items, (VALUES (1, 2), (2, 3), (4, 2), (5, 1)) v(k, n) WHERE len(w) >= k + n - 1),
words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM docs WHERE text <> ''),
places AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1 AS first FROM words),
runs AS (SELECT doc_id, first, w || CASE WHEN n > 1 THEN ' ' || lead(w, 1) OVER o ELSE '' END || CASE WHEN n > 2 THEN ' ' || lead(w, 2) OVER o ELSE '' END AS phrase FROM places, (VALUES (1), (2), (3)) v(n) WINDOW o AS (PARTITION BY doc_id, n ORDER BY i)),
met AS (SELECT DISTINCT doc_id, CAST(first AS INT) AS a, CAST(first + length(phrase) AS INT) AS b, phrase FROM runs WHERE phrase IN (SELECT phrase FROM lexicon)),
turns AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b - a DESC, a) AS turn FROM met),
greedy(doc_id, turn, taken) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(a INT, b INT, phrase VARCHAR)[]) FROM turns
  UNION ALL SELECT g.doc_id, g.turn + 1, CASE WHEN len(list_filter(g.taken, lambda s: s.a < t.b AND t.a < s.b)) = 0 THEN list_append(g.taken, {'a': t.a, 'b': t.b, 'phrase': t.phrase}) ELSE g.taken END
  FROM greedy g JOIN turns t ON t.doc_id = g.doc_id AND t.turn = g.turn + 1),
done AS (SELECT doc_id, unnest(arg_max(taken, turn)) AS s FROM greedy GROUP BY doc_id)
SELECT doc_id, s.a AS first, s.b AS last, s.phrase AS phrase, CAST(item_id AS VARCHAR) AS concept FROM done JOIN lexicon ON lexicon.phrase = s.phrase""")
def nlu_mentions(t):
    words = F.split(_plain("text"), " ")
    phrases = F.array(*[F.when(F.size(words) >= k + n - 1, F.array_join(F.slice(words, k, n), " ")) for k, n in ((1, 2), (2, 3), (4, 2), (5, 1))])
    lexicon = t("benchmark").select(F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("concept"), F.explode(phrases).alias("phrase"))
    return U.mentions(t("documents").select("doc_id", _plain("text").alias("plain")), lexicon, "doc_id", "plain").select("doc_id", "first", "last", "phrase", "concept")


VARIANTS = [
    ("lai truoc thue", "loi nhuan truoc thue"), ("loi nhuan ke toan sau thue", "loi nhuan sau thue"), ("loi nhuan rong", "loi nhuan sau thue"), ("bien loi nhuan rong", "bien loi nhuan rong"), ("bien lai gop", "bien loi nhuan gop"),
    ("tong gia tri tai san", "tong tai san"), ("von chu so huu", "von chu so huu"), ("von chu", "von chu so huu"), ("luu chuyen tien thuan tu hoat dong dau tu", "luu chuyen tien thuan tu hoat dong dau tu"), ("dong tien hoat dong tai chinh", "luu chuyen tien thuan tu hoat dong tai chinh"),
    ("kha nang thanh toan ngan han", "he so thanh toan hien hanh"), ("ty le no/von chu", "no tren von chu so huu"), ("no phai tra tren tong von chu so huu", "no tren von chu so huu"), ("sinh loi tren tong tai san", "ty suat loi nhuan tren tong tai san"), ("thu nhap lai thuan", "thu nhap lai thuan"), ("lai vay", "lai vay"),
]


@query(f"SELECT c_custkey, {_sql_pick(VARIANTS, 1, 'c_custkey')} || ' cua ' || lower(c_name) AS phrasing FROM customer")
def str_canonical_phrasing(t):
    text = F.concat(_pick(VARIANTS, 0, "c_custkey"), F.lit(" cua "), F.col("c_name"))
    return t("customer").select("c_custkey", X.canonical_phrasing(F.lower(text)).alias("phrasing"))


TOLD = f"""(SELECT *, CASE WHEN told IN ('aggregate', 'growth') THEN upper(told) WHEN term = 'ROE' AND told = 'COMPARE' THEN 'UNKNOWN' WHEN kind = 'ratio' AND told = 'NONE' THEN 'RATIO' ELSE told END AS operation
  FROM (SELECT *, {_sql_pick(BEGINNINGS, 1, 'a')} AS told, {_sql_pick(TERMS, 1, 'b')} AS kind, {_sql_pick(TERMS, 2, 'b')} AS term, {_sql_pick(SCOPES, 1, 'c')} AS scope FROM {WORDED}))"""
PLANS = f"""(SELECT *, CASE WHEN operation = 'UNKNOWN' THEN 'UNKNOWN_OPERATION' WHEN scope IS NULL THEN 'MISSING_STATEMENT_SCOPE' WHEN kind = 'ratio' AND operation IN ('GROWTH', 'AGGREGATE') THEN 'UNSUPPORTED_RATIO'
  WHEN e = 0 AND operation IN ('GROWTH', 'AGGREGATE', 'COMPARE') OR e = 1 AND operation = 'RATIO' THEN 'INVALID_PERIOD_REQUIREMENT' END AS reason FROM {TOLD})"""


def plans(t) -> DataFrame:
    return stored(G.plan(U.understand(questions(t), companies(t))), "plans")


@query(f"""SELECT question_id, reason AS abstain_reason, CASE WHEN reason IS NULL THEN CASE operation WHEN 'NONE' THEN 'LOOKUP' WHEN 'RATIO' THEN 'DERIVED_RATIO' WHEN 'AGGREGATE' THEN 'AGGREGATE' ELSE 'MULTI_PERIOD' END END AS question_type,
  CASE WHEN reason IS NULL THEN CASE WHEN operation = 'GROWTH' THEN 'GROWTH_RATE' WHEN operation = 'AGGREGATE' THEN 'AVERAGE' WHEN kind = 'ratio' THEN term END END AS formula_id,
  CASE WHEN reason IS NULL THEN CASE WHEN operation = 'NONE' AND e = 0 THEN 'LIGHT' ELSE 'FULL' END END AS verify_profile FROM {PLANS}""")
def sup_plan(t):
    ok = F.col("abstain_reason").isNull()
    return plans(t).select("question_id", "abstain_reason", *[F.when(ok, F.col(c)).alias(c) for c in ("question_type", "formula_id", "verify_profile")])


NEEDS = {"ROE": ("LNST", "EQUITY"), "DEBT_TO_EQUITY": ("LIABILITIES", "EQUITY"), "NET_MARGIN": ("LNST", "NET_REVENUE")}
PART = " ".join(f"WHEN '{r}' THEN '{n}'" for r, (n, _) in NEEDS.items()), " ".join(f"WHEN '{r}' THEN '{d}'" for r, (_, d) in NEEDS.items())


@query(f"""WITH p AS (SELECT *, CASE term {PART[0]} END AS num, CASE term {PART[1]} END AS den, CASE WHEN e = 1 THEN [year - 1, year] ELSE [year] END AS periods FROM {PLANS} WHERE reason IS NULL),
s AS (SELECT question_id, CASE WHEN kind = 'ratio' THEN list_transform(periods, lambda y: {{'op': 'FORMULA ' || term, 'inputs': num || '@' || y || ' ' || den || '@' || y || CASE WHEN term = 'ROE' THEN ' ' || den || '@' || (y - 1) ELSE '' END}})
  WHEN operation IN ('GROWTH', 'AGGREGATE') THEN [{{'op': CASE operation WHEN 'GROWTH' THEN 'FORMULA GROWTH_RATE' ELSE 'FORMULA AVERAGE' END, 'inputs': array_to_string(list_transform(periods, lambda y: term || '@' || y), ' ')}}]
  ELSE list_transform(periods, lambda y: {{'op': 'IDENTITY', 'inputs': term || '@' || y}}) END AS steps FROM p),
e AS (SELECT question_id, CASE WHEN len(steps) > 1 THEN list_append(steps, {{'op': 'COLLECT', 'inputs': array_to_string(list_transform(range(1, len(steps) + 1), lambda i: '#' || i), ' ')}}) ELSE steps END AS steps FROM s)
SELECT question_id, CAST(unnest(range(1, len(steps) + 1)) AS INT) AS step, unnest(steps).op AS op, unnest(steps).inputs AS inputs FROM e""")
def prg_generate(t):
    return G.programs(plans(t)).select("question_id", "step", "op", F.array_join("inputs", " ").alias("inputs"))


#: Factors of the metrics of metric_facts() over a customer's yearly sum of orders.
FACTORS = {"NET_REVENUE": 8, "GROSS_PROFIT": 3, "PROFIT_BEFORE_TAX": 2, "TOTAL_ASSETS": 9, "EQUITY": 5, "CFO": -1, "LNST": 1, "LIABILITIES": 4}


def metric_facts(t) -> DataFrame:
    """Facts of each customer, year and scope: every metric a multiple of the year's orders; the first year of a customer has no EQUITY."""
    total = t("orders").groupBy(F.col("o_custkey").cast("string").alias("company"), F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    made = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(f).alias("factor")) for m, f in FACTORS.items()])
    scopes = F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(n).alias("times")) for s, n in (("HOP_NHAT", 2), ("RIENG", 1))])
    rows = total.select("company", "year", "total", F.explode(made).alias("m"), F.lit(0).alias("x")).select("*", F.explode(scopes).alias("s")).filter("NOT (m.metric = 'EQUITY' AND year % 5 = 0)")
    value = (F.col("total") * F.col("m.factor") * F.col("s.times")).cast("double")
    return rows.select(F.concat_ws(":", "company", "year", "s.scope", "m.metric").alias("fact_id"), "company", "s.scope", "m.metric", "year", value.alias("value"), F.lit("VND").alias("unit"))


@query(f"""WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year FROM orders GROUP BY 1, 2),
p AS (SELECT *, e = 1 OR term = 'ROE' AS before FROM {PLANS} WHERE reason IS NULL AND (e = 0 OR operation IN ('GROWTH', 'AGGREGATE'))),
m AS (SELECT *, (before AND NOT EXISTS (SELECT 1 FROM y WHERE y.o_custkey = p.o_custkey AND y.year = p.year - 1))
  OR (term IN ('EQUITY', 'ROE', 'DEBT_TO_EQUITY') AND (year % 5 = 0 OR before AND (year - 1) % 5 = 0)) AS missing FROM p)
SELECT question_id, failed = '' AS passed, failed FROM (SELECT question_id, CASE WHEN missing THEN 'REFERENCE_INPUT_UNAVAILABLE' ELSE CASE question_id % 6 WHEN 1 THEN 'FORMULA_RESULT' WHEN 2 THEN 'SOURCE_ROWS' WHEN 3 THEN 'RESULT_UNIT' WHEN 4 THEN 'FORMULA_PROGRAM' ELSE '' END END AS failed FROM m)""")
def ver_t2p(t):
    """Answers of executed programs, some spoilt by the question's number, verified by results computed anew."""
    made = plans(t)
    steps = G.programs(made)
    facts = stored(G.facts_named(metric_facts(t), made, steps), "facts")
    only = steps.groupBy("question_id").agg(F.max("step").alias("last")).filter("last = 1").select("question_id")
    ran = G.executed(steps.join(only, "question_id", "left_semi"), made, facts)
    cited = G.requirements(made).join(facts, ["company", "scope", "metric", "year"]).groupBy("question_id").agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"))
    kind = made.select("question_id", F.when((F.col("operation") == "GROWTH") | F.col("ratio").isin(*G.IN_PERCENT), "PERCENT").when(F.col("ratio").isNotNull(), "TIMES").otherwise("VND").alias("unit"))
    turn = F.pmod("question_id", F.lit(6))
    answers = ran.join(cited, "question_id", "left").join(kind, "question_id").select(
        "question_id", F.when(turn == 1, F.col("value") * 1.01).otherwise(F.col("value")).alias("value"), F.when(turn == 3, "USD").otherwise(F.col("unit")).alias("unit"),
        F.when(turn == 2, F.slice("fact_ids", F.lit(2), F.size("fact_ids"))).otherwise(F.col("fact_ids")).alias("fact_ids"), F.when(turn == 4, F.col("value")).otherwise(F.col("probe")).alias("probe"),
    )
    checked = G.verified(answers, made, facts)
    return checked.select("question_id", "passed", F.array_join("failed", " ").alias("failed"))
