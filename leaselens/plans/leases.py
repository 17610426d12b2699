"""Queries over Korean contracts, boxes and answers that are made of the keys of orders, with the SQL that gives the same rows.

The driver's tables hold no Hangul. A generator is one SQL text that both engines run; the results come from
the operators here, and in SQL from the keys by arithmetic or by a recursion of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, similarity
from ..functions import text as tx
from ..operators import clauses, documents, fields, jobs, layout, rules, search
from ..schemas import OCR_PAGES, PARSE_ELEMENTS
from .tables import _read

_SEVEN = "(VALUES (1), (2), (3), (4), (5), (6), (7)) s(p)"
_PARTS = "보증금을 받는다. ;반환한다. ;언제든지 해지 ;위약금 ;전액 ;확정일자 ;수선 ;중도 해지 ;갱신 ;10% ;증액 ;권리를 포기 ;1년 ;기간 ".split(";")
_N = "CAST(o_orderkey % 97 AS STRING)"
_CIRCLE = "substr('①②③④⑤⑥⑦⑧⑨⑩', CAST(1 + o_custkey % 10 AS INT), 1)"
_DIGIT = "substr('일이삼사오육칠팔구', CAST(1 + o_orderkey % 9 AS INT), 1)"
_KIND = "(p * 5 + o_orderkey) % 7"
_PAD = "lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')"
_YEAR, _MONTH, _DAY = "CAST(2000 + o_orderkey % 30 AS STRING)", "CAST(1 + o_orderkey % 12 AS STRING)", "CAST(1 + o_orderkey % 28 AS STRING)"
#: Generators by name.
MADE = {
    "contracts": "SELECT o_orderkey AS contract_id, " + " || ".join(f"CASE WHEN CAST(floor((o_orderkey * 7919 + o_custkey) % 16384 / {1 << i}) AS BIGINT) % 2 = 1 THEN '{w}' ELSE '' END" for i, w in enumerate(_PARTS)) + " AS text FROM orders",
    "clause_lines": f"""SELECT o_orderkey AS doc_id, p AS pos, CASE {_KIND} WHEN 0 THEN '제' || {_N} || '조 (제목 ' || {_N} || ') 내용 ' || p WHEN 1 THEN {_CIRCLE} || ' 단락 ' || p WHEN 2 THEN {_CIRCLE} || '단락' || p
        WHEN 3 THEN {_N} || '. 본문 ' || p WHEN 4 THEN {_N} || '호 세목 ' || p WHEN 5 THEN '이어지는 줄' ELSE {_N} || '항 본문' END AS line FROM orders, {_SEVEN}""",
    "lease_regions": f"""SELECT o_orderkey AS doc_id, p AS pos, p * 30 AS y, 5 AS x, CASE p WHEN 1 THEN '임대인 홍길동 010-' || {_PAD} || '-5678' WHEN 2 THEN '입차인 김철수 02-123-' || {_PAD}
        WHEN 3 THEN '보증굼 ' || CAST(1 + o_orderkey % 9 AS STRING) || ',000,000원' WHEN 4 THEN '월세 ' || CAST(100 + o_orderkey % 900 AS STRING) || ',000원' WHEN 5 THEN {_YEAR} || '년 ' || {_MONTH} || '월 ' || {_DAY} || '일부터'
        WHEN 6 THEN {_YEAR} || '.' || {_MONTH} || '.' || {_DAY} || '까지' ELSE CASE o_orderkey % 3 WHEN 0 THEN '소재지 서울 ' || CAST(o_orderkey % 100 AS STRING) WHEN 1 THEN '전용면적 ' || CAST(20 + o_orderkey % 60 AS STRING) || '.5㎡' ELSE '특약사항: 금지' END END AS text FROM orders, {_SEVEN}""",
    "boxes": f"""SELECT o_orderkey AS doc_id, p AS pos, CASE p % 3 WHEN 0 THEN 'trocr' WHEN 1 THEN 'paddle' ELSE 'easy' END AS engine, substr('가나다', CAST(1 + (o_custkey + p * p) % 3 AS INT), 1) AS text,
        CAST((50 + (o_custkey * p) % 50) / 100.0 AS DOUBLE) AS confidence, CAST((o_orderkey * p) % 5 * 3 AS INT) AS x, CAST((o_custkey + p) % 2 * 40 AS INT) AS y, 10 AS w, 10 AS h FROM orders, {_SEVEN}""",
    "cells": f"SELECT o_orderkey AS doc_id, p AS pos, CAST(o_custkey * p % 60 AS INT) AS x, CAST(o_orderkey * p % 45 AS INT) AS y, CAST(10 + o_custkey * p % 120 AS INT) AS w, CAST(5 + o_orderkey * p % 90 AS INT) AS h FROM orders, {_SEVEN}",
    "values": f"""SELECT o_orderkey AS id, o_orderkey % 6 AS form, CASE o_orderkey % 6 WHEN 0 THEN CAST(1 + o_custkey % 999 AS STRING) || ',' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '원'
        WHEN 1 THEN CAST(1 + o_custkey % 90 AS STRING) || '만원' WHEN 2 THEN '일금 ' || {_DIGIT} || '천만원정' WHEN 3 THEN {_DIGIT} || '억' || {_DIGIT} || '천만' WHEN 4 THEN CAST(o_orderkey AS STRING) || '000원' ELSE '없음' END AS v FROM orders""",
    "facts": f"""SELECT o_orderkey AS id, o_orderkey % 5 AS form, CASE o_orderkey % 5 WHEN 0 THEN '연락처 010 ' || {_PAD} || '.1234' WHEN 1 THEN {_YEAR} || '년 ' || {_MONTH} || '월 ' || {_DAY} || '일 시작' WHEN 2 THEN {_YEAR} || '/' || {_MONTH} || '/' || {_DAY} || ' 종료'
        WHEN 3 THEN CAST(10 + o_orderkey % 90 AS STRING) || '.5 평' ELSE '900101 - 1' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') END AS v FROM orders""",
    "typos": "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '보증금' WHEN 1 THEN '면적' WHEN 2 THEN '주소' ELSE '기타' END AS field, CASE o_orderkey % 5 WHEN 0 THEN '보즈금 게약금 ' WHEN 1 THEN '84.5㎡ 건믈 ' WHEN 2 THEN '서울시 강남구 테헤란로 ' WHEN 3 THEN '암대인 월쎄 ' ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN '1O,000원 lI' ELSE CAST(o_custkey AS STRING) END AS value FROM orders",
    "answers": """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 3 THEN 'no JSON' ELSE CASE WHEN o_orderkey % 4 = 1 THEN '```json' || chr(10) ELSE '' END || '{"lessor": {"name": "' || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'a' END || '"}, "lessee": {"name": "b"}, "terms": {"deposit": "' || CAST(o_custkey AS STRING)
        || CASE WHEN o_custkey % 5 = 0 THEN '억' ELSE ',000원' END || '", "balance": "' || CAST(o_custkey + o_orderkey % 2 AS STRING) || '000", "contract_start_date": "2024-0' || CAST(1 + o_orderkey % 9 AS STRING) || '-01", "contract_end_date": "2024-0' || CAST(1 + o_custkey % 9 AS STRING) || '-01"}}'
        || CASE WHEN o_orderkey % 4 = 1 THEN chr(10) || '```' ELSE '' END END AS answer FROM orders""",
    "cited": "SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 10 = 9 THEN '답변할 수 없습니다' ELSE '제' || CAST(1 + o_orderkey % 30 AS STRING) || '조와 제' || CAST(1 + o_custkey % 40 AS STRING) || '조에 따른다' END AS text FROM orders",
}


def made(spark: SparkSession, d: str, name: str) -> DataFrame:
    text = MADE[name].replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}")
    return spark.sql(text, orders=_read(spark, d, "orders"))


def contract_rules(spark: SparkSession, d: str) -> DataFrame:
    x = rules.rule_counts(made(spark, d, "contracts"))
    return x.select("contract_id", *(F.array_join(k, ",").alias(k) for k in ("fraud", "missing", "illegal")), "api_score", "worker_score")


def contract_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.scores_of(rules.findings(made(spark, d, "contracts")))


def danger_scores(spark: SparkSession, d: str) -> DataFrame:
    x = made(spark, d, "contracts")
    return x.select("contract_id", rules.danger_score(F.col("text")).cast("bigint").alias("danger"), rules.domain(F.col("text")).alias("domain"))


def clause_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    x = clauses.clauses(made(spark, d, "clause_lines"))
    return x.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("level").cast("bigint").alias("level"), "article_no", "paragraph_no", "number", "title", "content")


def field_extraction(spark: SparkSession, d: str) -> DataFrame:
    x = fields.extract_fields(made(spark, d, "lease_regions"))
    return x.withColumn("special_terms", F.array_join("special_terms", "|"))


def extraction_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Leases from stored answers, and from rules where an answer is void."""
    x = documents.leases_or_rules(made(spark, d, "lease_regions"), made(spark, d, "answers"))
    return x.select("doc_id", "origin", F.col("lease.lessor.phone").alias("lessor_phone"), F.col("lease.terms.deposit").alias("deposit"), F.col("lease.terms.monthly_rent").alias("rent"))


def lease_validation(spark: SparkSession, d: str) -> DataFrame:
    x = made(spark, d, "answers").select("doc_id", fields.parse_lease(F.col("answer")).alias("lease")).withColumn("v", fields.validate_lease(F.col("lease")))
    return x.select("doc_id", F.col("lease.terms.deposit").alias("deposit"), F.col("v.is_valid").alias("is_valid"), F.array_join("v.errors", ",").alias("errors"), F.array_join("v.warnings", ",").alias("warnings"))


def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return fields.missing_paths(made(spark, d, "answers").select("doc_id", fields.parse_lease(F.col("answer")).alias("lease")))


def korean_views(spark: SparkSession, d: str) -> DataFrame:
    """Both projections under Korean names, as JSON; the second has an empty object for a missing party."""
    lease = fields.parse_lease(F.col("answer"))
    x = made(spark, d, "answers").select("doc_id", fields.korean_view(lease, F.lit(0.8765), F.lit("ocr")).alias("v"))
    return x.select("doc_id", F.col("v.당사자.임대인.성명").alias("lessor"), F.col("v.금액.보증금").alias("deposit"), F.col("v.금액.월세").alias("rent"), F.col("v.메타.신뢰도").alias("confidence"))


def overlay_responses(spark: SparkSession, d: str) -> DataFrame:
    words = F.when(F.col("o_orderkey") % 3 > 0, F.array(F.struct(F.col("o_orderstatus").alias("text"), F.lit(1).alias("px_x"), F.lit(1).alias("px_y"), F.lit(1).alias("px_width"), F.lit(1).alias("px_height"))))
    x = _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(True).alias("success"), F.col("o_orderpriority").alias("full_text"), words.alias("words"), F.lit("{}").alias("contract_data"), F.lit("{}").alias("validation"))
    return fields.overlay_response(x).select("doc_id", "full_text", F.to_json("words").alias("words"))


def money(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return made(spark, d, "values").select("id", tx.extract_money(v).alias("money"), tx.parse_money(v).alias("parsed"), tx.money_from_text(v).alias("from_text_a"), tx.money_from_text(v, None).alias("from_text_b"))


def korean_number(spark: SparkSession, d: str) -> DataFrame:
    return made(spark, d, "values").where("form in (3, 5)").select("id", tx.korean_number(F.col("v")).alias("n"), F.coalesce(tx.korean_number(F.col("v")), F.lit(0)).alias("n_or_0"))


def dto_money(spark: SparkSession, d: str) -> DataFrame:
    return made(spark, d, "values").select("id", tx.dto_money(F.col("v")).alias("n"))


def phones_dates_areas(spark: SparkSession, d: str) -> DataFrame:
    v, area = F.col("v"), tx.extract_area(F.col("v"))
    x = made(spark, d, "facts").select("id", tx.extract_phone(v).alias("phone"), tx.extract_date(v).alias("date"), tx.date_role(v).alias("role"), area.alias("a"), tx.extract_resident_id(v).alias("resident_id"), F.coalesce(tx.resident_id_ok(v), F.lit(False)).alias("resident_ok"))
    return x.select("id", "phone", tx.format_phone_a(F.col("phone")).alias("phone_a"), tx.format_phone_b(F.col("phone")).alias("phone_b"), "date", "role", F.col("a.value").alias("area"), F.col("a.unit").alias("unit"), "resident_id", "resident_ok")


def typo_correction(spark: SparkSession, d: str) -> DataFrame:
    x = fields.postprocess(made(spark, d, "typos"))
    return x.select("id", "corrected", F.size("corrections").cast("bigint").alias("corrections"), "confidence", "valid")


def contract_types(spark: SparkSession, d: str) -> DataFrame:
    x = made(spark, d, "lease_regions")
    return fields.contract_types(x.withColumn("text", F.when(F.col("doc_id") % 4 == F.col("pos"), F.concat(F.lit("상가 "), "text")).when(F.col("doc_id") % 9 == F.col("pos"), "매매").otherwise(F.col("text"))))


def field_types(spark: SparkSession, d: str) -> DataFrame:
    x = made(spark, d, "lease_regions").select(F.coalesce(fields.field_type(F.col("text")), F.lit("none")).alias("field_type"))
    return x.groupBy("field_type").agg(F.count("*").alias("regions"))


def nms(spark: SparkSession, d: str) -> DataFrame:
    return layout.without_overlaps(made(spark, d, "boxes")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "text", "confidence")


def merged_nms(spark: SparkSession, d: str) -> DataFrame:
    """Full pages and enlarged ones, put back to scale, in one list without overlaps."""
    boxes = made(spark, d, "boxes")
    large = boxes.where("pos > 4").withColumns({c: F.col(c) * 2 for c in ("x", "y", "w", "h")})
    return documents.multi_scale(boxes.where("pos <= 4"), {2.0: large}).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "text", "confidence")


def voting(spark: SparkSession, d: str) -> DataFrame:
    x = layout.votes(made(spark, d, "boxes"), ("majority", "confidence_weighted", "trocr_priority"))
    return x.select("doc_id", "strategy", F.col("leader").cast("bigint").alias("leader"), "text", "confidence")


def engine_reports(spark: SparkSession, d: str) -> DataFrame:
    boxes = made(spark, d, "boxes")
    by = {e: boxes.where(F.col("engine") == e).drop("engine") for e in ("paddle", "easy", "trocr")}
    x = layout.engine_report(layout.tagged(**by).drop("engine_no"))
    return x.select("engine", "boxes", F.round("confidence", 9).alias("confidence"))


def region_texts(spark: SparkSession, d: str) -> DataFrame:
    return layout.region_text(layout.confident(made(spark, d, "boxes"), 0.6)).select("doc_id", "text", F.round("confidence", 9).alias("confidence"))


def region_views(spark: SparkSession, d: str) -> DataFrame:
    x = made(spark, d, "boxes").withColumn("confidence", F.col("confidence") / 7)
    return fields.region_view(x).where("pos = 3").select("doc_id", "text", "confidence")


def row_cluster(spark: SparkSession, d: str) -> DataFrame:
    x = layout.grid(made(spark, d, "cells"))
    return x.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("row_no").cast("bigint").alias("row_no"), F.col("col_no").cast("bigint").alias("col_no"))


def table_cells(spark: SparkSession, d: str) -> DataFrame:
    x = layout.cell_sized(made(spark, d, "cells"), F.lit(110), F.lit(80))
    corner = geometry.corners(F.struct(*layout.BOX))
    pct = geometry.box_percent(F.struct(*layout.BOX), F.lit(200), F.lit(160))
    return x.select("doc_id", F.col("pos").cast("bigint").alias("pos"), corner["x2"].cast("bigint").alias("x2"), corner["y2"].cast("bigint").alias("y2"), F.round(pct["x"], 6).alias("px"), F.round(pct["h"], 6).alias("ph"))


def line_assembly(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines(made(spark, d, "boxes").withColumn("y", F.col("y") + F.col("pos") * 3))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """The regions of each page in reading order: the global order's ranks in a page."""
    x = layout.reading_order(made(spark, d, "boxes"))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "pos"))), lambda v: v["pos"].cast("string")), ",").alias("order"))


def _quad(x0: str, y0: str, x1: str, y1: str):
    point = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def ocr_words(spark: SparkSession, d: str) -> DataFrame:
    word = lambda text, v, c: F.struct(F.expr(text).alias("text"), F.expr(c).cast("double").alias("confidence"), F.struct(v.alias("vertices")).alias("boundingBox"))
    v = _quad("o_orderkey % 100", "o_custkey % 50", "o_orderkey % 100 + 30", "o_custkey % 50 + 15")
    page = F.struct(F.lit(300).alias("width"), F.lit(200).alias("height"), F.array(word("concat(' ', o_orderstatus, ' ')", v, "o_custkey % 10 / 10"), word("''", v, "0.5"), word("'끝'", F.slice(v, 1, 3), "null")).alias("words"))
    x = _read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.array(page).alias("pages"))
    x = layout.ocr_words(x.to(spark.createDataFrame([], OCR_PAGES).schema))
    return x.select("doc_id", "text", "confidence", "x", "y", "width", "height", F.col("px_x").cast("bigint").alias("px_x"), F.col("px_height").cast("bigint").alias("px_height"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    q = _quad("o_orderkey % 50 / 100", "0.25", "o_orderkey % 50 / 100 + 0.5", "0.5")
    text = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END")
    e = F.struct(F.lit("table").alias("category"), F.struct(text.alias("text"), F.lit("| a | bb |\n|----|----|\n<b>c</b>").alias("markdown"), F.lit("").alias("html")).alias("content"), q.alias("coordinates"))
    x = _read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.array(e).alias("elements"))
    return x.to(spark.createDataFrame([], PARSE_ELEMENTS).schema)


def element_words(spark: SparkSession, d: str) -> DataFrame:
    x = layout.element_words(_elements(spark, d).where("doc_id % 2 = 0"))
    return x.select("doc_id", "text", "x", "y", "width", "height")


def element_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.element_blocks(_elements(spark, d)).select("doc_id", "category", "text", "x", "y", "width", "height")


def quad_percent(spark: SparkSession, d: str) -> DataFrame:
    """A quadrilateral in its three forms: points, pairs, box."""
    a, b = "o_orderkey % 50 / 100", "o_custkey % 50 / 100"
    points = _quad(a, b, f"{a} + 0.25", f"{b} + 0.125")
    pairs = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    box = F.struct(F.expr(a).alias("x"), F.expr(b).alias("y"), F.lit(0.25).alias("width"), F.lit(0.125).alias("height"))
    forms = F.when(F.col("o_orderkey") % 3 == 0, geometry.quad_percent(points)).when(F.col("o_orderkey") % 3 == 1, geometry.pairs_percent(pairs)).otherwise(geometry.unit_box_percent(box))
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), forms.alias("q")).select("id", *(F.round(f"q.{c}", 6).alias(c) for c in "xywh"))


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    """A text against itself with a tail that it doesn't share a character with."""
    text = F.concat(F.lit("임대 차"), F.repeat(F.lit("가나"), (F.col("o_orderkey") % 20).cast("int")))
    tail = F.repeat(F.lit("x"), (F.col("o_custkey") % 9).cast("int"))
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), similarity.character_accuracy(text, F.concat(text, F.lit("\n"), tail)).alias("accuracy"))


def verified_citations(spark: SparkSession, d: str) -> DataFrame:
    sources = _read(spark, d, "nation").select(F.concat(F.lit("제"), F.col("n_nationkey").cast("string"), F.lit("조 차임")).alias("text"))
    return search.citations(made(spark, d, "cited"), sources)


def annotated_answers(spark: SparkSession, d: str) -> DataFrame:
    sources = _read(spark, d, "nation").select(F.concat(F.lit("제"), F.col("n_nationkey").cast("string"), F.lit("조 차임")).alias("text"))
    return search.annotated(made(spark, d, "cited"), sources).select("answer_id", "text")


def answer_measures(spark: SparkSession, d: str) -> DataFrame:
    sources = _read(spark, d, "nation").select(F.concat(F.lit("제"), F.col("n_nationkey").cast("string"), F.lit("조 차임")).alias("text"))
    return search.answer_measures(made(spark, d, "cited"), sources)


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as candidates of a question; words in common stand in for a cross-encoder."""
    x = _read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.lit("urgent high order").alias("query"), F.lower("o_orderpriority").alias("text"), F.lit("residential").alias("domain"))
    return search.reranked(x, search.word_overlap(), 2).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


def fact_checks(spark: SparkSession, d: str) -> DataFrame:
    """What speech says of a deposit against the contract's."""
    x = _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("보증금은 "), (F.col("o_custkey") % 3 + 1).cast("string"), F.lit(",000원입니다")).alias("said"), ((F.col("o_orderkey") % 3 + 1) * 1000).alias("deposit"))
    return documents.money_claims(x, "said", "deposit").groupBy("verdict").agg(F.count("*").alias("n"))


def term_lookup(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([("F", "done", "filled", ["f1", "f2"]), ("O", "open", "waits", ["o"])], "term string, simple_explanation string, legal_definition string, examples array<string>")
    x = rules.explain_terms(_read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("term")), terms)
    return x.select("o_orderkey", "term", "simple_explanation", "legal_definition", F.array_join("examples", "|").alias("examples"))


def status_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("result"))
    return jobs.lookup(c, c.where("job_id % 3 = 0").withColumn("status", F.lit("CACHED")), c.where("job_id % 2 = 0"))


def reasoning(spark: SparkSession, d: str) -> DataFrame:
    steps = F.slice(F.array("o_orderstatus", "o_orderpriority", F.lit("third")), F.lit(1), (F.col("o_orderkey") % 4).cast("int"))
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rules.reasoning_summary(steps).alias("summary"))


QUERIES = {f.__name__: f for f in (contract_rules, contract_findings, danger_scores, clause_hierarchy, field_extraction, extraction_with_fallback, lease_validation, missing_fields, korean_views, overlay_responses, money, korean_number, dto_money, phones_dates_areas, typo_correction, contract_types, field_types, nms, merged_nms, voting, engine_reports, region_texts, region_views, row_cluster, table_cells, line_assembly, reading_order, ocr_words, element_words, element_blocks, quad_percent, accuracy, verified_citations, annotated_answers, answer_measures, reranked, fact_checks, term_lookup, status_lookup, reasoning)}


def _holds(rule: rules.Rule) -> str:
    some = ["(" + " OR ".join(f"contains(text, '{w}')" for w in g) + ")" for g in rule.groups]
    return "(" + " AND ".join(some + [f"NOT contains(text, '{w}')" for w in rule.without]) + ")"


_RULES = rules.KOREAN_RULES
_POINTS = {kind: " + ".join(f"CASE WHEN {_holds(r)} THEN {p(r)} ELSE 0 END" for r in _RULES) for kind, p in (("api", lambda r: rules.API_POINTS[r.kind]), ("worker", lambda r: rules.worker_points(r.kind, r.weight_class)))}
_NAMES = ", ".join("concat_ws(',', " + ", ".join(f"CASE WHEN {_holds(r)} THEN '{r.name}' END" for r in _RULES if r.kind == k) + f") AS {k}" for k in rules.API_POINTS)
_SCORES = f"CAST(least({_POINTS['api']}, 100) AS DOUBLE) AS api_score, CAST(least({_POINTS['worker']}, 100) AS DOUBLE) AS worker_score"
_TYPOS = "value"
for _wrong, _right in tx.TYPOS_A:
    _TYPOS = f"replace({_TYPOS}, '{_wrong}', '{_right}')"
_AMOUNT = "[0-9]{1,3}(,[0-9]{3})*[ ]*[만천]?원"
_IOU = "CASE WHEN abs(b.x - o.x) >= 10 OR b.y <> o.y THEN 0 ELSE (10 - abs(b.x - o.x)) / (10.0 + abs(b.x - o.x)) END"
_ANSWER = """b AS (SELECT *, CASE WHEN answer = 'no JSON' THEN '{"terms": {"deposit": "억"}}' ELSE regexp_replace(answer, '(?s)```json\n(.*?)\n```', '\\1') END AS j FROM a), t AS (SELECT doc_id, json_extract_string(j, '$.terms.deposit') NOT LIKE '%억' AS good, j FROM b),
  l AS (SELECT doc_id, good, CASE WHEN good THEN json_extract_string(j, '$.lessor.name') ELSE '' END AS lessor, CASE WHEN good THEN 'b' ELSE '' END AS lessee, CASE WHEN good THEN CAST(replace(replace(json_extract_string(j, '$.terms.deposit'), ',', ''), '원', '') AS BIGINT) ELSE 0 END AS deposit,
    CASE WHEN good THEN CAST(json_extract_string(j, '$.terms.balance') AS BIGINT) ELSE 0 END AS balance, CASE WHEN good THEN json_extract_string(j, '$.terms.contract_start_date') > json_extract_string(j, '$.terms.contract_end_date') ELSE false END AS late FROM t)"""


def _kept(order: str, boxes: str = MADE["boxes"]) -> str:
    """A recursion over the boxes of a document in an order: kept are those that overlap no kept one."""
    return f"""WITH RECURSIVE g AS ({boxes}), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS r FROM g),
  n(doc_id, r, kept) AS (SELECT DISTINCT doc_id, 0::BIGINT, []::STRUCT(pos BIGINT, x BIGINT, y BIGINT)[] FROM o UNION ALL
    SELECT o.doc_id, o.r, CASE WHEN len(list_filter(n.kept, lambda b: {_IOU} > 0.5)) > 0 THEN n.kept ELSE list_append(n.kept, {{'pos': o.pos, 'x': o.x, 'y': o.y}}) END FROM n JOIN o ON o.doc_id = n.doc_id AND o.r = n.r + 1),
  k AS (SELECT doc_id, arg_max(kept, r) AS kept FROM n GROUP BY doc_id)"""


def _cluster(c: str) -> str:
    return f"""v{c} AS (SELECT doc_id, {c} AS v, row_number() OVER (PARTITION BY doc_id ORDER BY {c}) AS r FROM (SELECT DISTINCT doc_id, {c} FROM g)),
  n{c}(doc_id, r, v, anchor, no) AS (SELECT doc_id, r, v, v, 0::BIGINT FROM v{c} WHERE r = 1 UNION ALL
    SELECT a.doc_id, a.r, a.v, CASE WHEN a.v - b.anchor >= 10 THEN a.v ELSE b.anchor END, CASE WHEN a.v - b.anchor >= 10 THEN b.no + 1 ELSE b.no END FROM n{c} b JOIN v{c} a ON a.doc_id = b.doc_id AND a.r = b.r + 1)"""


_PHONE = "CASE WHEN form = 0 THEN {} END"
_REGION = MADE["lease_regions"]
_FIELDS = """SELECT o_orderkey AS doc_id, o_orderkey AS k, '010-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '-5678' AS lessor_phone, '02-123-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS lessee_phone,
  (1 + o_orderkey % 9) * 1000000 AS deposit, (100 + o_orderkey % 900) * 1000 AS rent, concat(2000 + o_orderkey % 30, '년 ', 1 + o_orderkey % 12, '월 ', 1 + o_orderkey % 28, '일') AS day FROM orders"""
_SQL_SOURCES = "SELECT '제' || n_nationkey || '조' AS citation FROM nation"
_CITED = f"n AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '제[0-9]+조')) AS citation FROM a), v AS (SELECT answer_id, citation, citation IN ({_SQL_SOURCES}) AS verified FROM n)"
SQL = {
    "contract_rules": f"SELECT contract_id, {_NAMES}, {_SCORES} FROM ({MADE['contracts']})",
    "contract_findings": f"SELECT contract_id, {_SCORES} FROM ({MADE['contracts']}) WHERE {' OR '.join(_holds(r) for r in _RULES)}",
    "danger_scores": f"""SELECT contract_id, CAST(greatest(0, greatest(CASE WHEN contains(text, '언제든지 해지') THEN 88 ELSE 0 END, CASE WHEN contains(text, '권리를 포기') THEN 90 ELSE 0 END,
  CASE WHEN regexp_matches(text, '[1-9][0-9]%.*(인상|증액)') THEN 85 ELSE 0 END, CASE WHEN regexp_matches(text, '위약금.*(전액|50%)') THEN 87 ELSE 0 END)
  - CASE WHEN contains(text, '확정일자') THEN 10 ELSE 0 END - CASE WHEN regexp_matches(text, '보증금.*반환한다') THEN 10 ELSE 0 END) AS BIGINT) AS danger, 'general' AS domain FROM ({MADE['contracts']})""",
    "clause_hierarchy": f"""WITH g AS (SELECT o_orderkey AS doc_id, p AS pos, {_KIND} AS kind, {_N} AS n, {_CIRCLE} AS c FROM orders, {_SEVEN}),
  a AS (SELECT *, sum((kind = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS article_no FROM g), b AS (SELECT *, sum((kind IN (1, 2, 3, 6))::INT) OVER (PARTITION BY doc_id, article_no ORDER BY pos) AS paragraph_no FROM a)
  SELECT doc_id, pos::BIGINT AS pos, (CASE kind WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END)::BIGINT AS level, article_no::BIGINT AS article_no, paragraph_no::BIGINT AS paragraph_no,
  CASE WHEN kind = 0 THEN '제' || n || '조' WHEN kind IN (1, 2) THEN c || '항' WHEN kind = 4 THEN n || '호' ELSE n || '항' END AS number, CASE kind WHEN 0 THEN '제목 ' || n ELSE '' END AS title,
  CASE kind WHEN 0 THEN '내용 ' || pos WHEN 1 THEN '단락 ' || pos WHEN 2 THEN '단락' || pos WHEN 3 THEN '본문 ' || pos WHEN 4 THEN '세목 ' || pos ELSE '본문' END AS content
  FROM b WHERE article_no > 0 AND kind <> 5 AND (kind <> 4 OR paragraph_no > 0)""",
    "field_extraction": f"""SELECT doc_id, lessor_phone, NULL::VARCHAR AS lessor_resident_id, lessee_phone, NULL::VARCHAR AS lessee_resident_id, deposit, rent, NULL::BIGINT AS down_payment, NULL::BIGINT AS balance, day AS start_date, day AS end_date,
  NULL::VARCHAR AS signed_date, CASE WHEN k % 3 = 0 THEN '소재지 서울 ' || (k % 100) END AS address, CASE WHEN k % 3 = 1 THEN (20 + k % 60) + 0.5::DOUBLE END AS area_m2, NULL::DOUBLE AS area_pyeong, CASE WHEN k % 3 = 2 THEN '특약사항: 금지' ELSE '' END AS special_terms FROM ({_FIELDS})""",
    "extraction_with_fallback": f"WITH a AS ({MADE['answers']}), {_ANSWER} SELECT l.doc_id, CASE WHEN good THEN 'model' ELSE 'rules' END AS origin, CASE WHEN good THEN '' ELSE f.lessor_phone END AS lessor_phone, CASE WHEN good THEN l.deposit ELSE f.deposit END AS deposit, CASE WHEN good THEN 0 ELSE f.rent END AS rent FROM l JOIN ({_FIELDS}) f USING (doc_id)",
    "lease_validation": f"""WITH a AS ({MADE['answers']}), {_ANSWER} SELECT doc_id, deposit, NOT late AS is_valid, CASE WHEN late THEN 'contract_date' ELSE '' END AS errors,
  concat_ws(',', CASE WHEN deposit > 0 AND balance > 0 AND deposit <> balance THEN 'deposit' END, CASE WHEN lessor = '' THEN 'lessor.name' END, CASE WHEN lessee = '' THEN 'lessee.name' END, 'property.address', CASE WHEN deposit = 0 THEN 'terms.deposit' END) AS warnings FROM l""",
    "missing_fields": f"WITH a AS ({MADE['answers']}), {_ANSWER} SELECT doc_id, unnest(list_filter([CASE WHEN lessor = '' THEN 'lessor.name' END, CASE WHEN lessee = '' THEN 'lessee.name' END, 'property.address', CASE WHEN deposit = 0 THEN 'terms.deposit' END], lambda p: p IS NOT NULL)) AS path FROM l",
    "korean_views": f"WITH a AS ({MADE['answers']}), {_ANSWER} SELECT doc_id, lessor, deposit, 0::BIGINT AS rent, 87.6::DOUBLE AS confidence FROM l",
    "overlay_responses": """SELECT o_orderkey AS doc_id, o_orderpriority AS full_text, CASE WHEN o_orderkey % 3 > 0 THEN '[{"text":"' || o_orderstatus || '"}]' END AS words FROM orders""",
    "money": f"""WITH g AS (SELECT *, (1 + o_custkey % 999) AS a, o_orderkey % 1000 AS b, 1 + o_custkey % 90 AS c, 1 + id % 9 AS e, length(CAST(id AS VARCHAR)) AS n FROM ({MADE['values']}) JOIN orders ON id = o_orderkey)
  SELECT id, CASE form WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v WHEN 4 THEN '000원' END AS money, CAST(CASE form WHEN 0 THEN a * 1000 + b WHEN 1 THEN c WHEN 2 THEN e * 10000000 ELSE 0 END AS BIGINT) AS parsed,
  CAST(CASE form WHEN 0 THEN a * 1000 + b WHEN 1 THEN c WHEN 4 THEN id * 1000 ELSE 0 END AS BIGINT) AS from_text_a, CAST(CASE form WHEN 0 THEN a * 1000 + b WHEN 1 THEN c WHEN 4 THEN id * 1000 END AS BIGINT) AS from_text_b FROM g""",
    "korean_number": f"SELECT id, CASE form WHEN 3 THEN (1 + id % 9) * 110000000 END AS n, CASE form WHEN 3 THEN (1 + id % 9) * 110000000 ELSE 0 END AS n_or_0 FROM ({MADE['values']}) WHERE form IN (3, 5)",
    "dto_money": f"SELECT id, TRY_CAST(trim(replace(replace(v, ',', ''), '원', '')) AS BIGINT) AS n FROM ({MADE['values']})",
    "phones_dates_areas": f"""WITH g AS (SELECT *, lpad(CAST(id % 10000 AS VARCHAR), 4, '0') AS d, concat(2000 + id % 30, '년 ', 1 + id % 12, '월 ', 1 + id % 28, '일') AS day, lpad(CAST(id % 1000000 AS VARCHAR), 6, '0') AS s FROM ({MADE['facts']}))
  SELECT id, {_PHONE.format("'010-' || d || '-1234'")} AS phone, {_PHONE.format("'010-' || d || '-1234'")} AS phone_a, {_PHONE.format("'010-' || d || '-1234'")} AS phone_b, CASE WHEN form IN (1, 2) THEN day END AS date,
  CASE form WHEN 1 THEN 'start' WHEN 2 THEN 'end' ELSE 'signed' END AS role, CASE WHEN form = 3 THEN (10 + id % 90) + 0.5::DOUBLE END AS area, CASE WHEN form = 3 THEN '평' END AS unit, CASE WHEN form = 4 THEN '900101-1' || s END AS resident_id, form = 4 AS resident_ok FROM g""",
    "typo_correction": f"""WITH g AS (SELECT *, {_TYPOS} AS t FROM ({MADE['typos']})), r AS (SELECT *, CASE WHEN regexp_matches(t, '{_AMOUNT}') THEN regexp_replace(t, '[oO]', '0', 'g') ELSE t END AS u FROM g),
  w AS (SELECT *, CASE WHEN regexp_matches(u, '{_AMOUNT}') THEN regexp_replace(u, '[lI]', '1', 'g') ELSE u END AS corrected FROM r), z AS (SELECT *, trim(corrected, ' ') AS s FROM w)
  SELECT id, corrected, CAST(CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 0 END AS BIGINT) AS corrections, CASE WHEN id % 5 IN (0, 1, 3) THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
  CASE field WHEN '보증금' THEN regexp_matches(s, '{_AMOUNT}') OR regexp_matches(s, '[일이삼사오육칠팔구십백천만억조]+ *원') WHEN '면적' THEN regexp_matches(s, '[0-9]+([.][0-9]+)? *(㎡|평|제곱미터|m2)') WHEN '주소' THEN length(s) >= 10 AND regexp_matches(s, '[시도구동로길]') ELSE s <> '' END AS valid FROM z""",
    "contract_types": f"""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 4 = pos THEN '상가 ' || text WHEN doc_id % 9 = pos THEN '매매' ELSE text END AS t FROM ({_REGION}))
  SELECT doc_id, CASE WHEN bool_or(contains(t, '전세')) THEN '전세' WHEN bool_or(contains(t, '매매')) THEN '매매' WHEN bool_or(contains(t, '상가')) THEN '상가임대차' ELSE '임대차' END AS contract_type FROM g GROUP BY doc_id""",
    "field_types": """SELECT unnest(['임대인', '월세', 'none', '주소', '면적', '특약']) AS field_type, unnest([n, n, 4 * n, a, b, c]) AS regions FROM (SELECT count(*) AS n, count_if(o_orderkey % 3 = 0) AS a, count_if(o_orderkey % 3 = 1) AS b, count_if(o_orderkey % 3 = 2) AS c FROM orders)""",
    "nms": f"{_kept('confidence DESC, pos')} SELECT o.doc_id, o.pos::BIGINT AS pos, text, confidence FROM o JOIN k ON o.doc_id = k.doc_id AND list_contains(list_transform(kept, lambda b: b.pos), o.pos::BIGINT)",
    "merged_nms": f"{_kept('confidence DESC, pos')} SELECT o.doc_id, o.pos::BIGINT AS pos, text, confidence FROM o JOIN k ON o.doc_id = k.doc_id AND list_contains(list_transform(kept, lambda b: b.pos), o.pos::BIGINT)",
    "voting": f"""{_kept('pos')}, m AS (SELECT o.*, coalesce(list_filter(kept, lambda b: b.pos = o.pos)[1].pos, list_filter(kept, lambda b: {_IOU} > 0.5)[1].pos) AS leader FROM o JOIN k USING (doc_id)),
  t AS (SELECT *, min(pos) OVER w AS text_first, count(*) OVER w AS n, round(sum(confidence) OVER w, 9) AS total FROM m WINDOW w AS (PARTITION BY doc_id, leader, text)),
  q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, leader ORDER BY n DESC, text_first, confidence DESC, pos) AS a, row_number() OVER (PARTITION BY doc_id, leader ORDER BY total DESC, text_first, pos) AS b,
    row_number() OVER (PARTITION BY doc_id, leader ORDER BY (engine = 'trocr') DESC, CASE WHEN engine = 'trocr' THEN pos END NULLS LAST, confidence DESC, pos) AS c FROM t)
  SELECT doc_id, 'majority' AS strategy, leader, text, confidence FROM q WHERE a = 1 UNION ALL SELECT doc_id, 'confidence_weighted', leader, text, confidence FROM q WHERE b = 1 UNION ALL SELECT doc_id, 'trocr_priority', leader, text, confidence FROM q WHERE c = 1""",
    "engine_reports": f"SELECT engine, count(*) AS boxes, round(avg(confidence), 9) AS confidence FROM ({MADE['boxes']}) GROUP BY engine",
    "region_texts": f"SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS text, round(avg(confidence), 9) AS confidence FROM ({MADE['boxes']}) WHERE confidence >= 0.6 GROUP BY doc_id",
    "region_views": f"SELECT doc_id, text, round_even(confidence / 7, 4) AS confidence FROM ({MADE['boxes']}) WHERE pos = 3",
    "row_cluster": f"WITH RECURSIVE g AS MATERIALIZED ({MADE['cells']}), {_cluster('x')}, {_cluster('y')} SELECT g.doc_id, g.pos::BIGINT AS pos, ny.no AS row_no, nx.no AS col_no FROM g JOIN nx ON nx.doc_id = g.doc_id AND nx.v = g.x JOIN ny ON ny.doc_id = g.doc_id AND ny.v = g.y",
    "table_cells": f"SELECT doc_id, pos::BIGINT AS pos, (x + w)::BIGINT AS x2, (y + h)::BIGINT AS y2, round(x / 200 * 100, 6) AS px, round(h / 160 * 100, 6) AS ph FROM ({MADE['cells']}) WHERE w >= 20 AND h >= 15 AND w < 104.5 AND h < 76",
    "line_assembly": f"""WITH g AS (SELECT *, y + pos * 3 AS z FROM ({MADE['boxes']})), a AS (SELECT *, CASE WHEN abs(z - lag(z) OVER (PARTITION BY doc_id ORDER BY pos)) <= 20 THEN 0 ELSE 1 END AS new FROM g),
  l AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS line FROM a), t AS (SELECT doc_id, line, string_agg(text, ' ' ORDER BY x, pos) AS text FROM l GROUP BY doc_id, line) SELECT doc_id, string_agg(text, chr(10) ORDER BY line) AS text FROM t GROUP BY doc_id""",
    "reading_order": f"""SELECT doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY y, x, pos) AS "order" FROM ({MADE['boxes']}) GROUP BY doc_id""",
    "ocr_words": """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS text, o_custkey % 10 / 10 AS confidence, round_even(CAST(o_orderkey % 100 AS DOUBLE) / 300 * 100, 2) AS x, round_even(CAST(o_custkey % 50 AS DOUBLE) / 200 * 100, 2) AS y, 10.0::DOUBLE AS width, 7.5::DOUBLE AS height,
  o_orderkey % 100 AS px_x, 15::BIGINT AS px_height FROM orders""",
    "element_words": """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, w.text, round_even(o_orderkey % 50 + w.dx, 2) AS x, 25.0::DOUBLE AS y, w.width, 25.0::DOUBLE AS height FROM orders, (VALUES ('a', 0.0::DOUBLE, 11.5::DOUBLE), ('bb', 12.5, 24.0), ('c', 37.5, 11.5)) w(text, dx, width) WHERE o_orderkey % 2 = 0""",
    "element_blocks": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'table' AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'a bb c' ELSE o_orderpriority END AS text, CAST(o_orderkey % 50 AS DOUBLE) AS x, 25.0::DOUBLE AS y, 50.0::DOUBLE AS width, 25.0::DOUBLE AS height FROM orders",
    "quad_percent": "SELECT o_orderkey AS id, CAST(o_orderkey % 50 AS DOUBLE) AS x, CAST(o_custkey % 50 AS DOUBLE) AS y, 25.0::DOUBLE AS w, 12.5::DOUBLE AS h FROM orders",
    "accuracy": "SELECT id, round_even(2.0::DOUBLE * a / (2 * a + t) * 100, 2) AS accuracy FROM (SELECT o_orderkey AS id, 3 + 2 * (o_orderkey % 20) AS a, o_custkey % 9 AS t FROM orders)",
    "verified_citations": f"WITH a AS ({MADE['cited']}), {_CITED} SELECT * FROM v",
    "annotated_answers": f"WITH a AS ({MADE['cited']}), p AS (SELECT *, regexp_extract(text, '^(제[0-9]+조)', 1) AS c1, regexp_extract(text, '조와 (제[0-9]+조)', 1) AS c2 FROM a) SELECT answer_id, CASE WHEN c1 = '' THEN text ELSE c1 || CASE WHEN c1 IN ({_SQL_SOURCES}) THEN '' ELSE '(미검증)' END || '와 ' || c2 || CASE WHEN c2 IN ({_SQL_SOURCES}) THEN '' ELSE '(미검증)' END || '에 따른다' END AS text FROM p",
    "answer_measures": f"WITH a AS ({MADE['cited']}), {_CITED} SELECT (SELECT count(*) FROM a) AS answers, round((SELECT count(DISTINCT answer_id) FROM v) / (SELECT count(*) FROM a), 6) AS citation_rate, round((SELECT avg(verified::INT) FROM v), 6) AS verified_rate, round((SELECT avg((text LIKE '%수 없%')::INT) FROM a), 6) AS refusal_rate",
    "reranked": """WITH g AS (SELECT o_custkey AS query_id, o_orderkey AS id, (SELECT count(*) FROM (SELECT DISTINCT unnest(string_split('[residential] ' || lower(o_orderpriority), ' ')) AS w) WHERE w IN ('[residential]', 'urgent', 'high', 'order')) AS s FROM orders)
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM g QUALIFY rank <= 2""",
    "fact_checks": "SELECT CASE WHEN o_custkey % 3 = o_orderkey % 3 THEN 'agrees' ELSE 'differs' END AS verdict, count(*) AS n FROM orders GROUP BY 1",
    "term_lookup": "SELECT o_orderkey, o_orderstatus AS term, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus || '에 대한 설명입니다.' END AS simple_explanation, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'waits' ELSE '법률적 정의를 찾을 수 없습니다.' END AS legal_definition, CASE o_orderstatus WHEN 'F' THEN 'f1|f2' WHEN 'O' THEN 'o' ELSE '예시 정보가 없습니다.' END AS examples FROM orders",
    "status_lookup": "SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 = 0 THEN 'CACHED' WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NOT_FOUND' END AS status, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN c_name END AS result FROM customer",
    "reasoning": "SELECT o_orderkey AS id, array_to_string([o_orderstatus, o_orderpriority][1:least(2, o_orderkey % 4)], ' → ') AS summary FROM orders",
}
