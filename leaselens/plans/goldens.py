"""Queries over inline rows whose results are known: Korean text, geometry, clauses. Their SQL is the known result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, similarity
from ..functions import text as tx
from ..operators import clauses, fields, jobs, layout, rules, search
from ..schemas import OCR_PAGES, PARSE_ELEMENTS, REGION


def values(columns: str, *rows: tuple) -> str:
    """SQL of fixed rows; the first row's types hold."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        if isinstance(v, int):
            return f"{v}::BIGINT"
        return "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(one(v) for v in r) + ')' for r in rows)}) t({columns})"


def _col(spark: SparkSession, *rows: str | None) -> DataFrame:
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id bigint, v string")


CONTRACTS = (
    ("K1", "임대인은 보증금을 받는다."), ("K2", "보증금은 없다. 차임은 10% 인상하고 임차인은 권리를 포기한다."), ("K3", "보증금 반환, 확정일자, 수리, 중도해지, 갱신을 정한다."),
    ("K4", "위약금은 150% 전액이고 언제든지 해지한다. 2021년 기간, 110% 인상. 수선, 갱신, 확정일자, 중도 해지."),
)


def contract_rules(spark: SparkSession, _: str) -> DataFrame:
    x = rules.rule_counts(spark.createDataFrame(CONTRACTS, "contract_id string, text string"))
    return x.select("contract_id", *(F.array_join(k, ",").alias(k) for k in ("fraud", "missing", "illegal")), "api_score", "worker_score")


def contract_findings(spark: SparkSession, _: str) -> DataFrame:
    found = rules.findings(spark.createDataFrame(CONTRACTS, "contract_id string, text string"))
    return rules.scores_of(found)


ALL_MISSING = "확정일자 안내,수리 책임,중도 해지 조건,계약 갱신"
TERMS = (("확정일자", "보증금을 먼저 돌려받게 하는 날짜 도장", "임대차 계약서에 관청이 찍는 날짜", ["주민센터에서 받는다"]), ("대항력", "집이 팔려도 살 수 있는 힘", "제3자에게 임대차를 주장하는 효력", ["전입신고와 점유로 생긴다"]), ("우선변제권", "다른 빚보다 먼저 받는 권리", "경매에서 후순위보다 먼저 변제받을 권리", ["대항력과 확정일자로 생긴다"]))


def term_lookup(spark: SparkSession, _: str) -> DataFrame:
    terms = spark.createDataFrame(TERMS, "term string, simple_explanation string, legal_definition string, examples array<string>")
    x = rules.explain_terms(spark.createDataFrame([("대항력",), ("전세권",)], "term string"), terms)
    return x.select("term", "simple_explanation", "legal_definition", F.array_join("examples", "|").alias("examples"))


def typo_correction(spark: SparkSession, _: str) -> DataFrame:
    rows = [("보증금", "보즈금 일금 일천만원쩡"), ("면적", "84.5㎡"), ("계약일", "게약일: 2024년 1월 15일"), ("날짜", "2024/13/45"), ("주소", "서울시 강남구 테헤란로 123"), ("보증금", "보증금 1O,000원 lIo"), ("전화번호", "010-1234-5678"), ("주소", "  "), ("기타", "")]
    x = fields.postprocess(spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate(rows)], "id bigint, field string, value string"))
    log = F.array_join(F.transform("corrections", lambda c: F.concat(c["from"], F.lit(">"), c["to"])), ",")
    return x.select("id", "corrected", log.alias("corrections"), "confidence", "valid")


def korean_number(spark: SparkSession, _: str) -> DataFrame:
    return _col(spark, "일천만", "오천만", "일억", "일억이천만", "이천오백만", "삼백오십만", "십", "오십만", "만", "일조", "").select("id", F.coalesce(tx.korean_number(F.col("v")), F.lit(-1).cast("bigint")).alias("n"))


def money(spark: SparkSession, _: str) -> DataFrame:
    x = _col(spark, "1000000원", "1,000,000원", "50만원", "일금 오천만원정", "보증금 일억원", "금 50만원", "오천만원", "가,나")
    v = F.col("v")
    return x.select("id", tx.extract_money(v).alias("money"), tx.parse_money(v).alias("parsed"), tx.money_from_text(v).alias("from_text_a"), F.coalesce(tx.money_from_text(v, None), F.lit(-1).cast("bigint")).alias("from_text_b"))


def dto_money(spark: SparkSession, _: str) -> DataFrame:
    return _col(spark, "100,000원", None, "1억", "").select("id", F.coalesce(tx.dto_money(F.col("v")), F.lit(-1).cast("bigint")).alias("n"))


def phones_dates_areas(spark: SparkSession, _: str) -> DataFrame:
    x = _col(spark, "02-123-4567", "01012345678", "1234567890123", "0212345678", "2024년 2월 1일부터", "2026.1.31까지", "84.5㎡", "25평", "12 m2", "900101-1******")
    v, area = F.col("v"), tx.extract_area(F.col("v"))
    x = x.select("id", tx.extract_phone(v).alias("phone"), tx.format_phone_a(v).alias("phone_a"), tx.format_phone_b(v).alias("phone_b"), tx.extract_date(v).alias("date"), tx.date_role(v).alias("role"), area.alias("a"), tx.extract_resident_id(v).alias("resident_id"))
    return x.select("id", "phone", "phone_a", "phone_b", "date", "role", F.col("a.value").alias("area"), F.col("a.unit").alias("unit"), "resident_id")


CLAUSE_LINES = "서문\n① 고아\n제1조 (목적) 내용A\n① 첫째\n1호 가\n2. 둘째\n이어지는 줄\n3항\n10. 열\n제2조 제목만 있음\n1호 버려짐"


def clause_hierarchy(spark: SparkSession, _: str) -> DataFrame:
    x = clauses.clauses(clauses.text_lines(spark.createDataFrame([("d", CLAUSE_LINES)], "doc_id string, text string")))
    return x.select(F.col("pos").cast("bigint").alias("pos"), F.col("level").cast("bigint").alias("level"), "article_no", "paragraph_no", "number", "title", "content")


def _regions(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(engine, text, x, y, confidence) in order, as boxes of 10 by 10."""
    return spark.createDataFrame([("d", i, e, t, float(c), x, y, 10, 10) for i, (e, t, x, y, c) in enumerate(rows)], REGION)


def nms(spark: SparkSession, _: str) -> DataFrame:
    return layout.without_overlaps(_regions(spark, [("p", "a", 0, 0, 0.9), ("p", "b", 1, 0, 0.95), ("p", "c", 4, 0, 0.8), ("p", "d", 6, 0, 0.7), ("p", "e", 100, 0, 0.7), ("p", "f", 100, 0, 0.7)])).select("text", "confidence")


def row_cluster(spark: SparkSession, _: str) -> DataFrame:
    cells = spark.createDataFrame([("d", v, v) for v in (0, 9, 10, 18, 21)], "doc_id string, x int, y int")
    return layout.grid(cells).select(F.col("x").cast("bigint").alias("x"), F.col("row_no").cast("bigint").alias("row_no"), F.col("col_no").cast("bigint").alias("col_no"))


def line_assembly(spark: SparkSession, _: str) -> DataFrame:
    return layout.lines(_regions(spark, [("p", "b", 50, 0, 1), ("p", "a", 0, 15, 1), ("p", "c", 0, 30, 1), ("p", "d", 0, 60, 1)]))


def voting(spark: SparkSession, _: str) -> DataFrame:
    r = _regions(spark, [("paddle", "x", 0, 0, 0.6), ("paddle", "z", 50, 0, 0.4), ("easy", "y", 1, 0, 0.5), ("trocr", "y", 0, 0, 0.55), ("trocr", "w", 50, 0, 0.95)])
    parts = [layout.vote(r, s).select(F.lit(s).alias("strategy"), F.col("leader").cast("bigint").alias("leader"), "text", "confidence") for s in ("majority", "confidence_weighted", "trocr_priority")]
    return parts[0].union(parts[1]).union(parts[2])


def ocr_words(spark: SparkSession, _: str) -> DataFrame:
    quad = lambda x0, y0, x1, y1: {"vertices": [{"x": float(a), "y": float(b)} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]}
    words = [{"text": " 계약 ", "confidence": 0.9, "boundingBox": quad(10, 20, 40, 35)}, {"text": "", "confidence": 0.9, "boundingBox": quad(0, 0, 9, 9)}, {"text": "끝", "confidence": None, "boundingBox": {"vertices": [{"x": 1.0, "y": 2.0}]}}]
    x = layout.ocr_words(spark.createDataFrame([("d", [{"width": 300, "height": 200, "words": words}])], OCR_PAGES))
    return x.select("text", "confidence", "x", "y", "width", "height", F.col("px_x").cast("bigint").alias("px_x"), F.col("px_height").cast("bigint").alias("px_height"))


def element_words(spark: SparkSession, _: str) -> DataFrame:
    quad = [{"x": a, "y": b} for a, b in ((0.1, 0.2), (0.5, 0.2), (0.5, 0.3), (0.1, 0.3))]
    e = [{"category": "table", "content": {"text": "", "markdown": "| a | bb |\n|----|----|\n<b>c</b>", "html": ""}, "coordinates": quad}]
    return layout.element_words(spark.createDataFrame([("d", e)], PARSE_ELEMENTS)).select("text", "x", "y", "width", "height")


def quad_percent(spark: SparkSession, _: str) -> DataFrame:
    x = spark.createDataFrame([([{"x": a, "y": b} for a, b in ((0.1, 0.2), (0.5, 0.2), (0.5, 0.3), (0.1, 0.3))],), ([],)], "v array<struct<x: double, y: double>>")
    return x.select(geometry.quad_percent(F.col("v")).alias("q")).select(*(F.round(f"q.{c}", 6).alias(c) for c in "xywh"))


def accuracy(spark: SparkSession, _: str) -> DataFrame:
    x = spark.createDataFrame([(0, "임대인 김", "임차인김"), (1, "같다", "같 다"), (2, "", "")], "id bigint, a string, b string")
    return x.select("id", similarity.character_accuracy(F.col("a"), F.col("b")).alias("accuracy"))


LEASE_LINES = ("입대인 홍길동 010-1234-5678", "암차인 김철수 01098765432", "보즈금 10,000,000원", "월세 일금 오십만원정", "중도금 5,000원", "2024년 2월 1일부터", "2026.1.31까지", "소재지 서울", "전용면적 33.5㎡", "특약사항: 반려동물 금지", "을 900101-1******")


def field_extraction(spark: SparkSession, _: str) -> DataFrame:
    x = fields.extract_fields(spark.createDataFrame([("d", i, t) for i, t in enumerate(LEASE_LINES)], "doc_id string, pos int, text string"))
    none = {c: F.coalesce(c, F.lit(-1).cast(x.schema[c].dataType)) for c in ("down_payment", "balance", "area_pyeong")}
    return x.withColumns({"special_terms": F.array_join("special_terms", "|")} | none).drop("doc_id")


def contract_types(spark: SparkSession, _: str) -> DataFrame:
    return _col(spark, "상가 매매", "상가", "전세 매매", "월세").select("id", fields.contract_type(F.col("v")).alias("contract_type"), fields.field_type(F.col("v")).alias("field_type"))


ANSWERS = (
    '```json\n{"lessor": {"name": "a"}, "terms": {"deposit": "100원", "down_payment": "10", "middle_payment": 0, "balance": "80", "contract_start_date": "2026-01-01", "contract_end_date": "2024-01-01"}}\n```',
    '{"lessor": {"name": "a"}, "lessee": {"name": "b"}, "property": {"address": "c"}, "terms": {"deposit": "1,000", "balance": "1000"}}',
    '{"lessor": {"name": "a"}, "terms": {"deposit": "1억"}}', "no JSON",
)


def lease_validation(spark: SparkSession, _: str) -> DataFrame:
    x = _col(spark, *ANSWERS).select("id", fields.parse_lease(F.col("v")).alias("lease")).withColumn("v", fields.validate_lease(F.col("lease")))
    return x.select("id", F.col("lease.terms.deposit").alias("deposit"), F.col("v.is_valid").alias("is_valid"), F.array_join("v.errors", ",").alias("errors"), F.array_join("v.warnings", ",").alias("warnings"))


def missing_fields(spark: SparkSession, _: str) -> DataFrame:
    x = _col(spark, *ANSWERS).select(F.col("id").alias("doc_id"), fields.parse_lease(F.col("v")).alias("lease"))
    return fields.missing_paths(x)


def verified_citations(spark: SparkSession, _: str) -> DataFrame:
    answers = spark.createDataFrame([("q1", "제7조와 제10조에 따라, 제7조"), ("q2", "근거 없음")], "answer_id string, text string")
    return search.citations(answers, spark.createDataFrame([("제7조 차임",)], "text string"))


def status_lookup(spark: SparkSession, _: str) -> DataFrame:
    schema = "job_id string, status string, result string"
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    return jobs.lookup(ids, spark.createDataFrame([("a", "COMPLETED", "{}")], schema), spark.createDataFrame([("a", "FAILED", None), ("b", "RETRYING", None)], schema))


QUERIES = {f.__name__: f for f in (contract_rules, contract_findings, term_lookup, typo_correction, korean_number, money, dto_money, phones_dates_areas, clause_hierarchy, nms, row_cluster, line_assembly, voting, ocr_words, element_words, quad_percent, accuracy, field_extraction, contract_types, lease_validation, missing_fields, verified_citations, status_lookup)}
SQL = {
    "contract_rules": values(
        "contract_id, fraud, missing, illegal, api_score, worker_score",
        ("K1", "보증금 반환 미명시", ALL_MISSING, "", 55.0, 60.0), ("K2", "보증금 반환 미명시", ALL_MISSING, "차임 10% 인상,임차인 권리 포기", 100.0, 100.0),
        ("K3", "", "", "", 0.0, 0.0), ("K4", "일방적 해지권,과도한 위약금", "", "차임 10% 인상,1년 계약 기간", 80.0, 100.0),
    ),
    "contract_findings": values("contract_id, api_score, worker_score", ("K1", 55.0, 60.0), ("K2", 100.0, 100.0), ("K4", 80.0, 100.0)),
    "term_lookup": values("term, simple_explanation, legal_definition, examples", ("대항력", *TERMS[1][1:3], TERMS[1][3][0]), ("전세권", "전세권에 대한 설명입니다.", "법률적 정의를 찾을 수 없습니다.", "예시 정보가 없습니다.")),
    "typo_correction": values(
        "id, corrected, corrections, confidence, valid",
        (0, "보증금 일금 일천만원정", "보즈금>보증금,원쩡>원정", 0.9, True), (1, "84.5평방미터", "㎡>평방미터", 0.9, True), (2, "계약일: 2024년 1월 15일", "게약>계약", 0.9, True),
        (3, "2024/13/45", "", 1.0, True), (4, "서울시 강남구 테헤란로 123", "", 1.0, True), (5, "보증금 10,000원 110", "", 1.0, True), (6, "010-1234-5678", "", 1.0, True),
        (7, "  ", "", 1.0, False), (8, "", "", 1.0, False),
    ),
    "korean_number": values("id, n", *enumerate((10000000, 50000000, 100000000, 120000000, 5000000, 500000, 10, 500000, 10000, 1, -1))),
    "money": values(
        "id, money, parsed, from_text_a, from_text_b",
        (0, "000원", 0, 1000000, 1000000), (1, "1,000,000원", 1000000, 1000000, 1000000), (2, "50만원", 50, 50, 50), (3, "일금 오천만원정", 50000000, 0, -1),
        (4, "일억원", 100000000, 0, -1), (5, "50만원", 50, 50, 50), (6, "오천만원", 50000000, 0, -1), (7, None, 0, 0, -1),
    ),
    "dto_money": values("id, n", (0, 100000), (1, 0), (2, -1), (3, 0)),
    "phones_dates_areas": values(
        "id, phone, phone_a, phone_b, date, role, area, unit, resident_id",
        (0, "02-123-4567", "02-123-4567", "02-123-4567", None, "signed", None, None, None), (1, "010-1234-5678", "010-1234-5678", "010-1234-5678", None, "signed", None, None, None),
        (2, None, "1234567890123", "123-4567-8901", None, "signed", None, None, None), (3, "021-234-5678", "021-234-5678", "021-2345-678", None, "signed", None, None, None),
        (4, None, "2024년 2월 1일부터", "2024년 2월 1일부터", "2024년 2월 1일", "start", None, None, None), (5, None, "2026.1.31까지", "2026.1.31까지", "2026년 1월 31일", "end", None, None, None),
        (6, None, "84.5㎡", "84.5㎡", None, "signed", 84.5, "㎡", None), (7, None, "25평", "25평", None, "signed", 25.0, "평", None), (8, None, "12 m2", "12 m2", None, "signed", 12.0, "m2", None),
        (9, None, "900101-1******", "900101-1******", None, "signed", None, None, "900101-1******"),
    ),
    "clause_hierarchy": values(
        "pos, level, article_no, paragraph_no, number, title, content",
        (2, 0, 1, 0, "제1조", "목적", "내용A"), (3, 1, 1, 1, "①항", "", "첫째"), (4, 2, 1, 1, "1호", "", "가"), (5, 1, 1, 2, "2항", "", "둘째"),
        (7, 1, 1, 3, "3항", "", "항"), (8, 1, 1, 4, "10항", "", "열"), (9, 0, 2, 0, "제2조", "제목만 있음", ""),
    ),
    "nms": values("text, confidence", ("b", 0.95), ("d", 0.7), ("e", 0.7)),
    "row_cluster": values("x, row_no, col_no", (0, 0, 0), (9, 0, 0), (10, 1, 1), (18, 1, 1), (21, 2, 2)),
    "line_assembly": values("doc_id, text", ("d", "a c b\nd")),
    "voting": values(
        "strategy, leader, text, confidence",
        ("majority", 0, "y", 0.55), ("majority", 1, "z", 0.4), ("confidence_weighted", 0, "y", 0.5), ("confidence_weighted", 1, "w", 0.95), ("trocr_priority", 0, "y", 0.55), ("trocr_priority", 1, "w", 0.95),
    ),
    "ocr_words": values("text, confidence, x, y, width, height, px_x, px_height", ("계약", 0.9, 3.33, 10.0, 10.0, 7.5, 10, 15)),
    "element_words": values("text, x, y, width, height", ("a", 10.0, 20.0, 9.2, 10.0), ("bb", 20.0, 20.0, 19.2, 10.0), ("c", 40.0, 20.0, 9.2, 10.0)),
    "quad_percent": values("x, y, w, h", (10.0, 20.0, 40.0, 10.0), (0.0, 0.0, 0.0, 0.0)),
    "accuracy": values("id, accuracy", (0, 75.0), (1, 100.0), (2, 100.0)),
    "field_extraction": values(
        "lessor_phone, lessor_resident_id, lessee_phone, lessee_resident_id, deposit, rent, down_payment, balance, start_date, end_date, signed_date, address, area_m2, area_pyeong, special_terms",
        ("010-1234-5678", None, "010-9876-5432", "900101-1******", 10000000, 500000, -1, -1, "2024년 2월 1일", "2026년 1월 31일", None, "소재지 서울", 33.5, -1.0, "특약사항: 반려동물 금지"),
    ),
    "contract_types": values("id, contract_type, field_type", (0, "매매", None), (1, "상가임대차", None), (2, "전세", None), (3, "임대차", "월세")),
    "lease_validation": values(
        "id, deposit, is_valid, errors, warnings",
        (0, 100, False, "contract_date", "deposit,lessee.name,property.address"), (1, 1000, True, "", ""),
        (2, 0, True, "", "lessor.name,lessee.name,property.address,terms.deposit"), (3, 0, True, "", "lessor.name,lessee.name,property.address,terms.deposit"),
    ),
    "missing_fields": values("doc_id, path", (0, "lessee.name"), (0, "property.address"), *((i, p) for i in (2, 3) for p in ("lessor.name", "lessee.name", "property.address", "terms.deposit"))),
    "verified_citations": values("answer_id, citation, verified", ("q1", "제7조", True), ("q1", "제10조", False)),
    "status_lookup": values("job_id, status, result", ("a", "COMPLETED", "{}"), ("b", "RETRYING", None), ("c", "NOT_FOUND", None)),
}
