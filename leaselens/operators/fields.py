"""Fields of a lease: types of regions, rule-based extraction, post-processing, validation, projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import LEASE

#: Types in order, and what else than its own name tells a type.
_TYPES = "임대인 갑|소유자, 임차인 을|세입자, 보증금 전세금, 월세 차임|월임대료, 계약금, 중도금, 잔금, 주소 소재지|목적물, 면적, 특약"
FIELD_KEYWORDS = tuple((entry.split()[0], "|".join(entry.split())) for entry in _TYPES.split(", "))


def _first(pairs, v: Column) -> Column:
    out = F.when(F.lit(False), "")
    for value, pattern in pairs:
        out = out.when(F.regexp_like(v, F.lit(pattern)), value)
    return out


def field_type(v: Column) -> Column:
    """The first type, in this order, of which a keyword is in the text; null of none."""
    return _first(FIELD_KEYWORDS, v)


def contract_type(v: Column) -> Column:
    return F.coalesce(_first((("전세", "전세"), ("매매", "매매"), ("상가임대차", "상가")), v), F.lit("임대차"))


def contract_types(regions: DataFrame) -> DataFrame:
    """doc_id, contract_type from all texts of a document."""
    return regions.groupBy("doc_id").agg(contract_type(F.array_join(F.collect_list("text"), " ")).alias("contract_type"))


def postprocess(fields: DataFrame, typos=tx.TYPOS_A) -> DataFrame:
    """fields(id, field, value) with corrected, corrections, confidence, valid (null without a field)."""
    x = fields.withColumn("c", tx.correct_typos(F.col("value"), typos)).select(*fields.columns, "c.*")
    return x.withColumn("valid", F.when(F.coalesce("field", F.lit("")) != "", tx.field_valid(F.col("field"), F.col("corrected"))))


def postprocess_batch(docs: DataFrame) -> DataFrame:
    """docs(id, fields: map of field to value): the map of field to its result."""
    x = postprocess(docs.select("id", F.explode("fields").alias("field", "value")))
    result = F.struct("corrected", "corrections", "confidence", "valid")
    return x.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", result))).alias("results"))


def extract_fields(regions: DataFrame) -> DataFrame:
    """doc_id and the fields that rules find in regions(doc_id, pos, text), typos B corrected; later regions overwrite.

    A party is carried from the region that names it to those that follow. Of the amounts, a region gives only the first
    that it speaks of: deposit, rent, down payment, balance; the middle payment is never taken.
    """
    x = regions.select("doc_id", "pos", tx.correct_typos(F.col("text"), tx.TYPOS_B, glyphs=False)["corrected"].alias("t"))
    x = x.withColumn("kind", F.coalesce(field_type(F.col("t")), F.lit("")))
    t, kind = F.col("t"), F.col("kind")
    says = lambda w: F.contains(t, F.lit(w))
    party = F.when(says("임대인") | (kind == "임대인"), "lessor").when(says("임차인") | (kind == "임차인"), "lessee")
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("party", F.last(party, ignorenulls=True).over(order))
    amount = F.when((kind == "보증금") | says("보증금"), "deposit").when((kind == "월세") | says("월세"), "rent").when((kind == "계약금") | says("계약금"), "down_payment").when((kind == "잔금") | says("잔금"), "balance")
    area, date = tx.extract_area(t), tx._ymd(t, tx.DATE)
    x = x.withColumns({"amount": amount, "money": tx.parse_money(t), "date": date, "role": tx.date_role(t), "phone": tx.extract_phone(t), "rid": tx.extract_resident_id(t), "area": area})
    last = lambda value, when: F.max_by(value, F.when(when & value.isNotNull(), F.col("pos")))
    metric = F.col("area.unit") != "평"
    return x.groupBy("doc_id").agg(
        *(last(F.col(v), F.col("party") == p).alias(f"{p}_{n}") for p in ("lessor", "lessee") for v, n in (("phone", "phone"), ("rid", "resident_id"))),
        *(last(F.col("money"), F.col("amount") == a).alias(a) for a in ("deposit", "rent", "down_payment", "balance")),
        *(last(F.col("date"), F.col("role") == r).alias(f"{r}_date") for r in ("start", "end", "signed")),
        last(t, (kind == "주소") | says("소재지")).alias("address"),
        last(F.col("area.value"), metric).alias("area_m2"), last(F.col("area.value"), ~metric).alias("area_pyeong"),
        F.transform(F.array_sort(F.collect_list(F.when((kind == "특약") | says("특약"), F.struct("pos", "t")))), lambda s: s["t"]).alias("special_terms"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body has it."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_lease(raw: Column) -> Column:
    """The lease in a model's JSON answer, code fence and all; amounts as numbers, the empty lease if it isn't one."""
    amounts = ("deposit", "monthly_rent", "down_payment", "middle_payment", "balance")

    def sound(s: Column) -> Column:
        # an amount that is no number makes the whole answer void, as a failed validation does
        terms = s["terms"]
        bad = F.coalesce(F.exists(F.array(*(terms[a] for a in amounts)), lambda v: v.isNotNull() & tx.dto_money(v).isNull()), F.lit(False))
        return F.when(~bad, s)

    def lease(s: Column) -> Column:
        person = lambda who: F.struct(*(F.coalesce(s[who][k], F.lit("")).alias(k) for k in ("name", "resident_id", "address", "phone"))).alias(who)
        return F.struct(
            person("lessor"), person("lessee"),
            F.struct(*(F.coalesce(s["property"][k], F.lit("")).alias(k) for k in ("address", "area", "purpose"))).alias("property"),
            F.struct(*(tx.dto_money(s["terms"][a]).alias(a) for a in amounts), *(F.coalesce(s["terms"][d], F.lit("")).alias(d) for d in ("contract_start_date", "contract_end_date", "contract_date"))).alias("terms"),
            F.coalesce(s["special_terms"], F.array().cast("array<string>")).alias("special_terms"),
        )

    return _let(F.from_json(tx.unfenced(raw), LEASE, {"mode": "PERMISSIVE"}), lambda s: _let(sound(s), lease))


REQUIRED = "lessor.name lessee.name property.address terms.deposit".split()


def validate_lease(lease: Column) -> Column:
    """struct(is_valid, errors, warnings), each an array of fields; null (and no verdict) for null.

    Dates are compared as text. Instalments must sum to the deposit if both are given.
    """

    def verdict(lease: Column) -> Column:
        terms = lease["terms"]
        n = lambda k: F.coalesce(terms[k], F.lit(0))
        total = n("down_payment") + n("middle_payment") + n("balance")
        start, end = (F.coalesce(terms[k], F.lit("")) for k in ("contract_start_date", "contract_end_date"))
        errors = F.array_compact(F.array(F.when((start != "") & (end != "") & (start > end), F.lit("contract_date"))))

        def missing(path: str) -> Column:
            a, b = path.split(".")
            v = lease[a][b]
            return v.isNull() | (v == (0 if b == "deposit" else ""))

        warnings = F.array_compact(F.array(F.when((n("deposit") > 0) & (total > 0) & (total != n("deposit")), F.lit("deposit")), *(F.when(missing(p), F.lit(p)) for p in REQUIRED)))
        return F.when(lease.isNotNull(), F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings")))

    return _let(lease, verdict)


def missing_paths(leases: DataFrame) -> DataFrame:
    """doc_id, path of required values that are missing, as an anti-join of what there is with what there must be."""
    spark = leases.sparkSession
    need = spark.createDataFrame([(p,) for p in REQUIRED], "path string")
    there = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f"lease.{p}").cast("string"), F.lit("")).isin("", "0") == F.lit(False), F.lit(p)) for p in REQUIRED)))
    have = leases.select("doc_id", F.explode(there).alias("path"))
    return leases.select("doc_id").crossJoin(F.broadcast(need)).join(have, ["doc_id", "path"], "left_anti")


def korean_view(lease: Column, confidence: Column, source: Column) -> Column:
    """The lease under Korean names; nulls become empty or 0, confidence a percentage to one place."""
    text = lambda v: F.coalesce(v, F.lit(""))
    money = lambda v: F.coalesce(v, F.lit(0).cast("bigint"))
    person = lambda p: F.struct(text(p["name"]).alias("성명"), text(p["resident_id"]).alias("주민등록번호"), text(p["address"]).alias("주소"), text(p["phone"]).alias("연락처"))
    terms = lease["terms"]
    return F.struct(
        F.struct(person(lease["lessor"]).alias("임대인"), person(lease["lessee"]).alias("임차인")).alias("당사자"),
        F.struct(text(lease["property"]["address"]).alias("소재지"), text(lease["property"]["area"]).alias("면적")).alias("부동산"),
        F.struct(*(money(terms[k]).alias(n) for k, n in (("deposit", "보증금"), ("monthly_rent", "월세"), ("down_payment", "계약금"), ("middle_payment", "중도금"), ("balance", "잔금")))).alias("금액"),
        F.coalesce(lease["special_terms"], F.array().cast("array<string>")).alias("특약사항"),
        F.struct(F.bround(F.coalesce(confidence, F.lit(0.0)) * 100, 1).alias("신뢰도"), text(source).alias("원본")).alias("메타"),
    )


def region_view(regions: DataFrame) -> DataFrame:
    """Regions for export, confidence to four places."""
    return regions.withColumn("confidence", F.bround("confidence", 4))


def overlay_response(pages: DataFrame, with_words: bool = True) -> DataFrame:
    """The public part of an overlay: words only if asked for and there are some."""
    words = F.when(F.lit(with_words) & (F.coalesce(F.size("words"), F.lit(0)) > 0), F.transform("words", lambda w: w.dropFields("px_x", "px_y", "px_width", "px_height")))
    return pages.select("doc_id", "success", "full_text", words.alias("words"), "contract_data", "validation")


def or_default(v: Column, default: Column) -> Column:
    """default for null, empty text, 0 and empty JSON text alike."""
    return F.when(v.isNull() | v.cast("string").isin("", "0", "0.0", "[]", "{}"), default).otherwise(v)
