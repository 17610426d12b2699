"""Text functions of contracts: patterns, typos, money, dates, phones, areas, validation.

Patterns search, they don't match whole values. Digits are those of any script and white space is
Unicode's, as spelled-out classes, so that other SQL engines agree. A function that finds nothing gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D = r"\p{Nd}"
BLANK = " \t\n\x0b\f\r\x1c-\x1f\x85\xa0  -     　"
S = f"[{BLANK}]*"
_DASH = "－−-"
_GAP = f"[.{BLANK}{_DASH}]?"
_WIDE = "０１２３４５６７８９"
NUMERALS = "일이삼사오육칠팔구십백천만억"

MONEY = f"({D}{{1,3}}(?:,{D}{{3}})*){S}([만천]?원)"
MONEY_KOREAN = f"(?:일금{S})?([{NUMERALS}조]+){S}원정?"
MONEY_KOREAN_B = MONEY_KOREAN.replace("조", "")
RESIDENT_ID = rf"({D}{{6}}){S}[{_DASH}]{S}({D}{{7}}|\*{{6,7}}|{D}\*{{6}})"
DATE = f"({D}{{4}}){S}[-년./]{S}({D}{{1,2}}){S}[-월./]{S}({D}{{1,2}}){S}일?"
DATE_KOREAN = f"({D}{{4}}){S}년{S}({D}{{1,2}}){S}월{S}({D}{{1,2}}){S}일"
PHONE = f"(0{D}{{1,2}}){_GAP}({D}{{3,4}}){_GAP}({D}{{4}})"
ADDRESS = f"([가-힣]+[시도]){S}([가-힣]+[구군시]){S}([가-힣]+[동읍면로길])"
AREA = rf"({D}+(?:\.{D}+)?){S}(㎡|평|제곱미터|m2)"
FLOOR = f"({D}+|지하{S}{D}+){S}층"
UNIT = f"({D}+){S}호"
PATTERNS = {
    "money_numeric": MONEY, "money_korean": MONEY_KOREAN, "resident_id": RESIDENT_ID, "date_ymd": DATE, "date_korean": DATE_KOREAN,
    "phone": PHONE, "address": ADDRESS, "area": AREA, "floor": FLOOR, "unit": UNIT,
}

_TERMS_A = """임대인<임디인 임래인 암대인; 임차인<임치인 임쟈인 암차인; 보증금<보즈금 보증굼 보중금; 월세<월쎄 월새 뭘세; 전세<전쎄 전새
계약금<게약금 계악금 겨약금; 중도금<중도굼 줄도금; 잔금<잔굼 간금; 계약<게약 계악 겨약; 임대차<임대쟈 입대차; 주택<주댁 쥬택
아파트<아팥트 아파투; 오피스텔<오피스탤; 상가<상까; 건물<건믈 건볼; 면적<면젹; 평방미터<㎡ m2
특약사항<특약시항 특약상항; 계약기간<게약기간 계약기깐; 갱신<갠신 겡신; 해지<해자 헤지; 위약금<위약굼 휘약금; 소유자<소유져 소유쟈
등기부등본<등기부동본; 확정일자<화정일자 확정일져; 원정<원쩡 원졍; 일금<일굼 잃금
일천만<일쳔만; 이천만<이쳔만; 삼천만<삼쳔만; 사천만<사쳔만; 오천만<오쳔만; 육천만<육쳔만; 칠천만<칠쳔만; 팔천만<팔쳔만; 구천만<구쳔만"""
_TERMS_B = """임대인<임디인 임래인 암대인 입대인; 임차인<임치인 임쟈인 암차인 입차인; 보증금<보즈금 보증굼 보중금 보정금; 월세<월쎄 월새 뭘세
계약금<게약금 계악금 겨약금; 중도금<중도굼 줄도금; 잔금<잔굼 간금; 전세<전쎄 전새; 특약사항<특약시항 특약상항; 원정<원쩡 원졍; 일금<일굼 잃금"""


def _pairs(terms: str) -> tuple[tuple[str, str], ...]:
    split = (entry.strip().split("<") for line in terms.splitlines() for entry in line.split(";"))
    return tuple((wrong, right) for right, wrongs in split for wrong in wrongs.split())


#: (wrong, right) in the order in which they are replaced.
TYPOS_A, TYPOS_B = _pairs(_TERMS_A), _pairs(_TERMS_B)


def with_terms(custom: dict[str, list[str]], base: tuple[tuple[str, str], ...] = TYPOS_A) -> tuple[tuple[str, str], ...]:
    """base and custom variants of terms; a variant that base has gets the new term in its old place."""
    pairs = dict(base)
    for right, wrongs in custom.items():
        pairs |= {wrong: right for wrong in wrongs if wrong != right}
    return tuple(pairs.items())


def strip(v: Column) -> Column:
    return F.regexp_replace(v, f"^[{BLANK}]+|[{BLANK}]+$", "")


def found(v: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match; null without one."""
    return F.when(F.regexp_like(v, F.lit(pattern)), F.regexp_extract(v, pattern, group))


def digits(v: Column) -> Column:
    return F.translate(v, _WIDE, "0123456789")


def correct_typos(v: Column, typos: tuple[tuple[str, str], ...] = TYPOS_A, glyphs: bool = True) -> Column:
    """struct(corrected, corrections, confidence): terms replaced one after the other, each seeing what the last left.

    With glyphs, O and l among digits are repaired wherever the text has an amount of money.
    """
    kind = "array<struct<`from`: string, `to`: string>>"
    none = F.array().cast(kind)
    table = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in typos))
    start = F.struct(v.alias("text"), none.alias("log"))
    fold = F.aggregate(table, start, lambda acc, p: F.when(F.contains(acc["text"], p["from"]), F.struct(F.replace(acc["text"], p["from"], p["to"]).alias("text"), F.array_append(acc["log"], p).alias("log"))).otherwise(acc))
    # most texts have no typo: one search spares them the fold
    any_typo = F.regexp_like(v, F.lit("|".join(a for a, _ in typos)))
    done = F.when(any_typo, fold).otherwise(start)
    text = done["text"]
    if glyphs:
        for pattern, to in (("[oO]", "0"), ("[lI]", "1"), ("[　\xa0]", " ")):
            text = F.when(F.regexp_like(text, F.lit(MONEY)), F.regexp_replace(text, pattern, to)).otherwise(text)
    return F.struct(text.alias("corrected"), done["log"].alias("corrections"), F.when(F.size(done["log"]) > 0, 0.9).otherwise(1.0).alias("confidence"))


def korean_number(v: Column) -> Column:
    """The number that numerals spell, read from the left; null for 0. A digit replaces one that waits for its unit."""
    one = F.lit("일이삼사오육칠팔구")
    unit = F.create_map(*(F.lit(x) for pair in (("십", 10), ("백", 100), ("천", 1000), ("만", 10_000), ("억", 100_000_000)) for x in pair))

    def step(acc: Column, c: Column) -> Column:
        digit, size = F.when(c == "", 0).otherwise(F.position(c, one)), F.coalesce(F.try_element_at(unit, c), F.lit(0))
        value = F.greatest(acc["c"], F.lit(1)) * size
        big = size >= 10_000
        return (
            F.when(digit > 0, _pair(acc["r"], digit))
            .when(big, _pair(acc["r"] + value, F.lit(0)))
            .when(size > 0, _pair(acc["r"], value))
            .otherwise(acc)
        )

    total = F.aggregate(F.split(v, ""), _pair(F.lit(0), F.lit(0)), step, lambda acc: acc["r"] + acc["c"])
    return F.nullif(total, F.lit(0).cast("bigint"))


def _pair(r: Column, c: Column) -> Column:
    return F.struct(r.cast("bigint").alias("r"), c.cast("bigint").alias("c"))


def whole_number(v: Column) -> Column:
    """A number with commas; null if it is none or too large."""
    return F.regexp_replace(digits(v), ",", "").try_cast("bigint")


def extract_money(v: Column) -> Column:
    return F.coalesce(found(v, MONEY), found(v, MONEY_KOREAN))


def parse_money(v: Column) -> Column:
    """The amount in won: of digits, whatever their unit, else of numerals; 0 if there is none."""
    return F.coalesce(whole_number(found(v, MONEY, 1)), F.when(F.regexp_like(v, F.lit(MONEY)), F.lit(0)), korean_number(found(v, MONEY_KOREAN_B, 1)), F.lit(0)).cast("bigint")


def money_from_text(v: Column, default: int | None = 0) -> Column:
    """The first run of digits and commas; default (0, or null as another model has it) without one or if it is only commas."""
    value = whole_number(found(v, f"[{D},]+"))
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def dto_money(v: Column) -> Column:
    """A number that may have commas and 원; 0 for null or blank, null for anything else."""
    plain = strip(F.regexp_replace(v, "[,원]", ""))
    return F.when(v.isNull() | (plain == ""), F.lit(0).cast("bigint")).otherwise(plain.try_cast("bigint"))


def _ymd(v: Column, pattern: str) -> Column:
    parts = [x for i, name in enumerate("년월일", 1) for x in (F.regexp_extract(v, pattern, i), F.lit(f"{name} " if name != "일" else name))]
    return F.when(F.regexp_like(v, F.lit(pattern)), F.concat(*parts))


def extract_date(v: Column) -> Column:
    """Y년 M월 D일 as written; days aren't checked."""
    return F.coalesce(_ymd(v, DATE_KOREAN), _ymd(v, DATE))


def date_role(v: Column) -> Column:
    """start, end or signed, by the words beside a date."""
    return F.when(F.regexp_like(v, F.lit("시작|부터")), "start").when(F.regexp_like(v, F.lit("종료|까지")), "end").otherwise("signed")


def _dashed(v: Column, pattern: str, n: int) -> Column:
    return F.when(F.regexp_like(v, F.lit(pattern)), F.concat_ws("-", *(F.regexp_extract(v, pattern, i + 1) for i in range(n))))


def extract_phone(v: Column) -> Column:
    return _dashed(v, PHONE, 3)


def extract_resident_id(v: Column) -> Column:
    return _dashed(v, RESIDENT_ID, 2)


def extract_area(v: Column) -> Column:
    """struct(value, unit); null without an area."""
    return F.when(F.regexp_like(v, F.lit(AREA)), F.struct(digits(F.regexp_extract(v, AREA, 1)).cast("double").alias("value"), F.regexp_extract(v, AREA, 2).alias("unit")))


def format_phone_a(v: Column) -> Column:
    """11 digits as 3-4-4, 10 as 3-3-4, others as they are."""
    d = F.regexp_replace(v, f"[^{D}]", "")
    cut = lambda *ends: F.concat_ws("-", *(F.substring(d, a + 1, b - a) for a, b in zip((0, *ends), (*ends, 11))))
    return F.when(F.length(d) == 11, cut(3, 7)).when(F.length(d) == 10, cut(3, 6)).otherwise(v)


def format_phone_b(v: Column) -> Column:
    """10 digits or more as 3-4-rest, the rest of four at most; others as they are."""
    d = F.regexp_replace(v, f"[^{D}]", "")
    return F.when(F.length(d) >= 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 4), F.substring(d, 8, 4))).otherwise(v)


def resident_id_ok(v: Column) -> Column:
    """Whether a value without spaces is a resident number; models only report it."""
    return F.regexp_like(F.replace(v, F.lit(" "), F.lit("")), F.lit("^" + RESIDENT_ID.replace(S, "") + "$"))


_KINDS = "money=금액 월세 보증금 계약금 중도금 잔금; resident_id=주민번호 주민등록번호; date=날짜 계약일 시작일 종료일; phone=휴대폰 연락처 전화번호; area=면적 공급면적 전용면적; address=소재지 주소"
FIELD_KINDS = {kind: names.split() for kind, names in (entry.split("=") for entry in _KINDS.split("; "))}


def field_kind(field: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, names in FIELD_KINDS.items():
        out = out.when(field.isin(*names), kind)
    return out.otherwise("any")


def field_valid(field: Column, v: Column) -> Column:
    """Whether a value suits its field; any other field only needs one."""
    v, kind = strip(v), field_kind(field)
    like = lambda p: F.regexp_like(v, F.lit(p))
    return (
        F.when(kind == "money", like(MONEY) | like(MONEY_KOREAN))
        .when(kind == "resident_id", like(RESIDENT_ID))
        .when(kind == "date", like(DATE))
        .when(kind == "phone", like(PHONE))
        .when(kind == "area", like(AREA))
        .when(kind == "address", (F.length(v) >= 10) & like("[시도구동로길]"))
        .otherwise(v != "")
    )


def markdown_text(v: Column) -> Column:
    """Markdown without tags, table bars and rules, on one line."""
    for pattern, to in (("<[^>]+>", " "), ("[|]", " "), ("-{2,}", ""), (f"[{BLANK}]+", " ")):
        v = F.regexp_replace(v, pattern, to)
    return strip(v)


def element_text(text: Column, markdown: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.coalesce(markdown_text(markdown), F.lit("")))


def html_text(v: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags, entities of mark-up resolved, on one line."""
    v = F.regexp_replace(v, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    v = F.regexp_replace(F.regexp_replace(v, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        v = F.replace(v, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(v, "[ \t\n\r]+", " "))


def unfenced(v: Column) -> Column:
    """JSON out of a Markdown code fence; other text as it is."""
    return F.coalesce(found(v, r"(?s)```(?:json)?\s*(.*?)```", 1), v)


def json_path(v: Column, path: str) -> Column:
    """A value inside JSON text; null where a step isn't an object."""
    return F.get_json_object(v, f"$.{path}")


def cache_key(query: Column, k: Column, filters: Column) -> Column:
    """query|k|filters, the filters in order of their names."""
    items = F.transform(F.array_sort(F.map_entries(filters)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("|", query, k.cast("string"), F.coalesce(F.array_join(items, ","), F.lit("")))
