"""Contract rules: fraud patterns, missing and illegal clauses, risk scores, terms.

Rules are data. A rule fires when, of each of its groups, some keyword is in the
text, and no excluded keyword is. Keywords are plain substrings: 10% is also in 110%.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    name: str
    weight_class: str
    groups: tuple[tuple[str, ...], ...] = ()
    without: tuple[str, ...] = field(default=())

    def fires(self, text: Column) -> Column:
        some = [reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in g)) for g in self.groups]
        none = [~F.contains(text, F.lit(w)) for w in self.without]
        return reduce(Column.__and__, some + none)


KOREAN_RULES = (
    Rule("fraud", "일방적 해지권", "high", (("언제든지 해지", "임의로 해지"),)),
    Rule("fraud", "과도한 위약금", "high", (("위약금",), ("50%", "전액"))),
    Rule("fraud", "보증금 반환 미명시", "medium", (("보증금",),), ("반환",)),
    Rule("missing", "확정일자 안내", "critical", (), ("확정일자",)),
    Rule("missing", "수리 책임", "important", (), ("수리", "수선")),
    Rule("missing", "중도 해지 조건", "important", (), ("중도 해지", "중도해지")),
    Rule("missing", "계약 갱신", "recommended", (), ("갱신",)),
    Rule("illegal", "차임 10% 인상", "", (("10%",), ("인상", "증액"))),
    Rule("illegal", "임차인 권리 포기", "", (("권리를 포기", "이의를 제기할 수 없"),)),
    Rule("illegal", "1년 계약 기간", "", (("1년",), ("기간",))),
)
#: The same shapes of rules for the driver's documents, which have no Hangul.
DOCUMENT_RULES = (
    Rule("fraud", "insults", "high", (("idiot", "scum", "pathetic"),)),
    Rule("fraud", "contact offered", "high", (("@",), (".com", ".org"))),
    Rule("fraud", "license without rights", "medium", (("Licensed",),), ("reserved",)),
    Rule("missing", "no license", "critical", (), ("icense",)),
    Rule("missing", "no article", "important", (), (" the ", " der ", " la ")),
    Rule("missing", "no conjunction", "recommended", (), (" and ", " und ", " et ", " y ")),
    Rule("illegal", "bars", "", (("|",),)),
    Rule("illegal", "shouting", "", (("!!",), ("THE", "UND", "DE"))),
)
API_POINTS = {"fraud": 15, "missing": 10, "illegal": 25}
WORKER_POINTS = {"fraud": dict(zip(("low", "medium", "high"), (5, 15, 30))), "missing": dict(zip(("recommended", "important", "critical"), (5, 10, 20)))}


def findings(contracts: DataFrame, rules: tuple[Rule, ...] = KOREAN_RULES, id_: str = "contract_id") -> DataFrame:
    """id, kind, name, weight_class: a row for each rule that fires. Null texts have no findings."""
    hits = F.array(*(F.when(r.fires(F.col("text")), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.name).alias("name"), F.lit(r.weight_class).alias("weight_class"))) for r in rules))
    return contracts.select(id_, F.explode(F.array_compact(hits)).alias("f")).select(id_, "f.*")


def rule_counts(contracts: DataFrame, rules: tuple[Rule, ...] = KOREAN_RULES, id_: str = "contract_id") -> DataFrame:
    """id, fraud, missing, illegal (names of what fires), api_score, worker_score: one projection without a shuffle."""
    text = F.col("text")
    names = {k: F.array_compact(F.array(*(F.when(r.fires(text), F.lit(r.name)) for r in rules if r.kind == k))) for k in API_POINTS}
    api = sum((F.when(r.fires(text), API_POINTS[r.kind]).otherwise(0) for r in rules), F.lit(0))
    worker = sum((F.when(r.fires(text), worker_points(r.kind, r.weight_class)).otherwise(0) for r in rules), F.lit(0))
    return contracts.select(id_, *(v.alias(k) for k, v in names.items()), F.least(api, F.lit(100)).cast("double").alias("api_score"), F.least(worker, F.lit(100)).cast("double").alias("worker_score"))


def worker_points(kind: str, weight_class: str) -> int:
    """Unknown classes weigh 5; illegal clauses 25 each."""
    return 25 if kind == "illegal" else WORKER_POINTS[kind].get(weight_class, 5)


def scores_of(found: DataFrame, id_: str = "contract_id") -> DataFrame:
    """id, api_score, worker_score from a long table of findings."""
    kind, weight = F.col("kind"), F.col("weight_class")
    worker = F.when(kind == "illegal", 25)
    for k, classes in WORKER_POINTS.items():
        for c, points in classes.items():
            worker = worker.when((kind == k) & (weight == c), points)
    api = reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), list(API_POINTS.items())[1:], F.when(kind == "fraud", API_POINTS["fraud"]))
    total = lambda c: F.least(F.sum(c), F.lit(100)).cast("double")
    return found.groupBy(id_).agg(total(api.otherwise(0)).alias("api_score"), total(worker.otherwise(5)).alias("worker_score"))


def level_summary(assessments: DataFrame, by: str = "task_id") -> DataFrame:
    """Clauses by risk level, all but Risk and Caution as safe; the percentage of Risk to one place, halves to even."""
    level, n = F.col("risk_level"), F.count(F.lit(1))
    risk, caution = F.count_if(level == "Risk"), F.count_if(level == "Caution")
    return assessments.groupBy(by).agg(
        n.alias("total_clauses"), risk.alias("risk_count"), caution.alias("caution_count"), (n - risk - caution).alias("safety_count"),
        F.bround(risk / n * 100, 1).alias("risk_percentage"),
    )


def reasoning_summary(steps: Column) -> Column:
    """The first two steps."""
    return F.coalesce(F.array_join(F.slice(steps, 1, 2), " → "), F.lit(""))


def explain_terms(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """term and its explanation; a term that the dictionary lacks gets the default sentences. terms is a fixed dictionary."""
    x = asked.join(F.broadcast(terms), "term", "left")
    return x.withColumns({
        "simple_explanation": F.coalesce("simple_explanation", F.concat("term", F.lit("에 대한 설명입니다."))),
        "legal_definition": F.coalesce("legal_definition", F.lit("법률적 정의를 찾을 수 없습니다.")),
        "examples": F.coalesce("examples", F.array(F.lit("예시 정보가 없습니다."))),
    })


#: Ours: the published description names these checks and scores but not their expressions.
DANGER = (
    ("early termination", r"언제든지\s*(계약을\s*)?해지", 88), ("waiver", r"권리를?\s*포기", 90), ("rent increase", r"[1-9][0-9]%.*(인상|증액)", 85),
    ("forfeit", r"보증금.*(몰수|반환하지)", 85), ("penalty", r"위약금.*(전액|50%)", 87), ("repairs", r"(수리|수선).*임차인.*부담", 62), ("entry", r"임의로\s*출입", 58),
)
SAFE = (r"확정일자", r"수리.*임대인.*부담", r"보증금.*반환한다")


def danger_score(text: Column) -> Column:
    """An extension: the highest score of a danger that shows, 10 less for each safe expression, 0 at least."""
    top = F.greatest(*(F.when(F.regexp_like(text, F.lit(p)), s).otherwise(0) for _, p, s in DANGER))
    safe = sum((F.when(F.regexp_like(text, F.lit(p)), 10).otherwise(0) for p in SAFE), F.lit(0))
    return F.greatest(top - safe, F.lit(0))


def domain(text: Column) -> Column:
    """An extension: the domain of a question by its keywords, in this order."""
    like = lambda p: F.regexp_like(text, F.lit(p))
    return F.when(like("상가|권리금"), "commercial").when(like("세금|양도|취득세"), "tax").when(like("주택|전세|월세|임대차"), "residential").otherwise("general")
