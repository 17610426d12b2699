"""Documents from object to lease: OCR words or parsed elements, structuring by a model with rules behind it, validation, checks of claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import OCR_PAGES, PARSE_ELEMENTS
from ..sources import providers
from . import fields, layout


def words_or_blocks(files: DataFrame, ocr: Callable[[], providers.Call], parse: Callable[[], providers.Call]) -> tuple[DataFrame, DataFrame]:
    """words and blocks of files(doc_id, content): OCR words; where they are none, blocks of the parser, which is asked for these files only.

    Providers give JSON of pages (width, height, words) and of elements. A file without an answer has neither.
    """
    pages, elements = (s.split(" ", 3)[3] for s in (OCR_PAGES, PARSE_ELEMENTS))
    read = providers.call(files, "doc_id", "content", ocr).select("doc_id", F.from_json("output", pages).alias("pages"))
    words = layout.ocr_words(read)
    rest = files.join(words.select("doc_id").distinct(), "doc_id", "left_anti")
    parsed = providers.call(rest, "doc_id", "content", parse).select("doc_id", F.from_json("output", elements).alias("elements"))
    return words, layout.element_blocks(parsed)


def full_text(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, text: words of a line side by side, or blocks one below the other."""
    lines = layout.lines(words.select("doc_id", F.struct("page", "pos").alias("pos"), "text", F.col("px_x").alias("x"), F.col("px_y").alias("y")))
    by = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    return lines.unionByName(by.select("doc_id", F.array_join(F.transform("b", lambda v: v["text"]), "\n").alias("text")))


def leases(texts: DataFrame, model: Callable[[], providers.Call]) -> DataFrame:
    """doc_id, lease, validation, error: the model's answer to texts(doc_id, text) as a lease; the empty lease, and why, where it failed."""
    x = providers.call(texts, "doc_id", "text", model)
    x = x.select("doc_id", fields.parse_lease(F.col("output")).alias("lease"), "error")
    return x.select("doc_id", "lease", fields.validate_lease(F.col("lease")).alias("validation"), "error")


def ocr_to_lease(files: DataFrame, ocr: Callable[[], providers.Call], parse: Callable[[], providers.Call], model: Callable[[], providers.Call]) -> DataFrame:
    """doc_id, success, full_text, words, contract_data, validation of files(doc_id, content): the whole way, a failure being a row's and not the job's."""
    words, blocks = words_or_blocks(files, ocr, parse)
    texts = full_text(words, blocks)
    made = leases(texts, model)
    boxes = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "pos", "text", "confidence", "x", "y", "width", "height", "px_x", "px_y", "px_width", "px_height"))).alias("words"))
    x = files.select("doc_id").join(texts, "doc_id", "left").join(boxes, "doc_id", "left").join(made, "doc_id", "left")
    x = x.select("doc_id", F.col("text").isNotNull().alias("success"), F.coalesce("text", F.lit("")).alias("full_text"), "words", F.to_json("lease").alias("contract_data"), F.to_json("validation").alias("validation"))
    return fields.overlay_response(x)


def leases_or_rules(regions: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, origin, lease: the lease of a model's answer(doc_id, answer), or of rules over regions where that is void."""
    x = answers.select("doc_id", fields.parse_lease(F.col("answer")).alias("lease"))
    rules = fields.extract_fields(regions)
    text, number = (lambda c: F.coalesce(F.col(c), F.lit(""))), (lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    blank = F.lit("")
    person = lambda p: F.struct(blank.alias("name"), text(f"{p}_resident_id").alias("resident_id"), blank.alias("address"), text(f"{p}_phone").alias("phone"))
    area = F.coalesce(F.concat(F.col("area_m2").cast("string"), F.lit("㎡")), F.concat(F.col("area_pyeong").cast("string"), F.lit("평")), blank)
    own = F.struct(
        person("lessor").alias("lessor"), person("lessee").alias("lessee"), F.struct(text("address").alias("address"), area.alias("area"), blank.alias("purpose")).alias("property"),
        F.struct(
            number("deposit").alias("deposit"), number("rent").alias("monthly_rent"), number("down_payment").alias("down_payment"), F.lit(0).cast("bigint").alias("middle_payment"), number("balance").alias("balance"),
            text("start_date").alias("contract_start_date"), text("end_date").alias("contract_end_date"), text("signed_date").alias("contract_date"),
        ).alias("terms"),
        F.col("special_terms").alias("special_terms"),
    )
    both = rules.select("doc_id", own.alias("by_rules")).join(x, "doc_id", "full")
    # what says something: a party's name, a place, or an amount
    says = [F.coalesce(F.col(f"lease.{p}"), F.lit("")) != "" for p in ("lessor.name", "lessee.name", "property.address")] + [F.coalesce(F.col("lease.terms.deposit"), F.lit(0)) > 0]
    both = both.withColumn("given", says[0] | says[1] | says[2] | says[3])
    return both.select("doc_id", F.when(F.col("given"), "model").otherwise("rules").alias("origin"), F.when(F.col("given"), F.col("lease")).otherwise(F.col("by_rules")).alias("lease"))


def multi_scale(boxes: DataFrame, enlarged: dict[float, DataFrame]) -> DataFrame:
    """Boxes of a page and of enlarged ones, by scale, put back on the page, without overlaps."""
    return layout.merged_without_overlaps(boxes, *(providers.rescaled(b, scale) for scale, b in enlarged.items()))


def cell_passes(cells: DataFrame, first: Callable[[], providers.Call], second: Callable[[], providers.Call], least: float = 0.6) -> DataFrame:
    """cell_id, text, confidence of cells(cell_id, content): JSON answers of an engine, asked again where it was unsure."""
    x = providers.with_retry_of_poor(cells, "cell_id", "content", first, second, lambda o: F.get_json_object(o, "$.confidence").try_cast("double"), least)
    return x.select("cell_id", F.get_json_object("output", "$.text").alias("text"), "confidence")


def region_engine(regions: DataFrame, engine: Callable[[], providers.Call], confidence: float = providers.ENGINE_CONFIDENCE["trocr"]) -> DataFrame:
    """regions(doc_id, pos, crop, ...) read again, one by one, by an engine that gives no confidence of its own; blank readings go."""
    x = regions.withColumn("_key", F.struct("doc_id", "pos"))
    read = providers.call(x.select(F.to_json("_key").alias("key"), "crop"), "key", "crop", engine).select("key", tx.strip(F.col("output")).alias("text"))
    rest = [c for c in regions.columns if c not in ("text", "confidence", "engine", "crop")]
    return x.withColumn("key", F.to_json("_key")).select("key", *rest).join(read.where("text <> ''"), "key").drop("key").withColumn("confidence", F.lit(confidence)).withColumn("engine", F.lit("trocr"))


def money_claims(claims: DataFrame, said: str, written: str) -> DataFrame:
    """An extension: claims with verdict: whether an amount in transcribed speech is the one written; unclear without either."""
    amount = tx.parse_money(F.col(said))
    clear = tx.extract_money(F.col(said)).isNotNull() & F.col(written).isNotNull()
    return claims.withColumn("verdict", F.when(~F.coalesce(clear, F.lit(False)), "unclear").when(amount == F.col(written), "agrees").otherwise("differs"))
