"""The clause hierarchy of a contract: articles, paragraphs, items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import S, D, strip

ARTICLE = rf"^제({D}+)조{S}(?:\(|\[)?([^\])]*)(?:\]|\))?{S}(.*)"
PARAGRAPH = rf"^(?:[①-⑩]|({D}+){S}[.항]{S}(.*))"
ITEM = rf"^({D}+){S}호{S}(.*)"


def text_lines(docs: DataFrame, id_: str = "doc_id") -> DataFrame:
    """id, pos, line: the lines of a text that aren't blank, stripped."""
    return docs.select(id_, F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select(id_, "pos", strip(F.col("raw")).alias("line")).where("line <> ''")


def clauses(lines: DataFrame, id_: str = "doc_id") -> DataFrame:
    """id, pos, level (0 article, 1 paragraph, 2 item), article_no, paragraph_no, number, title, content.

    Lines before the first article, items before a paragraph, and lines of no kind are dropped; an article
    starts its paragraphs anew. article_no and paragraph_no count from 1 in a document and an article.
    """
    line = F.col("line")
    like = lambda p: F.regexp_like(line, F.lit(p))
    x = lines.withColumn("is_article", like(ARTICLE)).withColumn("is_paragraph", ~F.col("is_article") & like(PARAGRAPH))
    # all in one order, sorted once: an article's paragraphs are those so far but for those before it
    order, peers = Window.partitionBy(id_).orderBy("pos"), Window.partitionBy(id_, "pos")
    x = x.withColumns({"article_no": F.sum(F.col("is_article").cast("int")).over(order), "so_far": F.sum(F.col("is_paragraph").cast("int")).over(order)})
    before = F.col("so_far") - F.sum(F.col("is_paragraph").cast("int")).over(peers)
    x = x.withColumn("before", F.when(F.col("is_article"), before))
    x = x.withColumn("paragraph_no", F.col("so_far") - F.coalesce(F.max("before").over(order), F.lit(0)))
    level = F.when(F.col("is_article"), 0).when(F.col("article_no") > 0, F.when(F.col("is_paragraph"), 1).when((F.col("paragraph_no") > 0) & like(ITEM), 2))
    part = lambda p, i: F.regexp_extract(line, p, i)
    mark, body = part(PARAGRAPH, 1), part(PARAGRAPH, 2)
    number = (
        F.when(F.col("level") == 0, F.concat(F.lit("제"), part(ARTICLE, 1), F.lit("조")))
        .when(F.col("level") == 1, F.concat(F.when(mark != "", mark).otherwise(F.left(line, F.lit(1))), F.lit("항")))
        .otherwise(F.concat(part(ITEM, 1), F.lit("호")))
    )
    content = (
        F.when(F.col("level") == 0, part(ARTICLE, 3))
        .when(F.col("level") == 1, F.when(body != "", body).otherwise(strip(F.substring(line, 2, 1_000_000_000))))
        .otherwise(part(ITEM, 2))
    )
    x = x.withColumn("level", level).where("level is not null")
    return x.select(id_, "pos", "level", "article_no", "paragraph_no", number.alias("number"), F.when(F.col("level") == 0, part(ARTICLE, 2)).otherwise("").alias("title"), content.alias("content"))


def clause_tree(flat: DataFrame, id_: str = "doc_id") -> DataFrame:
    """id, articles: the hierarchy as nested arrays in order."""
    items = flat.where("level = 2").groupBy(id_, "article_no", "paragraph_no").agg(F.array_sort(F.collect_list(F.struct("pos", "number", "content"))).alias("items"))
    paragraphs = flat.where("level = 1").join(items, [id_, "article_no", "paragraph_no"], "left")
    paragraphs = paragraphs.groupBy(id_, "article_no").agg(F.array_sort(F.collect_list(F.struct("pos", "number", "content", "items"))).alias("paragraphs"))
    articles = flat.where("level = 0").join(paragraphs, [id_, "article_no"], "left")
    return articles.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("pos", "number", "title", "content", "paragraphs"))).alias("articles"))
