"""Cards from documents: extraction, categories, first-wins dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fascicle import schema
from fascicle.functions import markdown
from fascicle.functions.keys import html


def category(stem: Column) -> Column:
    """The first category of which a keyword stands in the stem."""
    low, out = F.lower(stem), F.when(F.lit(False), "")
    for name, words in schema.CARD_KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, name)
    return out.otherwise("past_exams")


def badge(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\*\*\[(.*?)\]\*\*", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"\[(.*?)\]", 1), F.lit("")))


def bullets(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(F.regexp_replace(F.btrim(x), r"^(?:[-*•]|\d+[.)])\s+", "")))
    return F.filter(lines, lambda x: x != "")


def extract(docs: DataFrame) -> DataFrame:
    """Card rows of documents (doc_id, text): blocks with a stem and an answer, in order."""
    kind = F.when(F.contains("heading", F.lit("MCQ")), "mcq").when(F.contains("heading", F.lit("Written")), "written").when(F.contains("heading", F.lit("Case")), "case")
    parts = markdown.sections(docs).withColumn("kind", kind).where("kind IS NOT NULL").withColumnRenamed("body", "answer")
    rows = markdown.with_fields(markdown.blocks(parts))
    front = F.when(F.col("kind") == "case", F.concat_ws("\n", F.nullif("scenario", F.lit("")), F.nullif(markdown.field(F.col("block"), "Questions"), F.lit("")))).otherwise(F.col("question"))
    back = F.when(F.col("kind") == "mcq", F.concat_ws("\n", F.nullif("correct_answer", F.lit("")), F.nullif("explanation", F.lit("")))).otherwise(F.col("model_answer"))
    out = rows.select("doc_id", "kind", "ordinal", front.alias("front"), bullets(back).alias("back_bullets"), badge(F.col("block")).alias("badge")).where("front <> '' AND size(back_bullets) > 0")
    n = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ordinal"))
    return out.withColumn("id", F.concat_ws("-", F.col("doc_id").cast("string"), F.upper(F.substring("kind", 1, 3)), F.lpad(n.cast("string"), 2, "0"))).withColumn("category", category(F.col("front")))


def first_wins(rows: DataFrame, text: str, order: list[str], chars: int = 40, within: list[str] | None = None) -> DataFrame:
    """The first row, in order, of each key: the text's first letters and digits, lower-cased."""
    key = F.substring(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]", ""), 1, chars)
    keys = within or []
    kept = rows.withColumn("__key", key).groupBy(*keys, "__key").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__r"))
    return kept.select("__r.*")


def rendered(cards: DataFrame) -> DataFrame:
    """front_html, back_html and hierarchical tags of cards."""
    items = F.array_join(F.transform("back_bullets", lambda b: F.concat(F.lit("<li>"), html(b), F.lit("</li>"))), "")
    return cards.withColumns({"front_html": html(F.col("front")), "back_html": F.concat(F.lit("<ul>"), items, F.lit("</ul>")), "tags": F.concat_ws("::", F.lit("cards"), F.col("kind"), F.col("category"))})


#: Rules of concept cards: in the order of ``place``, a callout takes the first whose trigger stands in its header; those of scope text are each held against the whole text.
CONCEPT_RULES = "place int, scope string, triggers array<string>, code string, category string, badge string, front string, back_bullets array<string>, source_section string"
MOST_RULES = 1000
_CALLOUT = r"(?sU)>\s*\[!(?:IMPORTANT|NOTE|WARNING)\]\s*\n(.*?)(?=\n\n\w|\n---|\z)"


def callout_headers(text: Column) -> Column:
    """The first line that isn't blank of each important, note or warning callout, without its quote marks."""
    bodies = F.regexp_extract_all(text, F.lit(_CALLOUT), F.lit(1))
    lines = lambda b: F.transform(F.filter(F.split(b, "\n"), lambda x: F.btrim(x) != ""), lambda x: F.btrim(F.regexp_replace(x, r"^>\s*", "")))
    return F.filter(F.transform(bodies, lambda b: F.try_element_at(lines(F.regexp_replace(b, r"^\s+|\s+$", "")), F.lit(1))), lambda h: h.isNotNull())


def concept_cards(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Cards of documents (doc_id, text, lecture, module) by a table of CONCEPT_RULES, all in one pass over the texts.

    A rule's front may hold {lecture}. A callout gives one card at most, a rule on whole texts
    one a document; null texts give none. The rules are a module's configuration: more than
    MOST_RULES raise.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError("too many rules for one pass")
    names = [c.split()[0] for c in CONCEPT_RULES.split(", ")]
    every = F.broadcast(rules.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__rules")))  # one row of MOST_RULES at most
    rows = docs.select("doc_id", "text", "lecture", "module", callout_headers(F.coalesce("text", F.lit(""))).alias("__heads")).join(every, F.lit(True))
    hit = lambda r, where: F.exists(r["triggers"], lambda t: F.contains(where, t))
    of = lambda scope: F.filter("__rules", lambda r: r["scope"] == scope)
    first = F.filter(F.transform("__heads", lambda h: F.try_element_at(F.filter(of("callout"), lambda r: hit(r, h)), F.lit(1))), lambda r: r.isNotNull())
    found = F.concat(first, F.filter(of("text"), lambda r: F.coalesce(hit(r, F.col("text")), F.lit(False))))
    out = rows.select("doc_id", "lecture", "module", F.posexplode(found).alias("ordinal", "r"))
    front = F.replace("r.front", F.lit("{lecture}"), F.coalesce("lecture", F.lit("")))
    card = F.concat_ws("-", F.upper(F.substring(F.coalesce("module", F.lit("")), 1, 4)), "r.code")
    return out.select("doc_id", "ordinal", card.alias("id"), "r.category", "r.badge", front.alias("front"), "r.back_bullets", "r.source_section", "lecture", "module")
