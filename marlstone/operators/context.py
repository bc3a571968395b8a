"""From ranked hits to a cited, budgeted prompt. Hits are ``query_id, rank, chunk_id, document, page, heading, text, score, entities``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import is_descendant, section_number, xml_escape

_EMPTY = "<context>\n</context>"


def _ranked():
    return Window.partitionBy("query_id").orderBy("rank")


def score_filter(hits: DataFrame, least: float = 0.0) -> DataFrame:
    return hits if least <= 0 else hits.where(F.col("score") >= least)


def distinct_chunks(hits: DataFrame) -> DataFrame:
    """The best hit of each chunk."""
    nth = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))
    return hits.withColumn("__n", nth).where("__n = 1").drop("__n")


def _union(arrays: Column) -> Column:
    return F.array_distinct(F.flatten(arrays))


#: What a hit may carry besides; of merged hits the first one that has it counts.
CARRIED = ("document_id", "module", "section_id")
_COLS = ["rank", "chunk_id", "document", "page", "heading", "score", "text", "entities"]


def _carried(hits: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in hits.columns]


def _field(name: str):
    return lambda x: x[name]


def _first_known(values: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(values, lambda x: F.coalesce(x.cast("string"), F.lit("")) != ""), F.lit(1)), F.try_element_at(values, F.lit(1)))


def merge_adjacent(hits: DataFrame) -> DataFrame:
    """Neighbours in rank with one document and heading and consecutive pages become one hit, with the first one's ids and score."""
    same = (F.lag("document").over(_ranked()) == F.col("document")) & (F.lag("heading").over(_ranked()) == F.col("heading")) & (F.lag("page").over(_ranked()) + 1 == F.col("page"))
    island = F.sum(F.when(same, 0).otherwise(1)).over(_ranked().rowsBetween(Window.unboundedPreceding, 0))
    more = _carried(hits)
    parts = F.sort_array(F.collect_list(F.struct(*_COLS, *more)))
    got = hits.withColumn("__island", island).groupBy("query_id", "__island").agg(parts.alias("p"))
    first = [F.element_at("p", 1)[c].alias(c) for c in _COLS[:6]]
    rest = [_first_known(F.transform("p", _field(c))).alias(c) for c in more]
    return got.select("query_id", *first, F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), _union(F.transform("p", lambda x: x["entities"])).alias("entities"), *rest)


def merge_hierarchical(hits: DataFrame) -> DataFrame:
    """A hit below the section of the group's first hit, in the same document, joins the group: least page, best score, all entities.

    The comparison is with the leader of the group, so this is a fold over a query's few ranked hits.
    """
    more = _carried(hits)
    rows = F.sort_array(F.collect_list(F.struct(*_COLS, *more, section_number("heading").alias("num"))))
    own = hits.groupBy("query_id").agg(rows.alias("rows"))

    def step(groups: Column, x: Column) -> Column:
        lead = F.try_element_at(groups, F.lit(-1))
        joins = F.coalesce((lead["document"] == x["document"]) & is_descendant(x["num"], lead["num"]), F.lit(False))
        page = F.when((lead["page"] > 0) & (x["page"] > 0), F.least(lead["page"], x["page"])).otherwise(F.greatest(lead["page"], x["page"]))
        rest = [_first_known(F.array(lead[c], x[c])).alias(c) for c in more]
        merged = F.struct(lead["rank"].alias("rank"), lead["chunk_id"].alias("chunk_id"), lead["document"].alias("document"), page.alias("page"), lead["heading"].alias("heading"), F.greatest(lead["score"], x["score"]).alias("score"), F.concat(lead["text"], F.lit("\n\n"), x["text"]).alias("text"), F.array_distinct(F.concat(lead["entities"], x["entities"])).alias("entities"), *rest, lead["num"].alias("num"))
        return F.when(joins, F.concat(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(groups, F.array(x)))

    groups = F.aggregate("rows", F.slice("rows", 1, 0), step)
    return own.select("query_id", F.explode(groups).alias("g")).select("query_id", *[F.col(f"g.{c}").alias(c) for c in [*_COLS, *more]])


def blocks(hits: DataFrame) -> DataFrame:
    """Context blocks with their index from 1 and their rendered text."""
    out = hits.withColumn("index", F.row_number().over(_ranked()))
    e = lambda c: xml_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    lines = [
        F.concat(F.lit('<context_block index="'), "index", F.lit('" id="'), e("chunk_id"), F.lit('">')),
        F.concat(F.lit("<chunk_id>"), e("chunk_id"), F.lit("</chunk_id>")),
        F.concat(F.lit("<document>"), e("document"), F.lit("</document>")),
        F.lit("<document_id></document_id>") if "document_id" not in hits.columns else F.concat(F.lit("<document_id>"), e("document_id"), F.lit("</document_id>")),
        F.concat(F.lit("<section>"), e("heading"), F.lit("</section>")),
        F.concat(F.lit("<section_id>"), xml_escape(F.coalesce(F.when(F.col("section_id") != "", F.col("section_id").cast("string")), F.col("chunk_id").cast("string"))) if "section_id" in hits.columns else e("chunk_id"), F.lit("</section_id>")),
        F.concat(F.lit("<module>"), e("module") if "module" in hits.columns else F.lit(""), F.lit("</module>")),
        F.concat(F.lit("<page>"), F.col("page").cast("string"), F.lit("</page>")),
        # Hits end on the page where they start, as far as a retriever knows.
        F.concat(F.lit("<page_end>"), e("page_end"), F.lit("</page_end>")) if "page_end" in hits.columns else F.lit("<page_end></page_end>"),
        F.concat(F.lit("<entities>"), xml_escape(F.array_join("entities", ", ")), F.lit("</entities>")),
        F.concat(F.lit("<text>\n"), e("text"), F.lit("\n</text>")),
        F.lit("</context_block>"),
    ]
    return out.withColumn("block", F.concat_ws("\n", *lines))


def within_budget(rendered: DataFrame, max_tokens: int) -> DataFrame:
    """The longest row of first blocks whose context has at most so many tokens (a quarter of its characters)."""
    used = F.sum(F.length("block") + 1).over(_ranked().rowsBetween(Window.unboundedPreceding, 0)) + len(_EMPTY)
    return rendered.withColumn("__used", used).where(F.floor(F.col("__used") / 4) <= max_tokens).drop("__used")


def context_xml(queries: DataFrame, rendered: DataFrame) -> DataFrame:
    """query_id, context; queries without blocks have an empty context."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "block"))), lambda x: x["block"]), "\n")
    got = rendered.groupBy("query_id").agg(text.alias("t"))
    return queries.select("query_id").join(got, "query_id", "left").select("query_id", F.when(F.col("t").isNull(), _EMPTY).otherwise(F.concat(F.lit("<context>\n"), "t", F.lit("\n</context>"))).alias("context"))


def citations(rendered: DataFrame) -> DataFrame:
    """The first citation of each (document, section, page), in order."""
    nth = F.row_number().over(Window.partitionBy("query_id", "document", "heading", "page").orderBy("index"))
    return rendered.withColumn("__n", nth).where("__n = 1").select("query_id", "index", "document", F.col("heading").alias("section"), "page", "score")


def assemble(hits: DataFrame, least: float = 0.0) -> DataFrame:
    return blocks(merge_hierarchical(merge_adjacent(distinct_chunks(score_filter(hits, least)))))


# Prompts -----------------------------------------------------------------------------------------------------------------

SYSTEM_INTRO = "You answer questions about a document collection."
ANSWER_POLICY = "Answer from the supplied context only, say so when it does not suffice, and cite (Document, Section, Page)."
MODES = {
    "concise": "\n\nAnswer Mode: Concise\nGive two to five sentences with inline citations.",
    "detailed": "\n\nAnswer Mode: Detailed\nExplain step by step with inline citations.",
    "expert": "\n\nAnswer Mode: Expert\nGive all technical details, notes and cross-references with inline citations.",
}


def system_prompt(mode: str, intro: str = SYSTEM_INTRO, policy: str = ANSWER_POLICY) -> str:
    """``benchmark`` gets the introduction alone, any other mode the policy as well."""
    return intro if mode == "benchmark" else f"{intro}\n\n{policy}"


def prompts(queries: DataFrame, contexts: DataFrame, date: Column | None = None, mode: str = "strict") -> DataFrame:
    """query_id, prompt (context and question) and estimated_tokens of the full text with date and system prompt."""
    day = F.date_format(F.current_date(), "yyyy-MM-dd") if date is None else date
    own = queries.join(contexts, "query_id")
    question = F.trim("question")
    full = F.concat_ws("\n\n", F.concat(F.lit("Date: "), day), F.lit(system_prompt(mode)), "context", F.lit("User Question\n-------------"), question)
    n = F.length(full)
    return own.select("query_id", F.concat_ws("\n\n", "context", question).alias("prompt"), F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).alias("estimated_tokens"))


def final_prompt(made: DataFrame, mode: Column) -> DataFrame:
    """The prompt with its mode's instruction; an unknown mode is concise."""
    text = F.lit(MODES["concise"])
    for name in ("detailed", "expert"):
        text = F.when(mode == name, F.lit(MODES[name])).otherwise(text)
    return made.select("query_id", F.concat("prompt", text).alias("prompt"))


def plain_prompt(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """The plain-text form: numbered sources, then the question."""
    one = F.concat(F.lit("\n[Source "), "rank", F.lit("]\nDocument: "), "document", F.lit("\nPage: "), F.col("page").cast("string"), F.lit("\nSection: "), "heading", F.lit("\nText:\n"), F.trim("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", one.alias("t")))), lambda x: x["t"]), "\n")
    got = hits.groupBy("query_id").agg(text.alias("t"))
    own = queries.join(got, "query_id", "left")
    return own.select("query_id", F.concat_ws("\n", F.lit(SYSTEM_INTRO), F.lit("\n----------------\nRetrieved Context\n----------------"), F.coalesce("t", F.lit("No context retrieved.")), F.lit("\n----------------\nUser Question\n----------------"), F.trim("question")).alias("prompt"))
