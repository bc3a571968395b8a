"""Structure of documents: headings, sections, references, tables, entities and modules, all with windows over the document order.

Inputs are blocks with ids (``parsing.with_block_ids``). Windows are partitioned by document, so one document is one task's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import paragraphs, word_count

from .parsing import document_order, split_paragraphs, with_block_ids

# Fixed values ----------------------------------------------------------------------------------------------------------

#: Cross-reference patterns in scan order, all case-insensitive: (pattern, groups, type).
REFERENCE_PATTERNS = [
    (r"See\s+(Chapter|Section|Appendix)\s+(\d+(?:\.\d+)*)", 2, "cross_ref"),
    (r"Refer\s+to\s+([A-Z][A-Z_0-9]+)", 1, "entity_ref"),
    (r"(?:see|refer to)\s+(Chapter|Section)\s+(\d+(?:\.\d+)*)", 2, "cross_ref"),
    (r"Refer\s+Chapter\s+(\d+(?:\.\d+)*)", 1, "cross_ref"),
    (r"as\s+described\s+in\s+(Chapter|Section)\s+(\d+(?:\.\d+)*)", 2, "cross_ref"),
    (r"For\s+more\s+information.*?(?:Chapter|Section)\s+(\d+(?:\.\d+)*)", 1, "cross_ref"),
    (r"(?:'s\s*interface|'s\s*module|'s\s*functionality)\s+(?:is\s+)?(?:explained|described|covered)\s+in\s+(Chapter|Section)\s+(\d+(?:\.\d+)*)", 2, "cross_ref"),
    (r"[A-Z]{2,}_[A-Z0-9_]+(?:-[A-Z0-9_]+)*", 0, "entity_ref"),
    (r"Appendix\s+([A-Z])", 1, "appendix_ref"),
    (r"Table\s+(\d+(?:\.\d+)*)", 1, "table_ref"),
    (r"Figure\s+(\d+(?:\.\d+)*)", 1, "figure_ref"),
]

#: Modules in tie order with the keywords that speak for them.
MODULE_KEYWORDS = [
    ("CASA", ["Current Accounts", "Savings Accounts", "CASA"]),
    ("Loans", ["Loans", "Lending", "CL", "Consumer Lending"]),
    ("Treasury", ["Treasury", "Money Market", "Foreign Exchange", "FX", "Derivatives"]),
    ("Trade Finance", ["Letters of Credit", "Trade Finance", "Bills", "Collections"]),
    ("Islamic Banking", ["Islamic", "Mudarabah", "Murabaha", "Ijara"]),
    ("Payments", ["Payments", "Funds Transfer", "SWIFT", "RTGS"]),
    ("Core", ["Core Services", "Security Management", "User Guide", "Installation"]),
]

#: Names that are entities wherever they stand: (name, type).
NAMED_ENTITIES = [("CASA", "MODULE"), ("EOD", "PROCESS"), ("BOD", "PROCESS"), ("GL", "MODULE"), ("CIF", "MODULE"), ("ICCF", "MODULE")]

#: Delimiters of text tables in the order in which they are tried.
TABLE_DELIMITERS = [r"\s{2,}", r"\t", r"\|"]


# Headings --------------------------------------------------------------------------------------------------------------


def _in_order():
    return Window.partitionBy("document_id").orderBy("ord")


def headings(blocks: DataFrame) -> DataFrame:
    """Heading blocks with ord (from 1, in document order), title, hierarchical number, parent and path, whatever their depth.

    A counter of level k starts again after every heading of a smaller level; the parent is the nearest heading before with a smaller
    level. Headings of a document come to one task in their order and pass a stack, which holds one heading for each level at most.
    """
    own = with_block_ids(blocks).where("type = 'heading' AND level IS NOT NULL").withColumn("title", F.array_join(paragraphs("text"), " "))
    own = own.select("document_id", "block_id", "page", "block_index", "level", "title")
    more = pa.schema([("ord", pa.int32()), ("number", pa.string()), ("parent_ord", pa.int32()), ("path", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, stack, counters, nth = None, [], [], 0
        for b in batches:
            rows = []
            for doc, level, title in zip(*(b[c].to_pylist() for c in ("document_id", "level", "title")), strict=True):
                if doc != document or not nth:
                    document, stack, counters, nth = doc, [], [], 0
                nth += 1
                level = max(level, 1)
                while stack and stack[-1][0] >= level:
                    stack.pop()
                counters = [*counters[:level], *[0] * (level - len(counters))]
                counters[level - 1] += 1
                up = stack[-1][1] if stack else None
                stack.append((level, nth, title))
                rows.append((nth, ".".join(map(str, counters)), up, [t for _, _, t in stack]))
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), more, strict=True)] if rows else [pa.array([], f.type) for f in more]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *more.names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.repartition("document_id").sortWithinPartitions("document_id", "page", "block_index").mapInArrow(run, f"{schema}, ord int, number string, parent_ord int, path array<string>")


def heading_paths(heads: DataFrame) -> DataFrame:
    """document_id, ord, block_id, path: titles from the root down."""
    return heads.select("document_id", "ord", "block_id", "path")


def toc_with_fallback(toc: DataFrame, blocks: DataFrame) -> DataFrame:
    """document_id, ord, level, title, page: the given contents, or the headings where a document has none."""
    made = headings(blocks).select("document_id", "ord", "level", "title", "page")
    return toc.select("document_id", "ord", "level", "title", "page").unionByName(made.join(toc.select("document_id").distinct(), "document_id", "left_anti"))


def toc_depth(toc: DataFrame) -> DataFrame:
    return toc.groupBy("document_id").agg(F.coalesce(F.max("level"), F.lit(0)).alias("depth"), F.count(F.lit(1)).alias("entries"), F.count_if(F.col("level") == 2).alias("entries_2"))


# Sections --------------------------------------------------------------------------------------------------------------


def block_sections(blocks: DataFrame) -> DataFrame:
    """Blocks with the ordinal of the section they lie in; those before the first heading have 0, and lie in none."""
    head = (F.col("type") == "heading") & F.col("level").isNotNull()
    return with_block_ids(blocks).withColumn("section_ord", F.sum(head.cast("int")).over(document_order().rowsBetween(Window.unboundedPreceding, 0)))


def sections(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """A section for each heading, or one with number 1 for a document without any.

    ``titles(document_id, title, page_count)`` names the default sections and ends the last ones. A section ends on the page before the
    next one starts, but not before its own start; its words are those of its blocks, the heading's included.
    """
    heads = headings(blocks).join(titles.select("document_id", "page_count"), "document_id")
    after = F.lead("page").over(_in_order())
    made = heads.select("document_id", F.col("ord").alias("section_ord"), "title", "number", "level", "parent_ord", F.col("page").alias("page_start"), F.coalesce(F.greatest("page", after - 1), "page_count").alias("page_end"))
    words = word_count("text")
    got = block_sections(blocks).groupBy("document_id", "section_ord").agg(F.sum(words).alias("word_count"), F.count(F.lit(1)).alias("block_count"))
    made = made.join(got, ["document_id", "section_ord"])
    whole = with_block_ids(blocks).groupBy("document_id").agg(F.sum(words).alias("word_count"), F.count(F.lit(1)).alias("block_count"))
    bare = whole.join(heads.select("document_id").distinct(), "document_id", "left_anti").join(titles, "document_id")
    none = F.lit(None).cast("int")
    bare = bare.select("document_id", F.lit(1).alias("section_ord"), "title", F.lit("1").alias("number"), F.lit(1).alias("level"), none.alias("parent_ord"), F.lit(1).alias("page_start"), F.col("page_count").alias("page_end"), "word_count", "block_count")
    both = made.unionByName(bare)
    sec = lambda c: F.concat("document_id", F.lit(":sec:"), c)
    return both.select(sec("section_ord").alias("section_id"), "document_id", "section_ord", "title", "number", "level", F.when(F.col("parent_ord").isNotNull(), sec("parent_ord")).alias("parent_id"), "page_start", "page_end", "word_count", "block_count")


def section_children(found: DataFrame) -> DataFrame:
    """parent_id, child_ids: in order."""
    kids = F.transform(F.sort_array(F.collect_list(F.struct("section_ord", "section_id"))), lambda x: x["section_id"])
    return found.where("parent_id IS NOT NULL").groupBy("parent_id").agg(kids.alias("child_ids"))


def enriched_blocks(blocks: DataFrame, inherit: bool = False) -> DataFrame:
    """block_id, section_id, heading_path, depth. Only headings have a path, unless other blocks ``inherit`` their section's."""
    own = block_sections(blocks)
    paths = heading_paths(headings(blocks))
    got = own.join(paths.select("document_id", F.col("ord").alias("section_ord"), F.col("block_id").alias("__head"), "path"), ["document_id", "section_ord"], "left")
    held = F.col("path") if inherit else F.when(F.col("block_id") == F.col("__head"), F.col("path"))
    path = F.coalesce(held, F.array().cast("array<string>"))
    section = F.when(F.col("section_ord") > 0, F.concat("document_id", F.lit(":sec:"), "section_ord"))
    return got.select("document_id", "block_id", section.alias("section_id"), path.alias("heading_path"), F.size(path).alias("depth"))


# References and tables ---------------------------------------------------------------------------------------------------


def references(blocks: DataFrame) -> DataFrame:
    """Cross-references in scan order (page, block, paragraph, pattern, match), the first of each (target, type, page) in a document."""
    paras = split_paragraphs(blocks)

    def matches(n: int, pattern: str, groups: int, kind: str):
        group = lambda g: F.regexp_extract_all("text", F.lit("(?i)" + pattern), F.lit(g))
        target = F.zip_with(group(1), group(2), lambda a, b: F.concat(a, F.lit(" "), b)) if groups == 2 else group(min(groups, 1))
        made = lambda x, i: F.struct(F.lit(n).alias("pattern"), i.alias("match"), x["whole"].alias("text"), F.trim(x["target"]).alias("target"), F.lit(kind).alias("type"))
        return F.transform(F.arrays_zip(group(0).alias("whole"), target.alias("target")), made)

    parts = [matches(n, *p) for n, p in enumerate(REFERENCE_PATTERNS)]
    found = paras.select("document_id", "page", "block_index", "paragraph", F.explode(F.concat(*parts)).alias("x")).select("document_id", "page", "block_index", "paragraph", "x.*")
    scan = ("page", "block_index", "paragraph", "pattern", "match")
    first = F.row_number().over(Window.partitionBy("document_id", "target", "type", "page").orderBy(*scan))
    kept = found.withColumn("__n", first).where("__n = 1").drop("__n")
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy(*scan))
    block = F.concat("document_id", F.lit(":p"), "page", F.lit(":b"), "block_index")
    return kept.select(F.concat("document_id", F.lit(":ref:"), nth).alias("id"), "document_id", "text", "target", "type", block.alias("source_block_id"), "page")


def _lines(text):
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def table_candidates(blocks: DataFrame) -> DataFrame:
    """Text blocks of two or more lines with, for each delimiter, how many lines there are and the commonest number of columns.

    Of equally common numbers the one that comes first counts.
    """
    text = F.trim(F.array_join(paragraphs("text"), "\n"))
    own = with_block_ids(blocks).where("type = 'text'").select("document_id", "block_id", "page", _lines(text).alias("lines")).where(F.size("lines") >= 2)
    each = own.select("document_id", "block_id", "page", "lines", F.posexplode(F.array(*map(F.lit, TABLE_DELIMITERS))).alias("d", "delimiter"))
    rows = each.select("document_id", "block_id", "page", F.size("lines").alias("n"), "d", F.posexplode(F.transform("lines", lambda x: F.when(F.col("d") == 0, F.size(F.split(x, TABLE_DELIMITERS[0]))).when(F.col("d") == 1, F.size(F.split(x, TABLE_DELIMITERS[1]))).otherwise(F.size(F.split(x, TABLE_DELIMITERS[2]))))).alias("line", "cols"))
    per = rows.groupBy("document_id", "block_id", "page", "n", "d", "cols").agg(F.count(F.lit(1)).alias("times"), F.min("line").alias("line"))
    best = F.row_number().over(Window.partitionBy("block_id", "d").orderBy(F.desc("times"), "line"))
    return per.withColumn("__k", best).where("__k = 1").drop("__k", "line")


def text_tables(blocks: DataFrame, share: float = 0.6) -> DataFrame:
    """Text blocks that are tables: header line, columns and rows. A parse always cuts at two or more blanks and drops empty cells."""
    likely = table_candidates(blocks).where((F.col("times") / F.col("n") >= share) & (F.col("cols") >= 2)).select("block_id").distinct()
    text = F.trim(F.array_join(paragraphs("text"), "\n"))
    own = with_block_ids(blocks).where("type = 'text'").join(likely, "block_id", "left_semi")
    cells = F.transform(_lines(text), lambda x: F.filter(F.transform(F.split(x, r"\s{2,}"), lambda c: F.trim(c)), lambda c: c != ""))
    got = own.select("document_id", "block_id", "page", "block_index", cells.alias("cells")).where(F.size("cells") >= 2)
    nth = F.row_number().over(document_order())
    head = F.col("cells")[0]
    return got.select(F.concat("document_id", F.lit(":tbl:"), nth).alias("id"), "document_id", F.col("block_id").alias("source_block_id"), "page", head.alias("headers"), F.slice("cells", F.lit(2), F.size("cells") - 1).alias("rows"), (F.size("cells") - 1).alias("num_rows"), F.size(head).alias("num_cols"))


def explicit_tables(blocks: DataFrame) -> DataFrame:
    """The tables of ``blocks`` of type ``table`` that carry one (``table struct<title, headers, rows>``): headers, rows and their numbers.

    A table without headers is as wide as its first row.
    """
    own = with_block_ids(blocks).where("type = 'table' AND table IS NOT NULL")
    heads, rows = F.coalesce("table.headers", F.array().cast("array<string>")), F.coalesce("table.rows", F.array().cast("array<array<string>>"))
    wide = F.when(F.size(heads) > 0, F.size(heads)).otherwise(F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0)))
    return own.select("document_id", "page", "block_index", F.col("block_id").alias("source_block_id"), F.col("table.title").alias("title"), heads.alias("headers"), rows.alias("rows"), F.size(rows).alias("num_rows"), F.greatest(wide, F.lit(0)).alias("num_cols"))


def tables(blocks: DataFrame) -> DataFrame:
    """Explicit tables and text tables of a document, numbered together in its order."""
    found = text_tables(blocks).drop("id").withColumn("title", F.lit(None).cast("string"))
    at = with_block_ids(blocks).select(F.col("block_id").alias("source_block_id"), "block_index")
    if "table" in blocks.columns:
        found = found.join(at, "source_block_id").unionByName(explicit_tables(blocks))
    else:
        found = found.join(at, "source_block_id")
    nth = F.row_number().over(document_order())
    return found.select(F.concat("document_id", F.lit(":tbl:"), nth).alias("id"), "document_id", "source_block_id", "page", "title", "headers", "rows", "num_rows", "num_cols")


# Dictionaries -------------------------------------------------------------------------------------------------------------

#: Bytes of terms up to which a dictionary is sent to the tasks.
DICTIONARY_BYTES = 64 << 20


def dictionary_hits(texts: DataFrame, terms: Sequence[str], word_bounds: bool = True, column: str = "text", ignore_case: bool = False) -> DataFrame:
    """``texts`` and ``hits``, the distinct terms that the text holds, as positions in ``terms``, in ascending order.

    An automaton over all terms reads each text once, however many terms there are. With ``word_bounds`` a term counts where no word
    character (of any script) comes directly before or after it, at ends that are word characters, as in a search for ``\\bterm\\b``.
    The dictionary is broadcast, and must have at most DICTIONARY_BYTES. A null text has no hits.
    """
    size = sum(len(t.encode()) for t in terms)
    if size > DICTIONARY_BYTES:
        raise ValueError(f"the dictionary has {size} bytes; at most {DICTIONARY_BYTES} can be sent to the tasks")
    held = texts.sparkSession.sparkContext.broadcast(list(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, word = ahocorasick.Automaton(), re.compile(r"\w")
        places: dict[str, list[int]] = {}
        for i, t in enumerate(held.value):
            if t:
                places.setdefault(t.lower() if ignore_case else t, []).append(i)
        for t, at in places.items():
            automaton.add_word(t, (len(t), at))
        if places:
            automaton.make_automaton()

        def bounded(text: str, start: int, end: int) -> bool:
            """Whether both ends lie where a word character meets another, or the text's end."""
            left = bool(start and word.match(text[start - 1])) != bool(word.match(text[start]))
            return left and bool(word.match(text[end - 1])) != bool(end < len(text) and word.match(text[end]))

        for b in batches:
            out = []
            for text in b[column].to_pylist():
                text = (text or "").lower() if ignore_case else text or ""
                found: set[int] = set()
                for last, (n, at) in automaton.iter(text) if places and text else ():
                    if at[0] not in found and (not word_bounds or bounded(text, last + 1 - n, last + 1)):
                        found.update(at)
                out.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "hits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(run, f"{schema}, hits array<int>")


# Entities and modules ------------------------------------------------------------------------------------------------------


def named_entities(blocks: DataFrame, names: Sequence[tuple[str, str]] = NAMED_ENTITIES) -> DataFrame:
    """Known names with word bounds, the first mention on each page: name, type, page, context (the first 200 characters around)."""
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("entity_type")) for n, t in names]) if len(names) <= 100 else None
    met = dictionary_hits(split_paragraphs(blocks), [n for n, _ in names])
    each = met.where(F.size("hits") > 0).select("document_id", "page", "block_index", "paragraph", "text", F.explode("hits").alias("at"))
    if known is not None:
        found = each.withColumn("x", F.get(known, F.col("at")))
    else:
        table = blocks.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(names)], "at int, name string, entity_type string")
        found = each.join(table, "at").withColumn("x", F.struct("name", "entity_type"))
    nth = F.row_number().over(Window.partitionBy("document_id", "x.name", "page").orderBy("block_index", "paragraph"))
    return found.withColumn("__n", nth).where("__n = 1").select("document_id", "x.name", "x.entity_type", "page", F.substring("text", 1, 200).alias("context"))


def pattern_entities(blocks: DataFrame) -> DataFrame:
    """Upper-case identifiers: 4 to 20 characters with a letter, and an underscore or 6 to 8 characters; a row for each mention."""
    paras = split_paragraphs(blocks)
    found = paras.select("document_id", "page", "block_index", "paragraph", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b([A-Z0-9_]{4,20})\b"), F.lit(1))).alias("k", "name"))
    letter = F.col("name").rlike("[A-Z]")
    return found.where(letter & (F.contains("name", F.lit("_")) | F.length("name").between(6, 8))).select("document_id", "page", "block_index", "paragraph", "k", "name", F.lit("MODULE/SCREEN").alias("entity_type"))


def classify_modules(documents: DataFrame, keywords: Sequence[tuple[str, Sequence[str]]] = MODULE_KEYWORDS) -> DataFrame:
    """document_id, module, hits of ``documents(document_id, text)``: the module with the most keywords found as parts of the text."""
    flat = [(k, i) for i, (_, ks) in enumerate(keywords) for k in ks]
    met = dictionary_hits(documents.select("document_id", "text"), [k for k, _ in flat], word_bounds=False, ignore_case=True).select("document_id", "hits")
    owner = F.array(*[F.lit(i) for _, i in flat])
    owners = F.transform("hits", lambda h: F.get(owner, h))
    count_of = lambda i: F.size(F.filter(owners, lambda o: o == i))
    counts = [F.struct(count_of(i).alias("hits"), F.lit(-i).alias("ord"), F.lit(m).alias("module")) for i, (m, _) in enumerate(keywords)]
    best = met.select("document_id", F.array_max(F.array(*counts)).alias("x"))
    return best.select("document_id", F.when(F.col("x.hits") > 0, F.col("x.module")).otherwise("Unknown").alias("module"), F.col("x.hits").alias("hits"))


def classified_texts(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """document_id, text that a module is found in: the filename, the title (null: none) and the first pages of ``files(document_id, filename, title)``."""
    own = files.select("document_id", F.concat_ws(" ", "filename", F.coalesce("title", F.lit(""))).alias("__head"))
    return own.join(first_pages(blocks), "document_id", "left").select("document_id", F.concat_ws(" ", "__head", F.coalesce("text", F.lit(""))).alias("text"))


def first_pages(blocks: DataFrame, pages: int = 3) -> DataFrame:
    """document_id, text: the paragraphs of the first pages, joined by blanks."""
    each = split_paragraphs(blocks).where(F.col("page") <= pages)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "block_index", "paragraph", "text"))), lambda x: x["text"]), " ")
    return each.groupBy("document_id").agg(text.alias("text"))
