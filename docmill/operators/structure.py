"""Lines, outline, terms, references, exhibits and clauses of documents.

Everything about one document is computed inside its row with array functions and exploded last, so none of these
operators shuffles, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import editing, fixed
from docmill.functions.rules import Rules, first_match
from docmill.functions.text import strip
from docmill.operators.tasks import map_rows


def lines_of(text: Column) -> Column:
    """All lines of a text; a break at the very end begins one more, empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, line_no`` (from 1), ``line``, and whether it is ``blank``."""
    out = docs.select("doc_id", F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))
    return out.select("doc_id", (F.col("line_no") + 1).alias("line_no"), "line", (strip(F.col("line")) == "").alias("blank"))


def numbered(text: Column) -> Column:
    """``array<struct<line, text>>`` of the lines that are not blank, stripped."""
    every = F.transform(lines_of(text), lambda x, i: F.struct((i + 1).alias("line"), strip(x).alias("text")))
    return F.filter(every, lambda x: x["text"] != "")


def is_article(x: Column) -> Column:
    return x.rlike(fixed.ARTICLE) & (F.length(x) < fixed.SHORT_HEADER)


def is_chapter(x: Column) -> Column:
    return x.rlike(fixed.CHAPTER)


def is_heading(x: Column) -> Column:
    return x.rlike(fixed.HEADING)


def boundary(x: Column) -> Column:
    """Whether a stripped line begins a clause."""
    return is_article(x) | is_chapter(x) | x.rlike(fixed.EXHIBIT_START)


def _explode(rows: DataFrame, column: str) -> DataFrame:
    """``doc_id`` and the fields of each element of ``column``.

    What is exploded is an expression: of a bare column Spark would infer a filter on its size, push that below all
    that makes the column, and so make it again, for each element once more.
    """
    return rows.select("doc_id", F.explode(F.transform(column, lambda x: x)).alias("x")).select("doc_id", "x.*")


def with_outline(docs: DataFrame, text: str = "text", name: str = "_outline") -> DataFrame:
    """``docs`` with the array of ``line, level, text, section`` of the headings (no section), chapters by their own
    number, and articles by a running number that chapters use up as well."""
    body = docs.withColumn("_lines", numbered(F.col(text)))
    others = F.filter("_lines", lambda x: ~is_heading(x["text"]) & (is_chapter(x["text"]) | is_article(x["text"])))
    heads = F.transform(
        F.filter("_lines", lambda x: is_heading(x["text"])),
        lambda x: F.struct(x["line"].alias("line"), F.length(F.regexp_extract(x["text"], fixed.HEADING, 1)).alias("level"), F.regexp_extract(x["text"], fixed.HEADING, 2).alias("text"), F.lit(None).cast("string").alias("section")),
    )

    def entry(x, i):
        chapter = F.regexp_extract(x["text"], fixed.CHAPTER, 1)
        is_one = is_chapter(x["text"])
        return F.struct(
            x["line"].alias("line"),
            F.when(is_one, 1).otherwise(2).alias("level"),
            F.when(is_one, F.concat(F.lit("제"), chapter, F.lit("장 "), F.regexp_extract(x["text"], fixed.CHAPTER, 2))).otherwise(F.regexp_extract(x["text"], fixed.ARTICLE, 1)).alias("text"),
            F.when(is_one, F.concat(F.lit("ch"), chapter)).otherwise(F.concat(F.lit("art"), (i + 1).cast("string"))).alias("section"),
        )

    return body.withColumn(name, F.array_sort(F.concat(heads, F.transform(others, entry)))).drop("_lines")


def outline(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, line, level, text, section``: see ``with_outline``."""
    return _explode(with_outline(docs.select("doc_id", text), text), "_outline")


def _prose(text: Column) -> Column:
    """Lines that may hold terms, references and exhibits: all but headings and chapters."""
    return F.filter(numbered(text), lambda x: ~is_heading(x["text"]) & ~is_chapter(x["text"]))


def _found(text: Column, pattern: str, group: int) -> Column:
    each = F.transform(_prose(text), lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(pattern), group), lambda t: F.struct(x["line"].alias("line"), t.alias("found"))))
    return F.flatten(each)


def with_terms(docs: DataFrame, text: str = "text", pattern: str = fixed.TERM, name: str = "_terms") -> DataFrame:
    """``docs`` with the array of ``term, first_line`` of quoted terms, in the order in which they first occur.

    The terms found are sorted with their place, and each one's first is kept: n log n for n of them in a document.
    """
    placed = F.transform(_found(F.col(text), pattern, 1), lambda x, i: F.struct(x["found"].alias("term"), i.alias("place"), x["line"].alias("line")))
    rows = docs.withColumn("_sorted", F.array_sort(placed))
    first = F.filter("_sorted", lambda x, i: (i == 0) | (F.get(F.col("_sorted"), i - 1)["term"] != x["term"]))
    ordered = F.array_sort(F.transform(first, lambda x: F.struct(x["place"].alias("place"), x["term"].alias("term"), x["line"].alias("first_line"))))
    return rows.withColumn(name, F.transform(ordered, lambda x: F.struct(x["term"].alias("term"), x["first_line"].alias("first_line")))).drop("_sorted")


def defined_terms(docs: DataFrame, text: str = "text", pattern: str = fixed.TERM) -> DataFrame:
    """``doc_id, term, first_line``: quoted terms where they first occur; ``fixed.TERM_CURLY`` also takes curly quotes."""
    return _explode(with_terms(docs.select("doc_id", text), text, pattern), "_terms")


def crossrefs(docs: DataFrame, text: str = "text", pattern: str = fixed.REFERENCE) -> DataFrame:
    """``doc_id, from_line, ref``: every mention of an article."""
    found = docs.select("doc_id", F.explode(_found(F.col(text), pattern, 0)).alias("f"))
    return found.select("doc_id", F.col("f.line").alias("from_line"), F.col("f.found").alias("ref"))


def exhibit_array(text: Column) -> Column:
    """``array<struct<line, label>>`` of the lines that open an exhibit."""

    def label(x):
        word, number = (F.regexp_extract(x["text"], fixed.EXHIBIT, i) for i in (1, 2))
        return F.struct(x["line"].alias("line"), F.when(number == "", word).otherwise(F.concat_ws(" ", word, number)).alias("label"))

    return F.transform(F.filter(_prose(text), lambda x: x["text"].rlike(fixed.EXHIBIT)), label)


def exhibits(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, line, label``: lines that open an exhibit."""
    return _explode(docs.select("doc_id", exhibit_array(F.col(text)).alias("_exhibits")), "_exhibits")


def resolve_refs(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """``refs`` (doc_id, from_line, ref) with the ``section`` of ``targets`` (doc_id, ref, section) and ``resolved``."""
    found = targets.select("doc_id", "ref", F.col("section").alias("to_section")).dropDuplicates(["doc_id", "ref"])
    return refs.join(found, ["doc_id", "ref"], "left").withColumn("resolved", F.col("to_section").isNotNull())


def with_segments(docs: DataFrame, text: str = "text", is_boundary=boundary, name: str = "_segments") -> DataFrame:
    """``docs`` with the array of ``clause_no, header, start_line, end_line, body``: from each boundary to the next, or
    the end.  Lines before the first boundary belong to no clause.  ``is_boundary`` takes a stripped line."""
    body = docs.withColumn("_l", lines_of(F.col(text)))
    stripped = F.transform("_l", lambda x, i: F.struct((i + 1).alias("line"), strip(x).alias("text")))
    cut = body.withColumn("_b", F.filter(stripped, lambda x: (x["text"] != "") & is_boundary(x["text"])))

    def clause(x, i):
        end = F.coalesce(F.get(F.col("_b"), i + 1)["line"] - 1, F.size("_l"))
        own = F.slice(F.col("_l"), x["line"], end - x["line"] + 1)
        return F.struct((i + 1).alias("clause_no"), x["text"].alias("header"), x["line"].alias("start_line"), end.alias("end_line"), strip(F.array_join(own, "\n")).alias("body"))

    return cut.withColumn(name, F.transform("_b", clause)).drop("_l", "_b")


def segments(docs: DataFrame, text: str = "text", is_boundary=boundary) -> DataFrame:
    """``doc_id, clause_no, header, start_line, end_line, body``: see ``with_segments``."""
    return _explode(with_segments(docs.select("doc_id", text), text, is_boundary), "_segments")


def clause_type(header: Column, body: Column, rules: Rules | None = None, governance=fixed.GOVERNANCE, chapter: str | None = fixed.CHAPTER_START) -> Column:
    """Chapters first, then governance, then the ordered rules over the header and the clause's first characters."""
    start = F.substring(body, 1, fixed.LOOK_AT)
    ordered = ([governance] if governance else []) + (fixed.CLAUSE_RULES if rules is None else rules)
    typed = first_match([header, start], ordered, fixed.NO_TYPE)
    return F.when(header.rlike(chapter), fixed.CHAPTER_TYPE).otherwise(typed) if chapter else typed


def clauses(docs: DataFrame, text: str = "text", is_boundary=boundary, **rules) -> DataFrame:
    """Clause records: ``doc_id, clause_id, header, start_line, end_line, clause_type, char_count, body``."""
    cut = segments(docs, text, is_boundary)
    kind = clause_type(F.col("header"), F.col("body"), **rules)
    return cut.select("doc_id", F.format_string("clause-%03d", "clause_no").alias("clause_id"), "header", "start_line", "end_line", kind.alias("clause_type"), F.length("body").alias("char_count"), "body")


def with_types(docs: DataFrame, text: str = "text", is_boundary=boundary, name: str = "_types", **rules) -> DataFrame:
    """``docs`` with the array of its clauses' types, without leaving the row."""
    cut = with_segments(docs, text, is_boundary, "_s")
    return cut.withColumn(name, F.transform("_s", lambda c: clause_type(c["header"], c["body"], **rules))).drop("_s")


def chunks(docs: DataFrame, most: int, text: str = "text") -> DataFrame:
    """``doc_id, chunk_no, start_line, end_line, body``: whole lines in pieces of about ``most`` characters, in order.

    A piece ends at the first line at which the document has reached the next multiple of ``most``.
    """
    rows = docs.select("doc_id", F.posexplode(lines_of(F.col(text))).alias("i", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("piece", F.floor(F.coalesce(before, F.lit(0)) / most))
    held = placed.groupBy("doc_id", "piece").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("own"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("piece"))
    return held.select("doc_id", number.alias("chunk_no"), (F.col("a") + 1).alias("start_line"), (F.col("b") + 1).alias("end_line"), F.array_join(F.transform("own", lambda x: x["line"]), "\n").alias("body"))


def numbering_gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Rows whose number does not follow the one before it in ``key``."""
    before = F.lag(number).over(Window.partitionBy(key).orderBy(number))
    return rows.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(number) - F.col("before") != 1))


def labels(text: Column, levels: list[tuple[int, str]] | None = None) -> Column:
    """``array<struct<line, level, number>>`` of the lines that begin with a number of their own: chapters, articles,
    paragraphs, items, by the first pattern that fits.  Digits in circles and letters of an alphabet count from 1."""
    own = fixed.LEVELS if levels is None else levels

    def entry(x):
        level, number = F.lit(None).cast("int"), F.lit(None).cast("long")
        for rank, pattern in reversed(own):
            found = F.regexp_extract(x["text"], pattern, 1)
            place = F.coalesce(found.try_cast("long"), *(F.nullif(F.position(found, F.lit(a)), F.lit(0)).cast("long") for a in fixed.ALPHABETS))
            level, number = F.when(found != "", rank).otherwise(level), F.when(found != "", place).otherwise(number)
        return F.struct(x["line"].alias("line"), level.alias("level"), number.alias("number"))

    return F.filter(F.transform(numbered(text), entry), lambda x: x["number"].isNotNull())


def numbering(docs: DataFrame, text: str = "text", levels: list[tuple[int, str]] | None = None) -> DataFrame:
    """``doc_id, line, level, number, before, kind`` of every numbered line of nested lists.

    ``before`` is the number of the last line of its level since any of a higher one, as on a stack from which a label takes
    off all that lies deeper.  ``kind`` is ``first`` (1, or it begins a list), ``next``, ``gap``, ``repeat`` (the same
    again), ``restart`` (1 again) or ``back``; a list that begins with another number than 1 is a ``gap``.
    """
    rows = docs.select("doc_id", F.explode(labels(F.col(text), levels)).alias("x")).select("doc_id", "x.*")
    ranks = sorted({rank for rank, _ in (fixed.LEVELS if levels is None else levels)})
    above = Window.partitionBy("doc_id").orderBy("line")
    list_no = F.lit(0).cast("long")
    for rank in ranks:
        list_no = F.when(F.col("level") == rank, F.count_if(F.col("level") < rank).over(above)).otherwise(list_no)
    rows = rows.withColumn("_list", list_no)
    before = F.lag("number").over(Window.partitionBy("doc_id", "level", "_list").orderBy("line"))
    n, b = F.col("number"), F.col("before")
    kind = (
        F.when(b.isNull() & (n == 1), "first").when(b.isNull(), "gap").when(n == b + 1, "next").when(n == b, "repeat").when(n == 1, "restart").when(n > b, "gap").otherwise("back")
    )
    return rows.withColumn("before", before).withColumn("kind", kind).drop("_list")


def numbering_fails(docs: DataFrame, text: str = "text", levels: list[tuple[int, str]] | None = None) -> DataFrame:
    """``doc_id, gaps``: how many numbered lines leave a gap, go back or repeat; restarts are none."""
    return numbering(docs, text, levels).where("kind in ('gap', 'back', 'repeat')").groupBy("doc_id").agg(F.count("*").alias("gaps"))


def label_array(every: Column) -> Column:
    """``array<struct<style, label, line>>``: what references can point at, both styles of numbering: articles by their
    number (or, where they have a title alone, by their place among those) and sections by their dotted number.  ``every``:
    the lines, from ``numbered``."""
    explicit = F.transform(F.filter(every, lambda x: x["text"].rlike(fixed.ARTICLE_NUMBER)), lambda x: F.struct(F.lit("article").alias("style"), F.regexp_extract(x["text"], fixed.ARTICLE_NUMBER, 1).alias("label"), x["line"].alias("line")))
    titled = F.transform(F.filter(every, lambda x: is_article(x["text"])), lambda x, i: F.struct(F.lit("article").alias("style"), (i + 1).cast("string").alias("label"), x["line"].alias("line")))
    dotted = F.transform(F.filter(every, lambda x: x["text"].rlike(fixed.SECTION_NUMBER)), lambda x: F.struct(F.lit("section").alias("style"), F.regexp_extract(x["text"], fixed.SECTION_NUMBER, 1).alias("label"), x["line"].alias("line")))
    return F.concat(F.when(F.size(explicit) > 0, explicit).otherwise(titled), dotted)


def reference_array(lines: Column) -> Column:
    """``array<struct<line, style, ref, first, last>>`` of every mention of an article or section in ``lines`` (from
    ``numbered``), ranges too."""

    def of(style: str, pattern: str) -> Column:
        every = lambda x: F.regexp_extract_all(F.regexp_replace(x["text"], fixed.OWN_NUMBER, ""), F.lit(pattern), F.lit(0))
        end = lambda r, n: F.regexp_extract(r["ref"], pattern, n)
        found = F.transform(lines, lambda x: F.transform(every(x), lambda t: F.struct(x["line"].alias("line"), t.alias("ref"))))
        return F.transform(F.flatten(found), lambda r: F.struct(r["line"].alias("line"), F.lit(style).alias("style"), r["ref"].alias("ref"), end(r, 1).alias("first"), F.when(end(r, 2) == "", end(r, 1)).otherwise(end(r, 2)).alias("last")))

    return F.array_sort(F.concat(*(of(*x) for x in fixed.REFERENCES)))


def reference_graph(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, from_line, from_label, ref, style, to_label, to_line, resolved, cyclic`` of every reference.

    The labels of a document are its own index, so nothing has to be given.  A range has a row for each label that it
    spans and the document has, and one for each of its ends that the document lacks; a reference that points nowhere is
    not ``resolved``.  ``from_label`` is that of the section in which it stands (null before the first).  ``cyclic``
    references are on a way that leads back to their own section.  All within a document's row; labels are looked up by
    halving (``editing.referred``), so a long document costs about its lines, not lines times references.
    """
    # lines are cut and stripped once, for they are a column that several expressions read
    rows = docs.select("doc_id", numbered(F.col(text)).alias("_l"))
    rows = rows.select("doc_id", label_array(F.col("_l")).alias("_labels"), reference_array(F.col("_l")).alias("_refs"))
    fields = "from_line", "from_label", "ref", "style", "to_label", "to_line", "cyclic"
    kind = "array<struct<from_line: int, from_label: string, ref: string, style: string, to_label: string, to_line: int, cyclic: boolean>>"
    out = map_rows(rows, lambda r: [dict(zip(fields, x, strict=True)) for x in editing.referred(r["_labels"], r["_refs"])], "_edges", kind, ["_labels", "_refs"], limit=32)
    out = out.select("doc_id", F.explode("_edges").alias("e")).select("doc_id", "e.*")
    return out.withColumn("resolved", F.col("to_line").isNotNull()).select("doc_id", "from_line", "from_label", "ref", "style", "to_label", "to_line", "resolved", "cyclic")


def term_edges(clauses: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, from_id, to_id``: clauses that use a term that another one of their document defines.

    ``clauses``: ``doc_id, clause_id, start_line, end_line, body``; ``terms``: ``doc_id, term, first_line``.  Both are
    gathered in the document's row, where the texts are.
    """
    own = clauses.groupBy("doc_id").agg(F.collect_list(F.struct("clause_id", "start_line", "end_line", "body")).alias("_c"))
    said = terms.groupBy("doc_id").agg(F.collect_list(F.struct("term", "first_line")).alias("_t"))
    home = lambda t: F.filter("_c", lambda c: t["first_line"].between(c["start_line"], c["end_line"]))
    users = lambda t: F.filter("_c", lambda c: F.contains(c["body"], t["term"]) & ~t["first_line"].between(c["start_line"], c["end_line"]))
    pairs = F.flatten(F.transform("_t", lambda t: F.flatten(F.transform(home(t), lambda h: F.transform(users(t), lambda u: F.struct(u["clause_id"].alias("from_id"), h["clause_id"].alias("to_id")))))))
    return own.join(said, "doc_id").select("doc_id", F.explode(F.array_distinct(pairs)).alias("e")).select("doc_id", "e.*")


def section_chunks(docs: DataFrame, most: int, text: str = "text", is_boundary=boundary) -> DataFrame:
    """``doc_id, chunk_no, start_line, end_line, part, sections, body``: whole sections packed into chunks of ``most``
    characters, in order.

    A section begins at each boundary; what comes before the first is one, too.  A chunk takes sections as long as they fit;
    a section of more than ``most`` is cut at lines and shares its chunks with no other (``part`` counts them from 1, and is
    null elsewhere); a line of more than ``most`` is a chunk.  ``sections`` are the chunk's headers, the context in which its
    text stands.  Line ends count.  Only lengths go to Python.
    """
    rows = docs.select("doc_id", lines_of(F.col(text)).alias("_l")).withColumn("_n", F.transform("_l", lambda x: F.length(x) + 1))
    begins = F.filter(F.transform("_l", lambda x, i: F.when((strip(x) != "") & is_boundary(strip(x)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_b", begins)
    kind = "array<struct<start: int, stop: int, part: int>>"
    cut = map_rows(rows.select("doc_id", "_l", "_b", "_n"), lambda r: [{"start": a, "stop": b, "part": p} for a, b, p in editing.packed(r["_n"], r["_b"], most)], "_cut", kind, ["_n"])
    each = F.transform("_cut", lambda c, i: F.struct(
        (i + 1).alias("chunk_no"), (c["start"] + 1).alias("start_line"), c["stop"].alias("end_line"), c["part"].alias("part"),
        F.transform(F.filter("_b", lambda b: (b < c["stop"]) & (b >= F.coalesce(F.array_max(F.filter("_b", lambda x: x <= c["start"])), c["start"]))), lambda b: strip(F.get(F.col("_l"), b))).alias("sections"),
        F.array_join(F.slice(F.col("_l"), c["start"] + 1, c["stop"] - c["start"]), "\n").alias("body"),
    ))
    return cut.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")
