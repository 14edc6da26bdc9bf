"""Citations of search results, legal chains, contexts, prompts, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import first_match

# Labels and lengths of citations, contexts and reports.
CHAIN = [("act", "Act"), ("rule", "Rule"), ("go", "GO")]
EXCERPT, CONTEXT_EXCERPT, FULL_TEXT, CONTEXT_ROWS, DEFAULT_SCORE = 500, 300, 1000, 5, 0.8
LEGAL_HEAD, DATA_HEAD = "### Legal Framework:", "### Statistical Data:"
CONTEXT_LEAD = "Based on the following documents from the Andhra Pradesh education policy database:"
NO_CITATIONS = "No citations provided - response may be unreliable"


def legal_citations(docs: DataFrame) -> DataFrame:
    """``doc_id, title, doc_type, excerpt, confidence`` of legal documents (doc_id, title, doc_type, text, score)."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")).alias("doc_id"),
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("doc_type", F.lit("go")).alias("doc_type"),
        F.substring(F.coalesce("text", F.lit("")), 1, EXCERPT).alias("excerpt"),
        F.coalesce("score", F.lit(DEFAULT_SCORE)).alias("confidence"),
    )


def data_citations(facts: DataFrame) -> DataFrame:
    """The same of data points (fact_id, source_document, indicator, value, year, score)."""
    said = lambda c: F.coalesce(c, F.lit("N/A"))
    excerpt = F.concat(said(F.col("indicator")), F.lit(": "), said(F.format_string("%.2f", "value")), F.lit(" ("), said(F.col("year").cast("string")), F.lit(")"))
    return facts.select(
        F.coalesce("fact_id", F.lit("unknown")).alias("doc_id"), F.coalesce("source_document", F.lit("Unknown Source")).alias("title"), F.lit("statistics").alias("doc_type"), excerpt.alias("excerpt"), F.coalesce("score", F.lit(DEFAULT_SCORE)).alias("confidence")
    )


def chain(docs: DataFrame, answer: str) -> DataFrame:
    """``answer, chain``: the last title of each type of an answer's documents (answer, ord, doc_type, title), acts first."""
    last = first_match(docs.where(F.col("doc_type").isin([k for k, _ in CHAIN])), [answer, "doc_type"], [F.desc("ord")])
    of = lambda kind, label: F.max(F.when(F.col("doc_type") == kind, F.concat(F.lit(f"{label}: "), F.coalesce("title", F.lit("Unknown")))))
    named = last.groupBy(answer).agg(*[of(k, n).alias(k) for k, n in CHAIN])
    return named.select(answer, F.concat_ws(" → ", *[k for k, _ in CHAIN]).alias("chain"))


def result_citations(results: DataFrame) -> DataFrame:
    """``result_id, citation_id, source, district, indicator, year, page, confidence, excerpt`` of search results."""
    text = lambda c, d: F.coalesce(c, F.lit(d))
    content = F.coalesce("content", "text", F.lit(""))
    short = F.when(F.length(content) > 200, F.concat(F.substring(content, 1, 200), F.lit("..."))).otherwise(content)
    made = F.substring(F.md5(F.concat(text(F.col("source_document"), ""), text(F.col("district"), ""), text(F.col("indicator"), "")).cast("binary")), 1, 8)
    return results.select(
        "result_id", made.alias("citation_id"), text(F.col("source_document"), "Unknown").alias("source"), text(F.col("district"), "N/A").alias("district"), text(F.col("indicator"), "N/A").alias("indicator"),
        F.coalesce("year", F.lit(0)).alias("year"), F.coalesce(F.col("page").cast("string"), F.lit("N/A")).alias("page"), F.coalesce("score", F.lit(0.0)).alias("confidence"), short.alias("excerpt"),
    )


def in_order(lines: Column, n: Column) -> Column:
    """An aggregate: lines joined by line breaks in the order of ``n``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), lines.alias("l")))), lambda x: x["l"]), "\n")


def numbered_context(results: DataFrame, answer: str) -> DataFrame:
    """``answer, context``: what an answer's results (answer, n, source_document, district, indicator, year, content) say."""
    said = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    head = [F.concat(F.lit("Document "), F.col("n").cast("string"), F.lit(":"))]
    head += [F.concat(F.lit(f"{label}: "), said(c, d)) for label, c, d in (("Source", "source_document", "Unknown"), ("District", "district", "N/A"), ("Indicator", "indicator", "N/A"), ("Year", "year", "N/A"))]
    content = F.when(F.coalesce(F.length("content"), F.lit(0)) > 0, F.concat(F.lit("Content: "), "content"))
    block = F.concat_ws("\n", *head, content, F.lit("-" * 50))
    return results.groupBy(answer).agg(F.concat(F.lit(CONTEXT_LEAD + "\n\n"), in_order(block, F.col("n"))).alias("context"))


def references(citations: DataFrame, answer: str) -> DataFrame:
    """``answer, refs``: the numbered references of an answer's citations (answer, n, source, district, year, indicator)."""
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "source", F.lit(" - "), "district", F.lit(" ("), F.col("year").cast("string"), F.lit(") - "), "indicator")
    return citations.groupBy(answer).agg(in_order(line, F.col("n")).alias("refs"))


def prompt(question: Column, context: Column, refs: Column, instructions: str) -> Column:
    return F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUERY: "), question, F.lit("\n\nCITATION REFERENCES:\n"), refs, F.lit("\n\n" + instructions))


def displayed(citations: DataFrame) -> DataFrame:
    """Citations as a list shows them: number, title and a confidence of two digits."""
    return citations.select(F.col("n").alias("number"), F.col("citation_id").alias("id"), F.concat("source", F.lit(" - "), "indicator").alias("title"), F.format_string("%.2f", "confidence").alias("confidence"), "page")


def citation_texts(excerpt: Column, text: Column, full_text: Column) -> Column:
    """The excerpt, else the text, else the first thousand characters of the full text."""
    return F.coalesce(excerpt, text, F.substring(full_text, 1, FULL_TEXT))


def policy_context(legal: DataFrame, data: DataFrame, answer: str) -> DataFrame:
    """``answer, context``: up to five legal lines and five data lines of each answer, each part only where it has any."""
    lines = legal.where(F.col("n") <= CONTEXT_ROWS).select(answer, "n", F.concat(F.lit("- "), "title", F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, CONTEXT_EXCERPT)).alias("l"))
    said = lambda c: F.coalesce(c, F.lit("N/A"))
    point = F.concat(F.lit("- "), said(F.col("indicator")), F.lit(": "), said(F.format_string("%.2f", "value")), F.lit(" ("), said(F.col("district")), F.lit(", "), said(F.col("year").cast("string")), F.lit(")"))
    points = data.where(F.col("n") <= CONTEXT_ROWS).select(answer, "n", point.alias("l"))
    laws = lines.groupBy(answer).agg(F.concat(F.lit(LEGAL_HEAD + "\n"), in_order(F.col("l"), F.col("n"))).alias("laws"))
    stats = points.groupBy(answer).agg(F.concat(F.lit("\n" + DATA_HEAD + "\n"), in_order(F.col("l"), F.col("n"))).alias("stats"))
    return laws.join(stats, answer, "full").select(answer, F.concat_ws("\n", "laws", "stats").alias("context"))


def markdown(question: Column, said: Column, chain_: Column, cited: Column, confidence: Column, seconds: Column, method: Column, warnings: Column) -> Column:
    """An answer as markdown; ``cited`` are citation strings, ``warnings`` may be empty. Headings and labels are fixed values."""
    numbered = F.transform(cited, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    rest = F.when(F.size(warnings) > 0, F.concat(F.lit("\n⚠️ **Warnings:**\n"), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), "\n")))
    lines = [
        F.concat(F.lit("# Query: "), question, F.lit("\n")), F.concat(F.lit("## Answer\n"), said, F.lit("\n")), F.concat(F.lit("## Legal Chain\n"), chain_, F.lit("\n")), F.lit("## Citations\n"),
        F.when(F.size(cited) > 0, F.array_join(numbered, "\n")), F.lit("\n## Metadata"), F.concat(F.lit("- Confidence: "), F.format_string("%.2f%%", confidence * 100)),
        F.concat(F.lit("- Processing Time: "), F.format_string("%.2fs", seconds)), F.concat(F.lit("- Method: "), method), rest,
    ]
    return F.concat_ws("\n", *lines)


def validated(cited: Column) -> tuple[Column, Column]:
    """Whether an answer has citations, and the warning if it has none."""
    some = F.coalesce(F.size(cited) > 0, F.lit(False))
    return some, F.when(~some, F.lit(NO_CITATIONS))


def report(valid: Column, confidence: Column, risk: Column, claims: Column, uncited: Column, errors: Column, warnings: Column) -> Column:
    """A validation report of one answer as text: the first five uncited claims, all errors and warnings. Its lines are fixed values."""
    bar, share = "=" * 60, lambda c: F.format_string("%.1f%%", c * 100)
    listed = lambda head, items, line: F.when(F.size(items) > 0, F.concat(head, F.lit("\n"), F.array_join(F.transform(items, line), "\n")))
    item = lambda x: F.concat(F.lit("  - "), x)
    n = F.size(uncited)
    covered = F.when(claims > 0, (claims - n) / claims).otherwise(F.lit(1.0))
    return F.concat_ws(
        "\n", F.lit(bar), F.lit("CITATION VALIDATION REPORT"), F.lit(bar), F.concat(F.lit("\nStatus: "), F.when(valid, "✅ VALID").otherwise("❌ INVALID")), F.concat(F.lit("Confidence: "), share(confidence)), F.concat(F.lit("Hallucination Risk: "), share(risk)),
        F.lit("\nCitation Coverage:"), F.concat(F.lit("  Total Claims: "), claims.cast("string")), F.concat(F.lit("  Cited Claims: "), (claims - n).cast("string")), F.concat(F.lit("  Uncited Claims: "), n.cast("string")), F.concat(F.lit("  Coverage: "), share(covered)),
        listed(F.concat(F.lit("\n❌ Errors ("), F.size(errors).cast("string"), F.lit("):")), errors, item), listed(F.concat(F.lit("\n⚠️  Warnings ("), F.size(warnings).cast("string"), F.lit("):")), warnings, item),
        listed(F.lit("\n📝 Uncited Claims:"), F.slice(uncited, 1, 5), lambda x: F.concat(F.lit("  - "), F.substring(x, 1, 100), F.lit("..."))), F.lit("\n" + bar),
    )


def vector_record(facts: DataFrame) -> DataFrame:
    """Data points as a vector store takes them: the value as text, and a text of indicator, value, unit, place and year."""
    place, year = F.coalesce("district", F.lit("All districts")), F.coalesce(F.col("year").cast("string"), F.lit("Year N/A"))
    text = F.concat("indicator", F.lit(": "), F.format_string("%.2f", "value"), F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(" ("), place, F.lit(", "), year, F.lit(")"))
    return facts.select(F.col("fact_id").alias("data_id"), F.lower(F.substring_index("source_document", "_", 1)).alias("source"), "indicator", F.format_string("%.2f", "value").alias("value"), "unit", "district", "year", "category", "source_document", F.col("source_page").alias("page_number"), F.col("confidence_score").alias("confidence"), text.alias("text"))
