"""A claim checker: prose sentences that make claims, and how each is backed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spansense.functions.units import explode_spans
from spansense.operators.judge import Judge
from spansense.sources.texts import line_number

#: The first-hand question reads so many characters of the paragraph. Between ``SOURCED_NO`` and the threshold, a claim is to be checked.
PARAGRAPH_CHARS, SOURCED_NO = 900, 0.2
_LINK = r"\[([^\]]+)\]\((?:https?://|/|\.)[^)]*\)|<https?://[^>]+>|https?://\S+"


def check_claims(texts: DataFrame, judge: Judge, *, claim: str, sourced: str, firsthand: str, id_col: str = "doc_id", least_words: int = 5, threshold: float = 0.5) -> DataFrame:
    """``(id, ord, line, text, linked, verdict)``: the sentences of at least ``least_words`` words that make a claim.

    What isn't prose is blanked without moving offsets. The verdict is ``linked`` if the sentence or the one before it holds a link, else ``sourced`` by
    the judge, read with the sentence before it, or ``first-hand``, read with its paragraph, else ``unsourced``, or ``check`` if the judge was uncertain
    of a source. Claims with figures come first, then by line: see ``figures``.
    """
    blank = F.udf(_blank, "string", useArrow=True)
    rows = texts.select(id_col, F.col("text").alias("raw"), blank("text").alias("text"))
    spans = explode_spans(rows.select(id_col, "text"), "sentence", keys=[id_col]).where(F.size(F.split("text", r"\s+")) >= least_words)
    paragraphs = explode_spans(rows.select(id_col, "text"), "paragraph", keys=[id_col]).select(id_col, "start", F.struct("end", "text").alias("_paragraph"))
    # a sentence lies in the last paragraph that starts before it
    both = spans.unionByName(paragraphs, allowMissingColumns=True)
    up_to = Window.partitionBy(id_col).orderBy("start", F.col("ord").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    spans = both.withColumn("_paragraph", F.last("_paragraph", ignorenulls=True).over(up_to)).where("ord is not null")
    spans = spans.withColumn("before", F.lag("text").over(Window.partitionBy(id_col).orderBy("ord")))
    around = F.when(F.col("start") < F.col("_paragraph.end"), F.col("_paragraph.text")).otherwise(F.col("text"))
    spans = spans.withColumns({"_read": _readable(F.col("text")), "_around": F.substring(_readable(around), 1, PARAGRAPH_CHARS)})
    claims = judge.score(spans, claim, text="_read", out="p_claim").where(F.col("p_claim") >= threshold)
    linked = F.col("text").rlike(_LINK) | F.coalesce(F.col("before").rlike(_LINK), F.lit(False))
    before = F.coalesce(F.nullif(_readable(F.col("before")), F.lit("")), F.lit("(none)"))
    sentence = F.concat(F.lit("\nSentence: "), "_read")
    # linked claims are asked nothing more
    claims = claims.withColumn("linked", linked).withColumns(
        {"_source": F.when(~F.col("linked"), F.concat(F.lit("Previous sentence: "), before, sentence)), "_hand": F.when(~F.col("linked"), F.concat(F.lit("Paragraph: "), "_around", sentence))}
    )
    claims = judge.score(judge.score(claims, sourced, text="_source", out="p_sourced"), firsthand, text="_hand", out="p_first")
    verdict = F.when(F.col("linked"), "linked").when(F.col("p_sourced") >= threshold, "sourced").when(F.col("p_first") >= threshold, "first-hand").when(F.col("p_sourced") <= SOURCED_NO, "unsourced").otherwise("check")
    out = claims.join(rows.select(F.col(id_col).alias("_id"), "raw"), F.col(id_col) == F.col("_id"))
    return out.select(id_col, "ord", line_number(F.col("raw"), F.col("start")).alias("line"), "text", "linked", verdict.alias("verdict"), F.col("text").rlike(r"\p{Nd}").alias("figures"))


def _readable(text: Column) -> Column:
    """What the judge reads: link texts with a mark in place of the address, without Markdown emphasis."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _LINK, "$1 [link]"), r"[*_`]+", ""))


def _blank(text: str | None) -> str | None:
    """``text`` with spaces in place of front matter, comments, images, fenced code, headings, tables and block quotes."""
    import re

    if text is None:
        return None
    for rx in (r"\A---\n.*?\n---\n", r"<!--.*?-->", r"!\[[^\]]*\]\([^)]*\)"):
        text = re.sub(rx, lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    out, fenced = [], False
    for line in text.split("\n"):
        fence = re.match(r"\s*(?:```|~~~)", line) is not None
        fenced ^= fence
        out.append(" " * len(line) if fence or fenced or line.lstrip().startswith(("#", "|", ">")) else line)
    return "\n".join(out)


def report_order(claims: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Claims with figures first, then by line."""
    return claims.orderBy(id_col, F.col("figures").desc(), "line", "ord")
