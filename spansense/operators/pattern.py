"""Queries of text columns by meaning, with the surface of a regular-expression library.

A :class:`Pattern` turns a DataFrame of texts into one of spans, verdicts or rewritten texts. Everything is lazy; the judge sees only the spans that pass
the prefilter, and rows keep an explicit order (``ord`` within a text), which Spark itself doesn't have.
"""

from __future__ import annotations

import asyncio
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from spansense.functions.questions import Choice, Score
from spansense.functions.units import SEGMENTS, SPAN, Batch, Unit, explode_spans, is_segment, resolve_units, scan, with_spans
from spansense.operators.judge import Ask, Judge
from spansense.runtime import checkpointed

# The default threshold and the edges of the review band; characters around a candidate; the unit set of an extraction.
THRESHOLD, BAND = 0.5, (0.1, 0.9)
NEAR = 160
EXTRACT_UNITS = ("money", "date", "email", "phone", "url", "percent", "number")
#: Options of one choice, at most, besides none of them.
MOST_OPTIONS = 254

_HITS = "array<struct<ord:int,start:int,end:int,text:string,unit:string,p:double>>"


class Match(NamedTuple):
    """One match of a text, as the iterator gives it."""

    id: object
    start: int
    end: int
    text: str
    unit: str
    p: float

    def group(self, n: int = 0) -> str:
        if n:
            raise IndexError("a match has one group, 0")
        return self.text

    def span(self) -> tuple[int, int]:
        return self.start, self.end

    def __str__(self) -> str:
        return self.text


def band(p: Column, edges: tuple[float, float] = BAND) -> Column:
    """``yes`` from the upper edge on, ``no`` up to the lower, else ``review``; null for a null probability."""
    low, high = edges
    return F.when(p >= high, "yes").when(p <= low, "no").when(p.isNotNull(), "review")


def near(source: Column, start: Column, end: Column, chars: int = NEAR) -> Column:
    """A span in its surroundings: marked by brackets, up to ``chars`` characters on each side, an ellipsis where text was cut off."""
    a, b, n = F.greatest(F.lit(0), start - chars), F.least(F.length(source), end + chars), F.length(source)
    cut = lambda x, y: F.substring(source, x + 1, y - x)
    return F.concat(F.when(a > 0, F.lit("…")).otherwise(""), cut(a, start), F.lit("⟦"), cut(start, end), F.lit("⟧"), cut(end, b), F.when(b < n, F.lit("…")).otherwise(""))


Prefilter = str | re.Pattern | Callable[[str], bool] | None


def prefilter_column(prefilter: Prefilter, text: Column, *, dialect: str = "python") -> Column:
    """Whether a text may be judged at all. A pattern is searched anywhere in it, with Python's meaning, or Java's if ``dialect`` is ``java``."""
    if prefilter is None:
        return F.lit(True)
    if isinstance(prefilter, str) and dialect == "java":
        return text.rlike(prefilter)
    test = prefilter if callable(prefilter) else (lambda t, rx=re.compile(prefilter) if isinstance(prefilter, str) else prefilter: rx.search(t) is not None)
    return F.udf(lambda t: None if t is None else bool(test(t)), "boolean", useArrow=True)(text)


@dataclass(frozen=True)
class Pattern:
    """A description of what to find: ``meaning``, the ``unit`` that texts are cut into, and how sure the judge must be.

    ``question`` may word the judge's question; it must hold ``{ref}``, where the span goes. ``id_col`` and ``text_col`` name the columns of the texts;
    other columns are kept by the operators that keep rows. Null texts have no spans, no verdict and stay null when rewritten.
    """

    meaning: str
    judge: Judge
    unit: Unit = "sentence"
    threshold: float = THRESHOLD
    prefilter: Prefilter = None
    context: str | None = None
    question: str | None = None
    dialect: str = "python"
    id_col: str = "doc_id"
    text_col: str = "text"

    def __post_init__(self) -> None:
        if not self.meaning or not self.meaning.strip():
            raise ValueError("a pattern needs a meaning")
        if not 0 <= self.threshold <= 1:
            raise ValueError("a threshold lies within 0 and 1")
        if self.question is not None and "{ref}" not in self.question:
            raise ValueError("a question of one's own holds {ref}")
        resolve_units(self.unit)

    @property
    def wording(self) -> Ask:
        """What the judge is asked of each span."""
        return Ask(self.meaning, self.question, self.context)

    # --- spans

    def _scored(self, rows: DataFrame, text: str = "text", near: str | None = None) -> DataFrame:
        """Rows with ``p``: asked only where the prefilter holds, 0 elsewhere. The two parts are kept apart so that no judge sees a pruned row."""
        if self.prefilter is None:
            return self.judge.score(rows, self.wording, text=text, near=near)
        marked = rows.withColumn("_ask", F.coalesce(prefilter_column(self.prefilter, F.col(text), dialect=self.dialect), F.lit(False)))
        asked = self.judge.score(marked.where("_ask"), self.wording, text=text, near=near)
        return asked.unionByName(marked.where("not _ask").withColumn("p", F.lit(0.0))).drop("_ask")

    def scan(self, texts: DataFrame) -> DataFrame:
        """``(id, ord, start, end, text, unit, p, band)`` of every span; those that the prefilter turns away have p 0."""
        segments = is_segment(self.unit)
        spans = explode_spans(texts, self.unit, keys=[self.id_col], text=self.text_col, keep_text=not segments)
        if segments:
            return self._scored(spans).withColumn("band", band(F.col("p")))
        # a candidate is judged where it stands
        spans = spans.withColumn("_near", near(F.col("source"), F.col("start"), F.col("end"))).drop("source")
        return self._scored(spans, near="_near").drop("_near").withColumn("band", band(F.col("p")))

    def findall(self, texts: DataFrame) -> DataFrame:
        """The spans of :meth:`scan` that reach the threshold."""
        return self.scan(texts).where(F.col("p") >= self.threshold)

    def finditer(self, texts: DataFrame) -> Iterator[Match]:
        """The matches one by one, in order, without holding them all on the driver."""
        for r in self.findall(texts).orderBy(self.id_col, "ord").toLocalIterator():
            yield Match(r[self.id_col], r["start"], r["end"], r["text"], r["unit"], r["p"])

    def search(self, texts: DataFrame) -> DataFrame:
        """The best match of each text, the first of equals; texts without a match give no row."""
        return best_by(self.findall(texts), [self.id_col], [-F.col("p"), F.col("ord")])

    def test(self, texts: DataFrame) -> DataFrame:
        """The texts as wholes, whatever the unit: adds ``p``, ``matched`` and ``band``."""
        rows = self.judge.score(texts, self.wording, text=self.text_col)
        return rows.withColumns({"matched": F.col("p") >= self.threshold, "band": band(F.col("p"))})

    fullmatch = test

    # --- rewriting

    def _with_hits(self, texts: DataFrame) -> DataFrame:
        """``(id, text, hits)``: each text with its matches in order.

        An expression judges the spans where they lie, in the row's array. Other judges get a row per span; these meet again by the row's number, which every span of a row carries along
        from one task, so texts aren't joined and ids may repeat.
        """
        rows = with_spans(texts.select(self.id_col, F.col(self.text_col).alias("text")), self.unit, out="_spans")
        p = self.judge.expression
        if p is not None and (self.prefilter is None or (isinstance(self.prefilter, str) and self.dialect == "java")):
            allowed = lambda t: t.rlike(self.prefilter) if self.prefilter is not None else F.lit(True)
            scored = F.transform(
                "_spans", lambda x, i: F.struct(i.cast("int").alias("ord"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["unit"].alias("unit"), F.when(allowed(x["text"]), p(x["text"], self.wording)).otherwise(0.0).alias("p"))
            )
            return rows.select(self.id_col, "text", F.filter(scored, lambda h: h["p"] >= self.threshold).cast(_HITS).alias("hits"))
        numbered = rows.withColumn("_row", F.monotonically_increasing_id())
        spans = numbered.select("_row", F.col(self.id_col).alias("_id"), F.col("text").alias("_whole"), F.posexplode_outer("_spans").alias("ord", "s")).select("_row", "_id", "_whole", "ord", "s.*")
        empty, full = spans.where("ord is null"), spans.where("ord is not null").withColumn("_near", near(F.col("_whole"), F.col("start"), F.col("end")))
        scored = self._scored(full, near=None if is_segment(self.unit) else "_near").drop("_near").unionByName(empty.withColumn("p", F.lit(None).cast("double")))
        hit = F.when(F.col("p") >= self.threshold, F.struct("ord", "start", "end", "text", "unit", "p"))
        lists = scored.groupBy("_row").agg(F.first("_id").alias(self.id_col), F.first("_whole").alias("_t"), F.sort_array(F.collect_list(hit)).cast(_HITS).alias("hits"))
        return lists.select(self.id_col, F.col("_t").alias("text"), "hits")

    def subn(self, repl: str | Callable[[Column], Column], texts: DataFrame, count: int = 0) -> DataFrame:
        """The texts with the first ``count`` matches (0: all) replaced: ``(id, text, n)``.

        ``repl`` is a text, or a function from the match, a struct column, to a column.
        """
        if count < 0:
            raise ValueError("count is 0, for all, or more")
        rows = self._with_hits(texts)
        rows = rows.withColumn("hits", F.slice("hits", F.lit(1), F.lit(count))) if count else rows
        new = (lambda h: repl(h)) if callable(repl) else (lambda h: F.lit(repl))
        gap_at = lambda i: F.when(i > 0, F.get(F.col("hits"), i - 1)["end"]).otherwise(F.lit(0))
        parts = F.transform("hits", lambda h, i: F.concat(F.substring(F.col("text"), gap_at(i) + 1, h["start"] - gap_at(i)), new(h)))
        tail_at = F.coalesce(F.get(F.col("hits"), F.size("hits") - 1)["end"], F.lit(0))
        whole = F.concat(F.array_join(parts, ""), F.substring(F.col("text"), tail_at + 1, F.length("text")))
        return rows.select(self.id_col, F.when(F.col("text").isNotNull(), whole).alias("text"), F.size("hits").alias("n"))

    def sub(self, repl: str | Callable[[Column], Column], texts: DataFrame, count: int = 0) -> DataFrame:
        """:meth:`subn` without the number of matches."""
        return self.subn(repl, texts, count).drop("n")

    def split(self, texts: DataFrame, *, keep: bool = False) -> DataFrame:
        """``(id, pieces)``: the text between matches, stripped, empty pieces left out; with ``keep`` the matches too, in their places."""
        rows = self._with_hits(texts)
        space = r"[\s\x1c-\x1f\x85\p{Z}]"
        bare = lambda c: F.regexp_replace(c, f"^{space}+|{space}+$", "")
        after = lambda i: F.when(i > 0, F.get(F.col("hits"), i - 1)["end"]).otherwise(F.lit(0))
        gap = lambda h, i: bare(F.substring(F.col("text"), after(i) + 1, h["start"] - after(i)))
        parts = F.flatten(F.transform("hits", lambda h, i: F.array(gap(h, i), h["text"]) if keep else F.array(gap(h, i))))
        last = F.coalesce(F.get(F.col("hits"), F.size("hits") - 1)["end"], F.lit(0))
        pieces = F.concat(parts, F.array(bare(F.substring(F.col("text"), last + 1, F.length("text")))))
        return rows.select(self.id_col, F.when(F.col("text").isNotNull(), F.filter(pieces, lambda p: p != "")).alias("pieces"))

    def diff(self, regex: str | re.Pattern, texts: DataFrame) -> DataFrame:
        """Where a regular expression and the meaning disagree: ``(id, ord, start, end, text, unit, p, side)``, side ``regex_only``, ``meaning_only`` or ``agree``.

        A segment is a hit of the expression if one of its matches touches it. Of candidate units, matches that touch no span are judged too,
        as unit ``regex``. Empty matches count for nothing. The prefilter isn't applied.
        """
        rx, unit = re.compile(regex) if isinstance(regex, str) else regex, self.unit

        def cut(texts: pa.Array) -> pa.Array:
            batch = Batch(texts.to_pylist())
            starts, ends, kinds = scan(batch, unit)
            spans = list(zip(starts.tolist(), ends.tolist(), kinds))
            begins = [a for a, _, _ in spans]
            rows: list[list[dict]] = [[] for _ in range(len(batch.starts))]
            first = 0
            for row, (base, size) in enumerate(zip(batch.starts.tolist(), batch.sizes.tolist())):
                text = batch.text[base : base + size]
                hits = [(base + m.start(), base + m.end()) for m in rx.finditer(text) if m.end() > m.start()]
                last = bisect_right(begins, base + size - 1) if size else first
                own = spans[first:last]
                if not is_segment(unit):
                    inner = [a for a, _, _ in own]
                    lone = [(a, b, "regex") for a, b in hits if not ((i := bisect_right(inner, b - 1)) and own[i - 1][1] > a)]
                    own = sorted(own + lone)
                i = 0
                for x, y, kind in own:
                    while i < len(hits) and hits[i][1] <= x:
                        i += 1
                    rows[row].append({"start": x - base, "end": y - base, "text": batch.text[x:y], "unit": kind, "hit": i < len(hits) and hits[i][0] < y})
                first = last
            return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("unit", pa.string()), ("hit", pa.bool_())])))

        spans = F.arrow_udf(cut, "array<struct<start:int,end:int,text:string,unit:string,hit:boolean>>")
        rows = texts.select(self.id_col, F.posexplode(spans(F.col(self.text_col))).alias("ord", "s")).select(self.id_col, "ord", "s.*")
        rows = self.judge.score(rows, self.wording)
        fits = F.col("p") >= self.threshold
        side = F.when(F.col("hit") & ~fits, "regex_only").when(fits & ~F.col("hit"), "meaning_only").otherwise("agree")
        return rows.withColumn("side", side).drop("hit")

    # --- collections

    def filter_p(self, texts: DataFrame) -> DataFrame:
        """The rows with ``p`` of each text; 0 where the prefilter turns it away."""
        return self._scored(texts, text=self.text_col)

    def filter(self, texts: DataFrame) -> DataFrame:
        """The rows whose text reaches the threshold."""
        return self.filter_p(texts).where(F.col("p") >= self.threshold)

    def rank(self, texts: DataFrame, ord_col: str, limit: int | None = None) -> DataFrame:
        """The rows by falling ``p``, equal ones in the order of ``ord_col``; with ``limit`` only the first ones, without a full sort."""
        ordered = self.filter_p(texts).orderBy(F.col("p").desc_nulls_last(), F.col(ord_col))
        return ordered.limit(limit) if limit is not None else ordered


def compile(meaning: str, judge: Judge, **settings) -> Pattern:  # noqa: A001
    """A :class:`Pattern`."""
    return Pattern(meaning, judge, **settings)


def best_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a rising order that leaves no ties; an aggregation that combines on the map side, so a key may have any share of the rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in rows.columns])


async def collected(rows: DataFrame) -> list[Row]:
    """The rows of any query, awaited: Spark works while the caller does something else."""
    return await asyncio.to_thread(rows.collect)


# --- queries by a text or a pattern -------------------------------------------------------------------------------------------------------


def _as_pattern(meaning: str | Pattern, judge: Judge | None, settings: dict) -> Pattern:
    if isinstance(meaning, Pattern):
        if judge is not None or settings:
            raise TypeError("a pattern has its judge and settings already")
        return meaning
    if judge is None:
        raise TypeError("a text needs a judge")
    return Pattern(meaning, judge, **settings)


def _shortcut(name: str) -> Callable[..., DataFrame]:
    def query(meaning: str | Pattern, *args, judge: Judge | None = None, **settings) -> DataFrame:
        passed = {k: settings.pop(k) for k in ("count", "keep", "limit") if k in settings}
        return getattr(_as_pattern(meaning, judge, settings), name)(*args, **passed)

    query.__name__, query.__doc__ = name, f":meth:`Pattern.{name}` of a pattern, or of a text with its ``judge`` and settings."
    return query


test, fullmatch, findall, finditer, search, scan_all = (_shortcut(n) for n in ("test", "fullmatch", "findall", "finditer", "search", "scan"))
sub, subn, split, diff, filter_texts, rank = (_shortcut(n) for n in ("sub", "subn", "split", "diff", "filter", "rank"))


# --- typed queries -------------------------------------------------------------------------------------------------------------------------


def classify(texts: DataFrame, options: Mapping[str, str | None] | Sequence[str], judge: Judge, *, question: str = "Which of these categories does `text` belong to?", text: str = "text") -> DataFrame:
    """Adds ``pick``: one label of ``options`` (a list, or labels with descriptions) for each text."""
    if isinstance(options, str):
        raise TypeError("options are a list of labels or labels with descriptions, not one text")
    described = dict(options) if isinstance(options, Mapping) else {str(o): None for o in options}
    Choice(question, described)
    return judge.choose(texts, question, described, text=text)


def rate(texts: DataFrame, question: str, levels: Sequence[str], judge: Judge, *, text: str = "text") -> DataFrame:
    """Adds ``rating``: the text's place on an ordered scale, lowest level first."""
    Score(question, levels)
    return judge.rate(texts, question, levels, text=text)


def top(pick: Column, n: int) -> Column:
    """The ``n`` likeliest options of a pick, as structs ``(key, value)``, equal ones by label."""
    entries = F.map_entries(pick["probabilities"])
    later = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.slice(F.array_sort(entries, later), 1, n)


def extract(texts: DataFrame, what: str, judge: Judge, *, unit: Unit = EXTRACT_UNITS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", group: int = MOST_OPTIONS) -> DataFrame:
    """``(id, start, end, text, unit, p)``: the one value of each text that is ``what``, or no row.

    Where a text and its distinct values fit one request the judge chooses among the values, in the order of their first occurrence, and may choose none. If the value chosen stands in several places, or a
    text is too long or has more than ``group`` values, occurrences meet in a tournament: groups of ``group``, each occurrence in its surroundings, send on the one chosen until one is left. What was chosen must reach the
    threshold. Ids must be unique; null texts have no values.
    """
    rows = checkpointed(with_spans(texts.select(id_col, F.col(text_col).alias("text")), unit, out="s").where(F.size("s") > 0))
    values = F.array_distinct(F.col("s.text"))
    rows = rows.withColumn("values", values)
    fits = (F.length("text") + F.aggregate("values", F.lit(0), lambda n, v: n + F.length(v) + 20) <= judge.max_state_chars) & (F.size("values") <= group)
    short = judge.pick(rows.where(fits), what, options="values", text="text", out="pick").where((F.col("pick.place") >= 0) & (F.col("pick.p") >= threshold))
    chosen = short.withColumn("value", F.get("values", F.col("pick.place"))).withColumn("at", F.filter("s", lambda x: x["text"] == F.col("value")))
    single = chosen.where(F.size("at") == 1).select(id_col, F.get("at", F.lit(0)).alias("o"), F.col("pick.p").alias("p"))
    several = chosen.where(F.size("at") > 1).select(id_col, "text", F.col("at").alias("s"), F.col("pick.p").alias("sure"))
    many = rows.where(~fits).select(id_col, "text", "s", F.lit(None).cast("double").alias("sure"))
    won = tournament(several.unionByName(many), what, judge, id_col=id_col, group=group)
    won = won.where((F.col("sure").isNotNull() & (F.col("place") >= 0)) | (F.col("p") >= threshold)).select(id_col, "o", F.coalesce("sure", "p").alias("p"))
    return single.unionByName(won).select(id_col, "o.start", "o.end", "o.text", "o.unit", "p")


def tournament(rows: DataFrame, what: str, judge: Judge, *, id_col: str, group: int = MOST_OPTIONS) -> DataFrame:
    """``(id, sure, o, place, p)``: of each row's occurrences ``s`` the one that the judge chooses, round by round; groups in which it chooses none send nobody on.

    A round is one aggregation and one pass of the judge; the number of rounds is that of the largest text, its logarithm by ``group``.
    """
    seen = rows.select(id_col, "sure", F.posexplode("s").alias("n", "o"), "text")
    seen = seen.select(id_col, "sure", "n", "o", near(F.col("text"), F.col("o.start"), F.col("o.end")).alias("near"), F.lit(0.0).alias("p"), F.lit(0).alias("place"))
    while True:
        entry = F.struct("n", "o", "near")
        groups = seen.groupBy(id_col, F.floor(F.col("n") / max(2, group)).cast("int").alias("g")).agg(F.first("sure").alias("sure"), F.sort_array(F.collect_list(entry)).alias("in"))
        asked = judge.pick(groups.withColumns({"_near": F.col("in.near"), "_all": F.array_join("in.near", "\n")}), what, options="_near", text="_all", out="pick").where(F.col("pick.place") >= 0)
        winner = F.get("in", F.col("pick.place"))
        seen = checkpointed(asked.select(id_col, "sure", F.col("g").alias("n"), winner["o"].alias("o"), winner["near"].alias("near"), F.col("pick.p").alias("p"), F.col("pick.place").alias("place")))
        if seen.where("n > 0").isEmpty():
            return seen.select(id_col, "sure", "o", "place", "p")


def extractall(texts: DataFrame, what: str, judge: Judge, *, unit: Unit, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """Every candidate that is ``what``: :meth:`Pattern.findall` of a candidate unit."""
    return Pattern(what, judge, unit=unit, threshold=threshold, **columns).findall(texts)


__all__ = ["SEGMENTS", "SPAN", "Ask", "Match", "Pattern", "band", "best_by", "classify", "collected", "compile", "extract", "extractall", "near", "prefilter_column", "rate", "top", "tournament", "with_spans"]
