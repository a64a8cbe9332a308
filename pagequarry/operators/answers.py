"""What a language model answered: JSON inside prose, patches in any of the shapes they come in, scores as number or object, whole pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import stripped
from .records import patch_pages, patch_valid

#: Thoughts, fences of JSON (two kinds) and of pages, a bare object of patches, a page; the least length of a page, whole or cut off.
THOUGHTS = "(?is)<think>.*?</think>"
FENCED_JSON, FENCED_PAGE, PAGE = "(?is)```(?:json)?\\s*\\n(.*?)\\s*```", "(?is)```(?:html)?\\s*\\n(.*?)```", "(?is)(<!DOCTYPE.*?</html>|<html.*?</html>)"
BARE_PATCHES = '(?s)\\{[^{}]*"patches"[^{}]*\\[.*?\\]\\s*\\}'
LEAST, LEAST_CUT = 200, 500
DIMENSIONS = ("rendering", "visual_design", "functionality", "interaction", "code_quality")

_mark = re.compile(r'["\\{}]').search
_quote = re.compile(r'\\.|"', re.DOTALL).search
_json_fence = re.compile(r"```json", re.IGNORECASE)
_object_fence = re.compile(r"```\s*(?=\{)")
_object_end = re.compile(r"\}\s*```")


def balanced(text: str) -> list[tuple[int, int]]:
    """Where the balanced objects of a text begin and end that lie in no other, in one pass: braces inside strings don't count, a backslash
    escapes.  What is balanced inside a brace that never closes counts too."""
    opened: list[int] = []
    closed: list[tuple[int, int]] = []
    at = 0
    while m := _mark(text, at):
        at = m.end()
        if m[0] == "{":
            opened.append(m.start())
        elif m[0] == "}" and opened:
            start = opened.pop()
            while closed and closed[-1][0] > start:
                closed.pop()
            closed.append((start, at))
        elif m[0] == '"' and opened:
            while (q := _quote(text, at)) and q[0] != '"':
                at = q.end()
            if not q:
                break
            at = q.end()
    return closed


def json_texts(text: str, every: bool = False) -> list[str]:
    """Texts in an answer that may be JSON, the likeliest first: what json fences hold, objects alone in a fence, the object that the first
    brace opens (or ``every`` one), the whole answer.  Linear in the answer's length."""
    whole, found = text.strip(), []
    at = 0
    while m := _json_fence.search(whole, at):
        end = whole.find("```", m.end())
        if end < 0:
            break
        found.append(whole[m.end() : end].strip())
        at = end + 3
    at = 0
    while m := _object_fence.search(whole, at):
        end = _object_end.search(whole, m.end())
        if not end:
            break
        found.append(whole[m.end() : end.start() + 1])
        at = end.end()
    first = whole.find("{")
    found += [whole[i:j] for i, j in balanced(whole) if every or i == first]
    return list(dict.fromkeys(x for x in [*found, whole] if x))


def json_candidates(text: Column, every: bool = False) -> Column:
    """``json_texts`` of an answer as an array; of a null none."""

    @F.pandas_udf("array<string>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: json_texts(t or "", every))

    return found(text)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def first_object(candidates: Column) -> Column:
    """The first of some texts that parses as a JSON object, as a variant."""
    return F.get(F.filter(F.transform(candidates, F.try_parse_json), lambda v: v.isNotNull() & _is(v, "OBJECT")), 0)


def thoughtless(answer: Column) -> Column:
    """An answer without its thoughts, unless nothing else is left."""
    bare = stripped(F.regexp_replace(answer, THOUGHTS, ""))
    return F.when(bare != "", bare).otherwise(answer)


PATCHES = "array<struct<old string, new string>>"


def patches_in(value: Column) -> Column:
    """Patches of a parsed answer, an object that has a list of them or the list itself; null where it is neither, or an entry lacks a text."""
    entries = F.when(_is(value, "OBJECT"), F.try_variant_get(value, "$.patches", "variant")).when(_is(value, "ARRAY"), value)
    listed = F.when(_is(entries, "ARRAY"), entries.try_cast("array<variant>"))
    fits = lambda e: _is(e, "OBJECT") & F.coalesce(F.map_contains_key(e.try_cast("map<string, variant>"), "old_str") & F.map_contains_key(e.try_cast("map<string, variant>"), "new_str"), F.lit(False))
    pairs = F.transform(listed, lambda e: F.struct(F.try_variant_get(e, "$.old_str", "string").alias("old"), F.try_variant_get(e, "$.new_str", "string").alias("new")))
    return F.when(F.forall(listed, fits), pairs.cast(PATCHES))


def patches_of(answer: Column) -> Column:
    """The patches in an answer: the first that aren't empty among fences, bare objects and the whole; else what the last that parsed had
    (an empty list means that nothing is to change, null that there are none)."""
    text = thoughtless(answer)
    texts = F.concat(F.transform(F.regexp_extract_all(text, F.lit(FENCED_JSON), 1), stripped), F.regexp_extract_all(text, F.lit(BARE_PATCHES), 0), F.array(text))
    parsed = F.filter(F.transform(texts, F.try_parse_json), lambda v: v.isNotNull())
    found = F.transform(parsed, lambda v: F.struct(patches_in(v).alias("p")))
    some = F.filter(found, lambda f: F.size(f["p"]) > 0)
    return F.coalesce(F.get(some, 0)["p"], F.get(found, F.size(found) - 1)["p"])


def rewritten(answer: Column) -> Column:
    """The whole page that an answer holds: a fence, a page, or the answer itself, of ``LEAST`` characters; null if it is none."""
    text = thoughtless(answer)
    long = lambda x: F.length(x) >= LEAST
    fenced = F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(FENCED_PAGE), 1), stripped), long), 0)
    page = stripped(F.regexp_extract(text, PAGE, 1))
    low = F.lower(text)
    found = F.coalesce(fenced, F.when(long(page), page), F.when(low.rlike("^(<!doctype|<html)") & long(text), text))
    own = F.lower(found)
    closed = F.contains(own, F.lit("</html>")) | F.contains(own, F.lit("</body>"))
    return F.when(closed | (F.regexp_replace(own, "^\\s+", "").rlike("^(<!doctype|<html)") & (F.length(found) >= LEAST_CUT)), found)


def repaired(pages: DataFrame) -> DataFrame:
    """(id, html, how, applied, total) of pages (id, html, answer): ``unchanged`` where the answer's patches are none, ``patched`` where some
    apply and the page stays valid, else ``rewritten`` by the whole page in the answer, else null."""
    wanted = pages.select("id", "html", F.coalesce("answer", F.lit("")).alias("answer")).withColumn("p", patches_of(F.col("answer")))
    page = rewritten(F.col("answer"))
    begins = F.lower(F.substring(page, 1, 200))
    whole = F.when(F.contains(begins, F.lit("<!doctype")) | F.contains(begins, F.lit("<html")), page)
    ready = wanted.select("id", "html", F.coalesce("p", F.array().cast(PATCHES)).alias("patches"), F.struct(F.col("p").isNotNull().alias("known"), whole.alias("whole")).alias("rest"))
    done = patch_pages(ready, {"rest": "struct<known: boolean, whole: string>"})
    known = F.col("rest.known")
    how = F.when(known & (F.col("total") == 0), "unchanged").when(known & (F.col("applied") > 0) & patch_valid(F.col("before"), F.col("html")), "patched").when(F.col("rest.whole").isNotNull(), "rewritten")
    html = F.when(how == "unchanged", F.col("before")).when(how == "patched", F.col("html")).when(how == "rewritten", F.col("rest.whole"))
    return done.select("id", html.alias("html"), how.alias("how"), F.col("applied").cast("long").alias("applied"), F.col("total").cast("long").alias("total"))


def total_score(score: Column) -> Column:
    """The total of a score (a variant): an object's, or the number itself; fractions are cut off, nothing counts as 0."""
    value = F.when(_is(score, "OBJECT"), F.try_variant_get(score, "$.total", "double")).otherwise(F.try_variant_get(score, "$", "double"))
    return F.coalesce(value, F.lit(0.0)).cast("long")


def final_score(score: Column) -> Column:
    """A repair's starting score from a result's (a variant): points and reasons by dimension, total, lists and summary; null if it is no object."""
    points = lambda name: F.coalesce(F.try_variant_get(score, f"$.{name}", "double"), F.lit(0.0))
    text = lambda name: F.coalesce(F.try_variant_get(score, f"$.{name}", "string"), F.lit(""))
    part = lambda name: F.try_variant_get(score, f"$.{name}", "variant")
    listed = lambda name: F.when(_is(part(name), "ARRAY"), F.try_variant_get(score, f"$.{name}", "array<string>")).otherwise(F.array().cast("array<string>"))
    dims = [F.struct(points(d).alias("score"), text(f"{d}_reason").alias("reason")).alias(d) for d in DIMENSIONS]
    lists = [listed(n).alias(n) for n in ("bugs", "missing_features", "highlights", "improvement_hints")]
    summary = F.when(_is(part("summary"), "STRING"), text("summary")).otherwise("")
    return F.when(_is(score, "OBJECT"), F.struct(*dims, points("total").alias("total_score"), *lists, summary.alias("summary")))
