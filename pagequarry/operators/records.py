"""Raw and evaluated records: layouts, states, merges, error classes, measurements, patches, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import any_of
from ..functions.taxonomy import stripped


def first_message(messages: Column, role: str) -> Column:
    """The content of the first message of a role in an array of (role, content)."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), 0)["content"]


def parsed(records: DataFrame) -> DataFrame:
    """(query, response, stable_id) of records in any of four layouts: messages, query/response, instruction/output, prompt/completion."""
    query = F.coalesce(first_message(F.col("messages"), "user"), F.col("query"), F.col("instruction"), F.col("prompt"), F.lit(""))
    response = F.coalesce(first_message(F.col("messages"), "assistant"), F.col("response"), F.col("output"), F.col("completion"), F.lit(""))
    return records.select("line_idx", query.alias("query"), response.alias("response"), F.coalesce("data_id", "line_number", F.col("line_idx").cast("string")).alias("stable_id"))


def status(fallback: Column, failed: Column, completed: Column, phases: Column) -> Column:
    """The state of a record: flags first, then whether all its phases (an array of booleans) succeeded."""
    done = (F.size(phases) > 0) & F.forall(phases, lambda p: p)
    return F.when(fallback, "completed_with_fallback").when(failed, "failed").when(completed | done, "completed").otherwise("processing")


def merged(sources: list[DataFrame], key: str, valid: Column) -> DataFrame:
    """Valid rows of several sources by key: a later source wins, within a source the last line."""
    ranked = [s.where(valid).withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, ranked)
    return rows.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*rows.columns), F.struct("source_rank", "line_idx")).alias("r")).select("r.*")


#: What errors say when a provider blocked an item.
BLOCKED = ("content filter", "content filtering", "output blocked", "blocked by content", "safety policy", "policy violation")
ERROR_LENGTH = 500


def short_error(message: Column) -> Column:
    """The part of an error that is kept."""
    return F.substring(message, 1, ERROR_LENGTH)


def error_class(message: Column) -> Column:
    """What kind of failure a (shortened) generation error is; a blocked item isn't tried again."""
    low = F.lower(short_error(message))
    limited, late = any_of(low, ("429", "rate limit", "too many requests")), any_of(low, ("timeout", "timed out"))
    blocked = F.when(stripped(message) == "", "none").when(any_of(low, BLOCKED), "content_filter")
    return blocked.when(limited, "rate_limit").when(late, "timeout").otherwise("other")


def retry_after(header: Column) -> Column:
    """Seconds that a response's retry-after header asks to wait; null without a number."""
    return header.try_cast("double")


def latency(values: Column) -> dict[str, Column]:
    """Of an array of milliseconds (negative: timed out): rounded mean, least and greatest, and how many timed out."""
    known = F.filter(values, lambda v: v >= 0)
    total = F.aggregate(known, F.lit(0.0), lambda s, v: s + v)
    return {"avg_latency_ms": F.bround(F.try_divide(total, F.array_size(known))).cast("long"), "min_latency_ms": F.array_min(known), "max_latency_ms": F.array_max(known), "interactions_timed_out": F.array_size(F.filter(values, lambda v: v < 0)).cast("long")}


def response_rate(responsive: Column, tested: Column) -> Column:
    """Responsive of tested elements (2 digits), -1 where none was tested."""
    return F.when(tested > 0, F.bround(responsive / tested, 2)).otherwise(-1.0)


def clamped(score: Column, keyboard_dead: Column, blank: Column, rate: Column, tested: Column) -> Column:
    """A scorer's dimensions (struct) held down where measurements contradict them, and their total."""
    low = lambda c, test, most: F.when(test, F.least(c, F.lit(most))).otherwise(c)
    weak = (rate < 0.3) & (tested >= 2)
    interaction = low(low(score["interaction"], keyboard_dead, 8), weak, 8)
    functionality, rendering = low(score["functionality"], keyboard_dead, 15), low(score["rendering"], blank, 2)
    total = rendering + score["visual_design"] + functionality + interaction + score["code_quality"]
    return F.struct(rendering.alias("rendering"), score["visual_design"].alias("visual_design"), functionality.alias("functionality"), interaction.alias("interaction"), score["code_quality"].alias("code_quality"), total.alias("total"))


def changed_values(old: Column, new: Column) -> Column:
    """Entries of two maps that differ, as key -> (old, new)."""
    both = F.map_zip_with(old, new, lambda k, a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.map_filter(both, lambda k, v: ~v["old"].eqNullSafe(v["new"]))


def patched(html: Column, patches: Column) -> Column:
    """(html, applied, total) after patches (old, new) in order: each applies if its old text occurs exactly once; later ones see earlier changes."""
    start = F.struct(html.alias("html"), F.lit(0).alias("applied"))

    def apply(s: Column, p: Column) -> Column:
        times = (F.length(s["html"]) - F.length(F.replace(s["html"], p["old"]))) / F.length(p["old"])
        fits = F.coalesce((F.length(p["old"]) > 0) & p["new"].isNotNull() & (times == 1), F.lit(False))
        return F.struct(F.when(fits, F.replace(s["html"], p["old"], p["new"])).otherwise(s["html"]).alias("html"), F.when(fits, s["applied"] + 1).otherwise(s["applied"]).alias("applied"))

    return F.aggregate(patches, start, apply, lambda s: F.struct(s["html"].alias("html"), s["applied"].alias("applied"), F.array_size(patches).alias("total")))


def patch_valid(original: Column, new: Column) -> Column:
    """Whether a patched page kept half its length, its closing tags and 200 characters."""
    keeps = lambda tag: ~F.contains(F.lower(original), F.lit(tag)) | F.contains(F.lower(new), F.lit(tag))
    return F.coalesce((F.length(new) >= F.length(original) * 0.5) & keeps("</html>") & keeps("</body>") & (F.length(new) >= 200), F.lit(False))


#: Dimensions of a score in the order of reports, with their names and most points; shown of an agent's words and of warnings at most.
SCORED = {
    "rendering": ("Rendering", 5), "visual_design": ("Visual Design", 15), "functionality": ("Functionality", 50), "interaction": ("Interaction", 15), "code_quality": ("Implementation Quality", 15),
}
AGENT_WORDS, WARNINGS = 3000, 8
FLAGS = (("Canvas", "has_canvas"), ("JS", "has_script"), ("CSS", "has_style"), ("SVG", "has_svg"), ("rAF", "has_requestanimationframe"))


def report(r: Column) -> Column:
    """A record's report as Markdown text, from a struct: id, variant, evaluated, query, total, summary, bugs, missing, highlights, screenshots (names),
    for each dimension a struct (score, reason), agent (ran, steps, completed, summary), static (html_size, flags, external, input_types), render
    (rendered, probe_errors as structs (probe, error), console_errors, page_errors)."""
    text = lambda c, none="": F.coalesce(c.cast("string"), F.lit(none))
    yes = lambda c, other="no": F.when(F.coalesce(c, F.lit(False)), "yes").otherwise(other)
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), "True").otherwise("False")
    many = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    lines = lambda *parts: F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in parts))
    put = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    counted = lambda c: F.array_join(F.transform(c, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")

    def section(name: str, c: Column, none: str) -> list[Column]:
        return [put(f"## {name} (", many(c), ")\n"), F.when(F.size(c) > 0, counted(c)).otherwise(none), F.lit("")]

    scores = [put(f"| {name} | ", text(r[d]["score"], "0"), f" | {most} | ", text(r[d]["reason"]), " |") for d, (name, most) in SCORED.items()]
    total = text(r["total"], "0")
    pictures = F.when(F.size(r["screenshots"]) > 0, F.array_join(F.transform(r["screenshots"], lambda x: F.concat(F.lit("!["), x, F.lit("](./"), x, F.lit(")"))), "\n")).otherwise("No render screenshots were available.")
    agent, static, render = r["agent"], r["static"], r["render"]
    flags = F.concat_ws("  |  ", *(put(f"{name}: ", flag(static[key])) for name, key in FLAGS))
    warned = F.transform(F.slice(render["probe_errors"], 1, WARNINGS), lambda e: F.concat(F.lit("`"), text(e["probe"], "unknown"), F.lit("`: "), text(e["error"])))
    warnings = F.when(F.size(render["probe_errors"]) > 0, F.concat(F.lit("\n\n## Render Warnings\n\n"), counted(warned))).otherwise("")
    whole = lines(
        "# HTML Evaluation Report", "", "| Field       | Value |", "|-------------|-------|", put("| ID          | `", text(r["id"]), "` |"), put("| Variant     | ", text(r["variant"]), " |"), put("| Evaluated   | ", text(r["evaluated"]), " |"),
        put("| **Score**   | **", total, " / 100** |"), "", "## Task Description", "", text(r["query"]), "", "## Scores", "", "| Dimension | Score | Max | Reason |", "|-----------|------:|----:|--------|", *scores,
        put("| **Total** | **", total, "** | **100** | |"), "", "## Summary", "", text(r["summary"], "N/A"), "", *section("Bugs", r["bugs"], "None found."), *section("Missing Features", r["missing"], "None."), *section("Highlights", r["highlights"], "None."),
        put("## Screenshots (", many(r["screenshots"]), ")\n"), pictures, "", "## Agent Test", "", put("- Phase ran: ", yes(agent["ran"], "no (skipped)")), put("- Steps: ", text(agent["steps"], "0")), put("- Completed: ", yes(agent["completed"])), "",
        "### Agent Summary", "", F.substring(text(agent["summary"], "(not run)"), 1, AGENT_WORDS), "", "## Technical Details", "", put("- HTML size: ", F.format_number(F.coalesce(static["html_size"], F.lit(0)), 0), " chars"), put("- ", flags),
        put("- External resources: ", many(static["external"])), put("- Input types: ", F.coalesce(F.nullif(F.array_join(static["input_types"], ", "), F.lit("")), F.lit("none"))), put("- Rendered: ", flag(render["rendered"])), put("- Render screenshots: ", many(r["screenshots"])),
        put("- Render probe errors: ", many(render["probe_errors"])), put("- Console errors: ", many(render["console_errors"])), put("- JS exceptions: ", many(render["page_errors"])),
    )
    return F.concat(whole, warnings)


def report_score(text: Column) -> Column:
    """The score in a report, null if there is none."""
    return F.nullif(F.regexp_extract(text, "\\*\\*Score\\*\\* +\\| \\*\\*([0-9]+) / 100", 1), F.lit("")).cast("long")


#: Words of buttons that are tried first, as usual, and last.
FIRST_WORDS = ("start", "play", "begin", "submit", "initiate", "开始")
USUAL_WORDS = ("next", "continue", "ok", "confirm", "新建", "继续")
LAST_WORDS = ("cancel", "close", "back", "return", "菜单")


def button_priority(label: Column) -> Column:
    """How promising a button is by its text and attributes; a usual word keeps a button from going last."""
    low = F.lower(label)
    return F.when(any_of(low, FIRST_WORDS), 100).when(any_of(low, USUAL_WORDS), 50).when(any_of(low, LAST_WORDS), 10).otherwise(50)


def chunk(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("long")


def intervals(rows: DataFrame, keys: list[str], draws: int = 1000, seed: int = 42, least: int = 10) -> DataFrame:
    """95 % bootstrap intervals of the mean of ``total`` per group of at least ``least`` rows.

    The resamples are multinomial draws over the group's histogram, so a group is its few distinct scores whatever its size.
    """
    histogram = rows.groupBy(*keys, "total").agg(F.count("*").alias("n"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in histogram.schema.fields if f.name in keys), "n long, mean double, ci_low double, ci_high double"])

    def run(group):
        import numpy as np
        import pandas as pd

        group = group.sort_values("total")
        n, value = group["n"].to_numpy(), group["total"].to_numpy(float)
        size = int(n.sum())
        if size < least:
            return pd.DataFrame(columns=[*keys, "n", "mean", "ci_low", "ci_high"])
        means = np.sort(np.random.default_rng(seed).multinomial(size, n / size, draws) @ value / size)
        out = {k: [group[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "n": [size], "mean": [round(float(n @ value) / size, 2)], "ci_low": [round(float(means[int(0.025 * draws)]), 2)], "ci_high": [round(float(means[int(0.975 * draws) - 1]), 2)]})

    return histogram.groupBy(*keys).applyInPandas(run, schema)


def lines_like(text: str, wanted: str) -> str | None:
    """The first run of lines of ``text`` that equals ``wanted`` but for trailing blanks and for how the same indentation is written (a tab is four blanks)."""

    def shape(line: str) -> tuple[int, str]:
        bare = line.rstrip()
        body = bare.lstrip(" \t")
        lead = bare[: len(bare) - len(body)]
        return len(lead) + 3 * lead.count("\t"), body

    lines, target = text.split("\n"), [shape(x) for x in wanted.split("\n")]
    shapes = [shape(x) for x in lines]
    at = next((i for i in range(len(shapes) - len(target) + 1) if shapes[i] == target[0] and shapes[i : i + len(target)] == target), None)
    return None if at is None else "\n".join(lines[at : at + len(target)])


def patch_pages(pages: DataFrame, carried: dict[str, str] | None = None) -> DataFrame:
    """(id, before, html, applied, total) of pages (id, html, patches), with ``carried`` columns (name: type): as ``patched``, and a text that
    doesn't occur is sought line by line without regard to blanks."""
    carried = carried or {}

    def run(parts):
        import pandas as pd

        for part in parts:
            after, counts = [], []
            for html, patches in part[["html", "patches"]].itertuples(index=False, name=None):
                done = 0
                for p in patches:
                    old, new = p["old"], p["new"]
                    if not old or new is None:
                        continue
                    found = old if html.count(old) == 1 else None if old in html else lines_like(html, old)
                    if found is not None:
                        html, done = html.replace(found, new, 1), done + 1
                after.append(html)
                counts.append((done, len(patches)))
            rest = {c: part[c] for c in carried}
            yield pd.DataFrame({"id": part["id"], "before": part["html"], "html": after, "applied": [d for d, _ in counts], "total": [n for _, n in counts], **rest})

    schema = "id long, before string, html string, applied int, total int" + "".join(f", {c} {t}" for c, t in carried.items())
    return pages.select("id", "html", "patches", *carried).mapInPandas(run, schema)
