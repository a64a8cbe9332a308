"""Queries over raw records and recorded measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.scoring import guarded
from ..operators import records as R
from ..operators import resampling as S
from ..sources.tables import RESPONSES_SQL, RESULTS_SQL, positions, responses, table
from .analysis_queries import _latest

MESSAGES = ("Error 429: rate limit; ", "", "request TIMED OUT: ", "Output blocked, see the Safety Policy. ", "boom ")
BUTTONS = ("Start", "Save", "OK, go back", "Cancel", "Continue", "继续", "菜单")


def parsed_records(spark, sf_dir):
    """Conversations as records of four layouts: (query, response, id)."""
    turns = table(spark, sf_dir, "conversations")
    # A conversation is one record: its turns are few.
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    k, m = F.col("conv_id"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    ask, answer = R.first_message(m, "user"), R.first_message(m, "assistant")
    only = lambda n, c: F.when(k % 4 == n, c)
    rows = grouped.select(
        k.alias("line_idx"), only(0, m).alias("messages"), only(1, ask).alias("query"), only(1, answer).alias("response"), only(2, ask).alias("instruction"), only(2, answer).alias("output"), only(3, ask).alias("prompt"), only(3, answer).alias("completion"),
        F.when(k % 3 == 0, F.concat(F.lit("id"), k.cast("string"))).alias("data_id"), F.when(k % 3 == 1, (k * 10).cast("string")).alias("line_number"),
    )
    out = R.parsed(rows)
    return out.select("line_idx", "stable_id", F.md5(F.col("query").cast("binary")).alias("query_md5"), F.md5(F.col("response").cast("binary")).alias("response_md5"))


def _content():
    """A number from an order's contents."""
    return F.col("o_custkey") * 31 + F.floor("o_totalprice").cast("long")


def record_status(spark, sf_dir):
    k = _content()
    phases = F.when(k % 7 == 0, F.array().cast("array<boolean>")).otherwise(F.array(k % 2 == 0, k % 3 != 1))
    return table(spark, sf_dir, "orders").select(R.status(k % 11 == 0, k % 5 == 0, k % 13 == 0, phases).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def merged_responses(spark, sf_dir):
    """Answers of two sources by item: those with a whole page only, the second source first, then the last line."""
    first = responses(spark, sf_dir).withColumn("line_idx", F.col("item_id"))
    second = first.withColumn("response", F.when(F.length("response") % 3 == 0, F.concat(F.lit("again "), "response")).otherwise("none"))
    out = R.merged([first, second], "item_id", H.extract(F.col("response"), False).isNotNull())
    return out.select("item_id", F.col("source_rank").cast("long").alias("source_rank"), F.length("response").cast("long").alias("size"))


def generation_errors(spark, sf_dir):
    """Kinds of generation errors, whose texts quote the conversations."""
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), ((F.col("conv_id") + F.col("turn")) % len(MESSAGES) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(F.concat(message, F.coalesce("text", F.lit(""))).alias("error"))
    short = R.short_error(F.col("error"))
    return rows.groupBy(R.error_class(F.col("error")).alias("class")).agg(
        F.count("*").alias("n"), F.countDistinct(short).alias("texts"), F.max(F.length(short)).cast("long").alias("longest")
    )


def retry_waits(spark, sf_dir):
    """What responses' retry-after headers (the events' properties) ask for."""
    rows = table(spark, sf_dir, "events").select("event_type", R.retry_after(F.regexp_replace("props", '[^0-9.]', "")).alias("wait"), R.retry_after(F.col("props")).alias("whole"))
    return rows.groupBy("event_type").agg(F.count("wait").alias("waits"), F.max("wait").alias("longest"), F.count("whole").alias("whole"))


def latency_stats(spark, sf_dir):
    """Latencies of each order's lines."""
    value = F.when(F.col("l_quantity") >= 45, -1.0).otherwise(F.bround(F.col("l_quantity") * 7, 0))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(value).alias("v"), F.count_if(F.col("l_discount") > 0.05).alias("ok"), F.count("*").alias("tested"))  # an order's lines are few
    return rows.select("l_orderkey", *(c.alias(n) for n, c in R.latency(F.col("v")).items()), R.response_rate(F.col("ok"), F.col("tested") - 1).alias("response_rate"))


def scorer_clamps(spark, sf_dir):
    k = F.col("line_idx")
    score = F.struct("rendering", "visual_design", "functionality", "interaction", "code_quality")
    out = R.clamped(score, k % 6 == 0, k % 10 == 0, (k % 7).cast("double") / 10, k % 4)
    return _latest(spark, sf_dir).select("line_idx", out.alias("s")).select("line_idx", "s.*")


def value_changes(spark, sf_dir):
    """What differs between two states of a page's variables."""
    k = F.col("event_id") + F.floor("value").cast("long")
    state = lambda n: F.create_map(F.lit("a"), k % n, F.lit("b"), k % 3, F.when(k % 2 == 0, F.lit("c")).otherwise(F.lit("d")), k % (n + 1))
    rows = table(spark, sf_dir, "events").select("event_id", R.changed_values(state(4), state(5)).alias("v"))
    return rows.select("event_id", F.size("v").cast("long").alias("changed"), F.array_join(F.array_sort(F.map_keys("v")), ",").alias("keys"))


def page_patches(spark, sf_dir):
    """Pages after three patches: one that fits, one that occurs often, one that the first made possible."""
    patches = F.array(*(F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in (("</title>", "!</title>"), ("<p>", "<q>"), ("!</title>", "?</title>"))))
    rows = table(spark, sf_dir, "pages").select("page_id", "html", R.patched(F.col("html"), patches).alias("p"))
    return rows.select("page_id", F.col("p.applied").cast("long").alias("applied"), F.col("p.total").cast("long").alias("total"), F.md5(F.col("p.html").cast("binary")).alias("html_md5"), R.patch_valid(F.col("html"), F.col("p.html")).alias("valid"))


def page_loose_patches(spark, sf_dir):
    """Pages, one tag per line, after a patch whose indentation is written with a tab."""
    html = F.regexp_replace("html", "><", ">\n    <")
    patches = F.array(F.struct(F.lit("\t<body>").alias("old"), F.lit("    <body class='a'>").alias("new")), F.struct(F.lit("\t<none>").alias("old"), F.lit("").alias("new")))
    rows = R.patch_pages(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), html.alias("html"), patches.alias("patches")))
    return rows.select(F.col("id").alias("page_id"), F.col("applied").cast("long").alias("applied"), F.md5(F.col("html").cast("binary")).alias("html_md5"))


def record_reports(spark, sf_dir):
    """Markdown reports of the results, and the score read back from them."""
    k = F.col("line_idx")
    some = lambda n, *texts: F.when(k % n == 0, F.array(*texts)).otherwise(F.array().cast("array<string>"))
    dim = lambda d, n: F.struct(F.col(d).alias("score"), F.when(k % n == 0, F.concat(F.lit("r"), (k % 10).cast("string"))).alias("reason")).alias(d)
    errors = F.transform(F.sequence(F.lit(1), k % 11), lambda i: F.struct(F.when(i % 4 != 0, F.concat(F.lit("p"), i.cast("string"))).alias("probe"), F.lit("slow").alias("error")))
    errors = F.when(k % 11 > 0, errors).otherwise(F.slice(errors, 1, 0))
    agent = F.struct((k % 2 == 0).alias("ran"), (k % 7).alias("steps"), (k % 6 == 0).alias("completed"), F.when(k % 2 == 0, F.repeat(F.lit("word "), (k % 900).cast("int"))).alias("summary"))
    static = F.struct((k * 37).alias("html_size"), *((k % n == 0).alias(c) for n, (_, c) in enumerate(R.FLAGS, 2)), some(3, F.lit("a"), F.lit("b")).alias("external"), some(4, F.lit("text"), F.lit("date")).alias("input_types"))
    render = F.struct((k % 3 > 0).alias("rendered"), errors.alias("probe_errors"), some(5, F.lit("e")).alias("console_errors"), some(6, F.lit("x"), F.lit("y")).alias("page_errors"))
    record = F.struct(
        F.col("item_id").alias("id"), F.lit("default").alias("variant"), F.lit("2024-01-02 03:04:05").alias("evaluated"), F.col("sub_type").alias("query"), F.col("total"), F.when(k % 4 > 0, F.col("category")).alias("summary"),
        some(3, F.lit("no sound"), F.concat(F.lit("bug "), k.cast("string"))).alias("bugs"), some(5, F.lit("score")).alias("missing"), some(7, F.lit("colors")).alias("highlights"), some(2, F.lit("a.png"), F.lit("b.png")).alias("screenshots"),
        *(dim(d, n) for n, d in enumerate(R.SCORED, 2)), agent.alias("agent"), static.alias("static"), render.alias("render"),
    )
    rows = _latest(spark, sf_dir).select(k, R.report(record).alias("report"))
    return rows.select("line_idx", F.md5(F.col("report").cast("binary")).alias("report_md5"), R.report_score(F.col("report")).alias("score"))


def button_order(spark, sf_dir):
    """Parts' names as buttons: the six most promising of each brand."""
    from pyspark.sql import Window as W

    label = F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, BUTTONS)), (F.length("p_type") % len(BUTTONS) + 1).cast("int")))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", R.button_priority(label).cast("long").alias("priority"))
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("priority"), "p_partkey")).cast("long"))
    return ranked.where("place <= 6")


def record_chunks(spark, sf_dir):
    rows = positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return rows.groupBy(R.chunk(F.col("row_idx"), 64).alias("chunk")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.sum("o_custkey").alias("customers"))


def guarded_totals(spark, sf_dir):
    """Totals after a repair (the next result of an item) less the penalty for what fell."""
    from pyspark.sql import Window as W

    dims = ("functionality", "interaction", "rendering", "visual_design", "code_quality")
    order = W.partitionBy("item_id").orderBy("line_idx")
    from ..sources.tables import results

    rows = results(spark, sf_dir).select("line_idx", *dims, *(F.lag(d).over(order).alias(f"old_{d}") for d in dims)).where("old_rendering is not null")
    total = guarded({d: F.col(f"old_{d}") for d in dims}, {d: F.col(d) for d in dims})
    return rows.select("line_idx", total.cast("long").alias("guarded"))


def score_intervals(spark, sf_dir):
    """Bootstrap intervals of the averages by difficulty."""
    return S.ordered_intervals(_latest(spark, sf_dir), ["difficulty"])


def model_intervals(spark, sf_dir):
    """Two models by difficulty, with the intervals of their averages and whether these overlap."""
    return S.compare_with_intervals(_latest(spark, sf_dir), "m1", "m2", ("difficulty",))


LATEST = f"WITH {RESULTS_SQL}, latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trial, item_id ORDER BY line_idx DESC) AS rn FROM results_raw) WHERE rn = 1)"
ERRORS = "[" + ", ".join(f"'{m}'" for m in MESSAGES) + "]"
WHOLE = "(regexp_matches(response, '(?is)<html[^>]*>.*?</html>') OR regexp_matches(response, '(?is)```html\\s*\\n.*?<html.*?```') OR contains(response, '```svg'))"
DIMS = ("functionality", "interaction", "rendering", "visual_design", "code_quality")
YES = lambda test, no: f"CASE WHEN {test} THEN 'yes' ELSE '{no}' END"
FLAG = lambda test: f"CASE WHEN {test} THEN 'True' ELSE 'False' END"
NAMED = lambda name, n, texts, none: [f"'## {name} (' || CASE WHEN line_idx % {n} = 0 THEN {len(texts)} ELSE 0 END || ')' || chr(10)", f"CASE WHEN line_idx % {n} = 0 THEN " + " || chr(10) || ".join(f"'{i}. ' || {t}" for i, t in enumerate(texts, 1)) + f" ELSE '{none}' END", "''"]
SHOTS = "CASE WHEN line_idx % 2 = 0 THEN 2 ELSE 0 END"
LINES = [
    "'# HTML Evaluation Report'", "''", "'| Field       | Value |'", "'|-------------|-------|'", "'| ID          | `' || item_id || '` |'", "'| Variant     | default |'", "'| Evaluated   | 2024-01-02 03:04:05 |'",
    "'| **Score**   | **' || total || ' / 100** |'", "''", "'## Task Description'", "''", "sub_type", "''", "'## Scores'", "''", "'| Dimension | Score | Max | Reason |'", "'|-----------|------:|----:|--------|'",
    *(f"'| {name} | ' || {d} || ' | {most} | ' || CASE WHEN line_idx % {n} = 0 THEN 'r' || line_idx % 10 ELSE '' END || ' |'" for n, (d, name, most) in enumerate(
        (("rendering", "Rendering", 5), ("visual_design", "Visual Design", 15), ("functionality", "Functionality", 50), ("interaction", "Interaction", 15), ("code_quality", "Implementation Quality", 15)), 2)),
    "'| **Total** | **' || total || '** | **100** | |'", "''", "'## Summary'", "''", "CASE WHEN line_idx % 4 > 0 THEN category ELSE 'N/A' END", "''", *NAMED("Bugs", 3, ["'no sound'", "'bug ' || line_idx"], "None found."), *NAMED("Missing Features", 5, ["'score'"], "None."),
    *NAMED("Highlights", 7, ["'colors'"], "None."), f"'## Screenshots (' || {SHOTS} || ')' || chr(10)", "CASE WHEN line_idx % 2 = 0 THEN '![a.png](./a.png)' || chr(10) || '![b.png](./b.png)' ELSE 'No render screenshots were available.' END", "''", "'## Agent Test'", "''",
    f"'- Phase ran: ' || {YES('line_idx % 2 = 0', 'no (skipped)')}", "'- Steps: ' || line_idx % 7", f"'- Completed: ' || {YES('line_idx % 6 = 0', 'no')}", "''", "'### Agent Summary'", "''", "CASE WHEN line_idx % 2 = 0 THEN substr(repeat('word ', CAST(line_idx % 900 AS INT)), 1, 3000) ELSE '(not run)' END", "''",
    "'## Technical Details'", "''", "'- HTML size: ' || format('{:,}', line_idx * 37) || ' chars'", "'- ' || " + " || '  |  ' || ".join(f"'{name}: ' || {FLAG(f'line_idx % {n} = 0')}" for n, name in enumerate(("Canvas", "JS", "CSS", "SVG", "rAF"), 2)),
    "'- External resources: ' || CASE WHEN line_idx % 3 = 0 THEN 2 ELSE 0 END", "'- Input types: ' || CASE WHEN line_idx % 4 = 0 THEN 'text, date' ELSE 'none' END", f"'- Rendered: ' || {FLAG('line_idx % 3 > 0')}", f"'- Render screenshots: ' || {SHOTS}",
    "'- Render probe errors: ' || line_idx % 11", "'- Console errors: ' || CASE WHEN line_idx % 5 = 0 THEN 1 ELSE 0 END", "'- JS exceptions: ' || CASE WHEN line_idx % 6 = 0 THEN 2 ELSE 0 END",
]
REPORT = " || chr(10) || ".join(LINES) + """ || CASE WHEN line_idx % 11 > 0 THEN chr(10) || chr(10) || '## Render Warnings' || chr(10) || chr(10) || array_to_string(list_transform(range(1, least(8, line_idx % 11) + 1), lambda i: i || '. `' || CASE WHEN i % 4 = 0 THEN 'unknown' ELSE 'p' || i END || '`: slow'), chr(10)) ELSE '' END"""
ORACLES = {
    "parsed_records": """WITH g AS (SELECT conv_id AS k, arg_min(text, turn) FILTER (role = 'user') AS q, arg_min(text, turn) FILTER (role = 'assistant') AS r FROM conversations GROUP BY conv_id)
      SELECT k AS line_idx, CASE k % 3 WHEN 0 THEN 'id' || k WHEN 1 THEN CAST(k * 10 AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS stable_id, md5(coalesce(q, '')) AS query_md5, md5(coalesce(r, '')) AS response_md5 FROM g""",
    "record_status": """WITH o AS (SELECT o_custkey * 31 + CAST(floor(o_totalprice) AS BIGINT) AS k FROM orders)
      SELECT CASE WHEN k % 11 = 0 THEN 'completed_with_fallback' WHEN k % 5 = 0 THEN 'failed' WHEN k % 13 = 0 OR (k % 7 <> 0 AND k % 2 = 0 AND k % 3 <> 1) THEN 'completed' ELSE 'processing' END AS status, count(*) AS n FROM o GROUP BY 1""",
    "merged_responses": f"""WITH {RESPONSES_SQL}, u AS (SELECT item_id, 0 AS source_rank, response FROM responses UNION ALL SELECT item_id, 1, CASE WHEN length(response) % 3 = 0 THEN 'again ' || response ELSE 'none' END FROM responses)
      SELECT item_id, CAST(max(source_rank) AS BIGINT) AS source_rank, length(arg_max(response, source_rank)) AS size FROM u WHERE {WHOLE} GROUP BY item_id""",
    "generation_errors": f"""WITH e AS (SELECT substr(list_extract({ERRORS}, CAST((conv_id + turn) % {len(MESSAGES)} + 1 AS INT)) || coalesce(text, ''), 1, 500) AS error FROM conversations),
      c AS (SELECT error, CASE WHEN trim(error, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'none' WHEN regexp_matches(lower(error), 'content filter|output blocked|blocked by content|safety policy|policy violation') THEN 'content_filter'
      WHEN regexp_matches(lower(error), '429|rate limit|too many requests') THEN 'rate_limit' WHEN regexp_matches(lower(error), 'timeout|timed out') THEN 'timeout' ELSE 'other' END AS class FROM e)
      SELECT class, count(*) AS n, count(DISTINCT error) AS texts, max(length(error)) AS longest FROM c GROUP BY class""",
    "retry_waits": "SELECT event_type, count(TRY_CAST(regexp_replace(props, '[^0-9.]', '', 'g') AS DOUBLE)) AS waits, max(TRY_CAST(regexp_replace(props, '[^0-9.]', '', 'g') AS DOUBLE)) AS longest, count(TRY_CAST(props AS DOUBLE)) AS whole FROM events GROUP BY 1",
    "latency_stats": """WITH v AS (SELECT l_orderkey, CASE WHEN l_quantity >= 45 THEN -1.0::DOUBLE ELSE round_even(l_quantity * 7, 0) END AS v, l_discount > 0.05::DOUBLE AS ok FROM lineitem)
      SELECT l_orderkey, CAST(round_even(avg(v) FILTER (v >= 0), 0) AS BIGINT) AS avg_latency_ms, min(v) FILTER (v >= 0) AS min_latency_ms, max(v) FILTER (v >= 0) AS max_latency_ms, count(*) FILTER (v < 0) AS interactions_timed_out,
      CASE WHEN count(*) > 1 THEN round_even(count(*) FILTER (ok) / (count(*) - 1), 2) ELSE -1.0 END AS response_rate FROM v GROUP BY l_orderkey""",
    "scorer_clamps": f"""{LATEST}, c AS (SELECT line_idx, CASE WHEN line_idx % 10 = 0 THEN least(rendering, 2) ELSE rendering END AS rendering, visual_design, CASE WHEN line_idx % 6 = 0 THEN least(functionality, 15) ELSE functionality END AS functionality,
      CASE WHEN line_idx % 6 = 0 OR (line_idx % 7 < 3 AND line_idx % 4 >= 2) THEN least(interaction, 8) ELSE interaction END AS interaction, code_quality FROM latest) SELECT *, rendering + visual_design + functionality + interaction + code_quality AS total FROM c""",
    "value_changes": """WITH e AS (SELECT event_id, event_id + CAST(floor(value) AS BIGINT) AS k FROM events), c AS (SELECT event_id, k, k % 4 <> k % 5 AS a, k % 5 <> k % 6 AS o FROM e)
      SELECT event_id, CAST(a AS BIGINT) + CAST(o AS BIGINT) AS changed, CASE WHEN a THEN 'a' ELSE '' END || CASE WHEN a AND o THEN ',' ELSE '' END || CASE WHEN NOT o THEN '' WHEN k % 2 = 0 THEN 'c' ELSE 'd' END AS keys FROM c""",
    "page_patches": """WITH t AS (SELECT page_id, html, (length(html) - length(replace(html, '</title>', ''))) / 8 AS titles, (length(html) - length(replace(html, '<p>', ''))) / 3 AS ps FROM pages),
      a AS (SELECT *, CASE WHEN titles = 1 THEN replace(html, '</title>', '!</title>') ELSE html END AS h1 FROM t), b AS (SELECT *, CASE WHEN ps = 1 THEN replace(h1, '<p>', '<q>') ELSE h1 END AS h2 FROM a), n AS (SELECT *, (length(h2) - length(replace(h2, '!</title>', ''))) / 9 AS again FROM b),
      d AS (SELECT *, CASE WHEN again = 1 THEN replace(h2, '!</title>', '?</title>') ELSE h2 END AS h3 FROM n)
      SELECT page_id, CAST(titles = 1 AS BIGINT) + CAST(ps = 1 AS BIGINT) + CAST(again = 1 AS BIGINT) AS applied, CAST(3 AS BIGINT) AS total, md5(h3) AS html_md5, length(h3) >= 200 AS valid FROM d""",
    "page_loose_patches": """WITH p AS (SELECT page_id, regexp_replace(html, '><', '>' || chr(10) || '    <', 'g') AS html FROM pages)
      SELECT page_id, CAST(1 AS BIGINT) AS applied, md5(replace(html, chr(10) || '    <body>' || chr(10), chr(10) || '    <body class=''a''>' || chr(10))) AS html_md5 FROM p""",
    "record_reports": f"""{LATEST}, r AS (SELECT line_idx, total, {REPORT} AS report FROM latest) SELECT line_idx, md5(report) AS report_md5, total AS score FROM r""",
    "button_order": f"""WITH b AS (SELECT p_brand, p_partkey, lower(p_name || ' ' || list_extract([{", ".join(f"'{w}'" for w in BUTTONS)}], CAST(length(p_type) % {len(BUTTONS)} + 1 AS INT))) AS n FROM part),
      p AS (SELECT p_brand, p_partkey, CAST(CASE WHEN regexp_matches(n, 'start|play|begin|submit|initiate|开始') THEN 100 WHEN regexp_matches(n, 'next|continue|ok|confirm|新建|继续') THEN 50
      WHEN regexp_matches(n, 'cancel|close|back|return|菜单') THEN 10 ELSE 50 END AS BIGINT) AS priority FROM b)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY priority DESC, p_partkey) AS place FROM p) WHERE place <= 6""",
    "record_chunks": "WITH r AS (SELECT *, row_number() OVER () - 1 AS i FROM orders) SELECT i // 64 AS chunk, count(*) AS n, min(o_orderkey) AS low, CAST(sum(o_custkey) AS BIGINT) AS customers FROM r GROUP BY 1",
    "guarded_totals": f"""WITH {RESULTS_SQL}, p AS (SELECT *, {", ".join(f"lag({d}) OVER w AS old_{d}" for d in DIMS)} FROM results_raw WINDOW w AS (PARTITION BY item_id ORDER BY line_idx)),
      f AS (SELECT line_idx, {" + ".join(DIMS)} AS new, {" + ".join(f"old_{d}" for d in DIMS)} AS old, {", ".join(f"CASE WHEN old_{d} - {d} > 2 THEN old_{d} - {d} ELSE 0 END AS f_{d}" for d in DIMS)} FROM p WHERE old_rendering IS NOT NULL),
      g AS (SELECT *, CASE WHEN old >= 85 THEN 2 * f_functionality + 2 * f_interaction + f_rendering + f_visual_design + f_code_quality ELSE 3 * f_functionality + 3 * f_interaction + 2 * f_rendering + 2 * f_visual_design END AS penalty FROM f)
      SELECT line_idx, CAST(new - CASE WHEN new - old >= 3 THEN least(penalty, floor((new - old) / 2)) ELSE penalty END AS BIGINT) AS guarded FROM g""",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "score_intervals", "model_intervals"]}
