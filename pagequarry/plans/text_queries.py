"""Queries over texts of pages, answers and consoles, and over JSON lines in files."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import texts as T
from ..operators import quality as Q
from ..sources import jsonl
from ..sources.staging import folder
from ..sources.tables import PAGES_SQL, RESPONSES_SQL, RESULTS_SQL, responses, results, rich_pages, table
from .analysis_queries import _latest
from .quality_queries import STEPS, _in, items

MAXIMA = {"rendering": 10, "visual_design": 20, "functionality": 55, "interaction": 10, "code_quality": 5}
CONSOLE = ("Failed to load resource: ", "Uncaught TypeError in ", "NET::ERR_ABORTED ", "Cannot allocate memory for ", "Blocked by CORS policy: ")
DEMANDS = ("A Self-Contained page", "a button", "uses a CDN", "plain HTML", "three cards", "external dependencies")


def page_kept_features(spark, sf_dir):
    return rich_pages(spark, sf_dir).select("page_id", *(c.alias(n) for n, c in T.visual_features(F.col("html")).items()))


def page_missing_tags(spark, sf_dir):
    wanted = F.array(*map(F.lit, ("header", "nav", "main", "article", "aside", "footer")))
    return rich_pages(spark, sf_dir).select("page_id", F.array_join(T.missing_tags(F.col("html"), wanted), ",").alias("missing"))


def repair_answers(spark, sf_dir):
    """Pages in answers that begin with thinking which quotes a page itself."""
    text = F.concat(F.lit("<think>maybe\n```html\n<html>x</html>\n```\n</think>\n"), "response")
    rows = responses(spark, sf_dir).select("item_id", T.repaired_page(text).alias("page"), T.is_page(F.col("response")).alias("whole"))
    return rows.select("item_id", F.md5(F.coalesce("page", F.lit("")).cast("binary")).alias("page_md5"), "whole", T.is_page(F.col("page")).alias("valid"))


def json_answers(spark, sf_dir):
    """Events' properties inside thinking, fences and prose."""
    kind = F.length("props") % 3
    text = F.when(kind == 0, F.concat(F.lit("<think>{no}</think>```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("It is "), "props", F.lit(" so."))).otherwise(F.concat("props", F.lit(" {")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(T.json_answer(text), "$.k", "bigint").alias("k"))


def console_entries(spark, sf_dir):
    """Console messages that quote the pages' addresses, by what they say about the page."""
    text = F.concat(F.element_at(F.array(*map(F.lit, CONSOLE)), (F.length("html") % len(CONSOLE) + 1).cast("int")), "url")
    rows = table(spark, sf_dir, "pages").select(T.is_benign(text).alias("benign"), T.is_resource_error(text).alias("resource"))
    return rows.groupBy("benign", "resource").agg(F.count("*").alias("n"))


def requirement_audit(spark, sf_dir):
    """Requirements of conversations: a turn is one, with a state by its length and a demand beside its text."""
    demand = F.element_at(F.array(*map(F.lit, DEMANDS)), (F.length("text") % len(DEMANDS) + 1).cast("int"))
    state = F.when(F.length("text") % 4 == 0, "done").when(F.length("text") % 4 == 1, "broken").when(F.length("text") % 4 == 2, "missing")
    one = F.struct(demand.alias("requirement"), state.alias("status"), F.col("text").alias("evidence"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(one).alias("r"))  # a conversation's turns are few
    return grouped.select("conv_id", T.requirement_summary(F.col("r")).alias("s")).select("conv_id", "s.*")


def weak_dimensions(spark, sf_dir):
    names = T.weak_dimensions(F.struct(*MAXIMA), MAXIMA)
    return _latest(spark, sf_dir).select("line_idx", F.array_join(names, ",").alias("weakest"))


def interactive_pages(spark, sf_dir):
    """Pages by whether they want interaction; types, observations and summaries come from parts."""
    kind = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Static "), "p_type")).when(F.col("p_size") % 7 == 0, F.concat(F.lit("Tool "), "p_type")).otherwise(F.col("p_brand"))
    seen, asked = F.array("p_name", F.when(F.col("p_size") % 11 == 0, "Button works").otherwise("")), F.array(F.when(F.col("p_size") % 13 == 0, "needs control").otherwise(F.col("p_name")))
    price = F.floor("p_retailprice").cast("long")
    summary = F.when(price % 3 == 0, F.concat(F.lit("A scene with "), "p_name")).otherwise(F.col("p_type"))
    found = T.is_interactive(kind, seen, asked, price % 17 == 0, price % 26, price % 30, summary)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("interactive"))


def contrastive_texts(spark, sf_dir):
    k = F.col("o_custkey")
    some = lambda n, *c: F.slice(F.array(*c), F.lit(1), (k % n).cast("int"))
    before, after = k % 101, F.floor("o_totalprice").cast("long") % 101
    text = T.contrastive_feedback(k % 7, before, after, some(3, "o_orderpriority", "o_orderstatus"), some(2, "o_orderpriority"), some(4, F.lit("a"), F.lit("b"), F.lit("c")), F.when(k % 5 == 0, F.col("o_orderstatus")).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.md5(text.cast("binary")).alias("text_md5"))


def model_slugs(spark, sf_dir):
    raw = F.concat_ws("/", F.lit("org"), "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.when(F.col("p_size") % 3 == 0, ""))
    path = F.concat_ws("/", F.lit("/data"), F.when(F.col("p_size") % 3 == 0, "zh"), F.when(F.col("p_size") % 4 == 0, "en").otherwise(F.col("p_brand")))
    rows = table(spark, sf_dir, "part").select(T.model_slug(raw).alias("slug"), T.edition(path, F.when(F.col("p_size") % 5 == 0, "").otherwise("fr")).alias("edition"))
    return rows.groupBy("slug", "edition").agg(F.count("*").alias("n"))


def parsed_cases(spark, sf_dir):
    """Test cases as a runner takes them: defaults for what is missing, an error instead of a case with an unknown action."""
    return Q.parsed_cases(items(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("cases"), F.sum(F.size("steps")).alias("steps"), F.sum("weight").alias("weight"), F.count_if(F.col("name") == "").alias("unnamed"), F.count_if(F.col("id").startswith("tc_")).alias("numbered"))


def accepted_iterations(spark, sf_dir):
    """Iterations of an item's results: accepted if better than all before, their strategy (the model) blacklisted after a fall of over eight."""
    order = W.partitionBy("item_id").orderBy("line_idx")
    rows = results(spark, sf_dir).withColumn("best", F.max("total").over(order.rowsBetween(W.unboundedPreceding, -1))).where("best is not null")
    delta = F.col("total") - F.col("best")
    return rows.groupBy("model").agg(F.count_if(delta > 0).alias("accepted"), F.count_if(delta < -8).alias("blacklisted"), F.count("*").alias("n"))


def best_candidates(spark, sf_dir):
    """The best of each order's candidates (lines) by composite score; the first of equals."""
    composite, nth = F.floor("l_quantity").cast("long"), F.struct("l_linenumber", "l_partkey", "l_suppkey")
    best = F.min_by(F.col("l_partkey"), F.struct(-composite, nth))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best.alias("chosen"), F.max(composite).alias("composite"))


def jsonl_files(spark, sf_dir):
    """Results written as JSON lines, with blank and broken lines between them, and read back with line numbers."""
    line = F.to_json(F.struct(F.col("item_id").alias("line_number"), "trial", "eval_status", F.struct("total", "rendering").alias("score")))
    shown = results(spark, sf_dir).select(F.when(F.col("line_idx") % 50 == 0, "").when(F.col("line_idx") % 50 == 1, "{broken").otherwise(line).alias("value"))
    path = f"{folder(spark)}/lines-{jsonl_name()}"
    jsonl.write_lines(shown, path)
    rows = jsonl.lines(spark, path, "line_number string, trial long, eval_status string, score struct<total:long, rendering:long>")
    # Blank and broken lines count as lines, but how rows are dealt to files isn't fixed: numbers are only compared with each other.
    apart = rows.groupBy("file").agg((F.count("*") == F.countDistinct("line_idx")).alias("unique"))
    return rows.groupBy("eval_status", "trial").agg(F.count("*").alias("n"), F.sum("score.total").alias("total")).crossJoin(F.broadcast(apart.agg(F.bool_and("unique").alias("numbered"))))


def jsonl_name() -> str:
    import uuid

    return uuid.uuid4().hex


def jsonl_runs(spark, sf_dir):
    """Runs laid out in folders by group, configuration and model: written per model, found and named by their paths."""
    root = f"{folder(spark)}/runs-{jsonl_name()}"
    rows = results(spark, sf_dir).select("model", F.to_json(F.struct("item_id", "total")).alias("value"))
    for i in range(5):
        group = "sft__x__y" if i % 2 else "plain"
        jsonl.write_lines(rows.where(F.col("model") == f"m{i}"), f"{root}/outputs/{group}/m{i}/en/full/results.jsonl")
    return jsonl.runs(spark, root, "item_id string, total long").groupBy("group", "config", "model").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


def sidecar_results(spark, sf_dir):
    """Results' sidecar files: the first of three candidate paths that a listing has."""
    k = F.col("line_idx")
    rows = results(spark, sf_dir).select(k.cast("string").alias("uid"), F.array(*(F.concat(F.lit(d), "model", F.lit("/"), k.cast("string")) for d in ("new/", "old/", ""))).alias("candidates"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    place = F.when(F.col("l_returnflag") == "A", "new/").when(F.col("l_returnflag") == "R", "old/").otherwise("")
    listing = line.select(F.concat(place, F.lit("m"), (F.col("k") % 5).cast("string"), F.lit("/"), F.col("k").cast("string")).alias("path"))
    found = jsonl.first_existing(rows, "candidates", listing)
    return found.groupBy(F.regexp_extract("found", "^(new|old)/", 1).alias("folder")).agg(F.count("*").alias("n"), F.count("found").alias("found"))


PICK = lambda values, at: "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], CAST({at} % {len(values)} + 1 AS INT))"
COUNT = lambda text, pattern: "len(regexp_extract_all(" + text + ", '" + pattern.replace("'", "''") + "'))"
ANY = lambda text, words: "(" + " OR ".join("contains(lower(" + text + "), '" + w.replace("'", "''") + "')" for w in words) + ")"
NOT_SCORED = "|".join(T.NOT_SCORED)
SQL_FEATURES = [f"{COUNT('lower(html)', p)} AS {n}" for n, p in T.COUNTED.items()]
SQL_FEATURES += [" + ".join(f"CAST(contains(lower(html), '{w}') AS BIGINT)" for w in words) + f" AS {n}" for n, words in T.MARKED.items()]
SQL_FEATURES += [f"{COUNT('html', T.IMAGES)} AS images", f"{COUNT('html', T.EMOJI)} AS emoji"]
SHARES = ", ".join(f"{{'s': {n}::DOUBLE / {most}, 'i': {i}, 'n': '{n}'}}" for i, (n, most) in enumerate(MAXIMA.items()))
CLEAN = "trim(response, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
VALID = lambda c: f"coalesce(length({c}) >= 200 AND (contains(lower({c}), '</html>') OR contains(lower({c}), '</body>') OR (regexp_matches(lower({c}), '^\\s*(<!doctype|<html)') AND length({c}) >= 500)), false)"
ORACLES = {
    "page_kept_features": f"WITH {PAGES_SQL} SELECT page_id, {', '.join(SQL_FEATURES)} FROM rich",
    "page_missing_tags": f"""WITH {PAGES_SQL} SELECT page_id, array_to_string(list_filter(['header', 'nav', 'main', 'article', 'aside', 'footer'], lambda t: NOT list_contains(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1), t)), ',') AS missing FROM rich""",
    "repair_answers": f"""WITH {RESPONSES_SQL}, c AS (SELECT item_id, response, {STRIP("response")} AS clean FROM responses), f AS (SELECT *, list_filter(list_transform(regexp_extract_all(clean, '(?is)```(?:html)?\\s*\\n(.*?)\\s*```', 1), lambda p: {STRIP("p")}), lambda p: length(p) >= 200)[1] AS fenced,
        regexp_extract(clean, '(?is)(<!DOCTYPE.*?</html>|<html.*?</html>)', 1) AS tagged FROM c),
      p AS (SELECT *, coalesce(fenced, CASE WHEN length(tagged) >= 200 THEN tagged END, CASE WHEN regexp_matches(lower(clean), '^(<!doctype|<html)') AND length(clean) >= 200 THEN clean END) AS page FROM f)
      SELECT item_id, md5(coalesce(page, '')) AS page_md5, {VALID("response")} AS whole, {VALID("page")} AS valid FROM p""",
    "json_answers": """SELECT event_id, CASE WHEN length(props) % 3 < 2 THEN CAST(regexp_extract(props, '"k": *([0-9-]+)', 1) AS BIGINT) WHEN length(props) % 3 = 2 THEN CAST(regexp_extract(props, '"k": *([0-9-]+)', 1) AS BIGINT) END AS k FROM events""",
    "console_entries": f"""WITH t AS (SELECT {PICK(CONSOLE, "length(html)")} || url AS t FROM pages) SELECT {ANY("t", T.BENIGN)} AS benign, {ANY("t", T.RESOURCE)} AS resource, count(*) AS n FROM t GROUP BY 1, 2""",
    "requirement_audit": f"""WITH r AS (SELECT conv_id, {PICK(DEMANDS, "length(text)")} AS q, text, CASE length(text) % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'broken' ELSE 'missing' END AS s FROM conversations),
      k AS (SELECT *, NOT (regexp_matches(lower(q), '{NOT_SCORED}') OR regexp_matches(lower(coalesce(text, '')), '{NOT_SCORED}')) AS kept FROM r)
      SELECT conv_id, count(*) FILTER (kept) AS total, count(*) FILTER (kept AND s = 'done') AS done, count(*) FILTER (kept AND s = 'broken') AS broken, count(*) FILTER (kept AND s = 'missing') AS missing FROM k GROUP BY conv_id""",
    "weak_dimensions": f"""WITH {RESULTS_SQL}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial, item_id ORDER BY line_idx DESC) AS rn FROM results_raw) WHERE rn = 1)
      SELECT line_idx, array_to_string(list_transform(list_sort([{SHARES}]), lambda d: d.n), ',') AS weakest FROM latest""",
    "interactive_pages": f"""WITH p AS (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS price, CASE WHEN p_size % 5 = 0 THEN 'Static ' || p_type WHEN p_size % 7 = 0 THEN 'Tool ' || p_type ELSE p_brand END AS kind, CASE WHEN p_size % 11 = 0 THEN 'Button works' ELSE '' END AS s2,
        CASE WHEN p_size % 13 = 0 THEN 'needs control' ELSE p_name END AS a FROM part), q AS (SELECT *, CASE WHEN price % 3 = 0 THEN 'A scene with ' || p_name ELSE p_type END AS summary FROM p)
      SELECT p_partkey, CASE WHEN {ANY("kind", T.STILL_TYPES)} THEN false WHEN {ANY("kind", T.USED_TYPES)} THEN true WHEN {ANY("p_name", T.SEEN_ACTIONS)} OR {ANY("s2", T.SEEN_ACTIONS)} OR {ANY("a", T.ASKED_ACTIONS)} THEN true
        WHEN price % 17 = 0 OR price % 26 >= 20 THEN true ELSE NOT (price % 30 >= 22 AND price % 26 < 18 AND {ANY("summary", T.STILL_WORDS)}) END AS interactive FROM q""",
    "contrastive_texts": """WITH o AS (SELECT o_orderkey, o_custkey AS k, o_custkey % 101 AS b, CAST(floor(o_totalprice) AS BIGINT) % 101 AS a, o_orderpriority AS p, o_orderstatus AS s FROM orders)
      SELECT o_orderkey, md5('## Contrastive Visual Feedback (iteration ' || (k % 7) || ': ' || b || ' → ' || a || ', ' || CASE WHEN a >= b THEN '+' ELSE '' END || (a - b) || ')'
        || CASE WHEN k % 3 > 0 THEN chr(10) || chr(10) || 'What improved after last repair:' || chr(10) || '  + ' || p || CASE WHEN k % 3 = 2 THEN chr(10) || '  + ' || s ELSE '' END ELSE '' END
        || CASE WHEN k % 2 = 1 THEN chr(10) || chr(10) || 'What REGRESSED (MUST fix — do not repeat this mistake):' || chr(10) || '  ! ' || p ELSE '' END
        || CASE WHEN k % 4 > 0 THEN chr(10) || chr(10) || 'Issues still present (focus here):' || chr(10) || '  - a' || CASE WHEN k % 4 > 1 THEN chr(10) || '  - b' ELSE '' END || CASE WHEN k % 4 > 2 THEN chr(10) || '  - c' ELSE '' END ELSE '' END
        || CASE WHEN k % 5 = 0 THEN chr(10) || chr(10) || 'Priority for this iteration: ' || s ELSE '' END) AS text_md5 FROM o""",
    "model_slugs": """SELECT lower(CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END) AS slug, CASE WHEN p_size % 4 = 0 THEN 'en' WHEN p_size % 3 = 0 THEN 'zh' WHEN p_size % 5 = 0 THEN 'mixed' ELSE 'fr' END AS edition, count(*) AS n FROM part GROUP BY 1, 2""",
    "parsed_cases": f"""{STEPS}, c AS (SELECT ik, tc_id, any_value(name) AS name, count(*) AS n, arg_min(action, pos) FILTER (action NOT IN {_in(Q.ACTIONS)}) AS bad FROM m GROUP BY 1, 2)
      SELECT 'Unknown test action: ' || bad AS error, count(*) AS cases, CAST(sum(CASE WHEN bad IS NULL THEN n ELSE 0 END) AS BIGINT) AS steps, count(*)::DOUBLE AS weight, count(*) FILTER (name IS NULL) AS unnamed, CAST(0 AS BIGINT) AS numbered FROM c GROUP BY 1""",
    "accepted_iterations": f"""WITH {RESULTS_SQL}, b AS (SELECT *, max(total) OVER (PARTITION BY item_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM results_raw)
      SELECT model, count(*) FILTER (total > best) AS accepted, count(*) FILTER (total - best < -8) AS blacklisted, count(*) AS n FROM b WHERE best IS NOT NULL GROUP BY model""",
    "best_candidates": """WITH r AS (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(floor(l_quantity) AS BIGINT) DESC, l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem) SELECT l_orderkey, l_partkey AS chosen, c AS composite FROM r WHERE nth = 1""",
    "jsonl_files": f"WITH {RESULTS_SQL} SELECT eval_status, trial, count(*) AS n, CAST(sum(total) AS BIGINT) AS total, true AS numbered FROM results_raw WHERE line_idx % 50 > 1 GROUP BY 1, 2",
    "jsonl_runs": f"""WITH {RESULTS_SQL} SELECT CASE WHEN model IN ('m1', 'm3') THEN 'sft' ELSE 'unknown' END AS "group", CASE WHEN model IN ('m1', 'm3') THEN 'x__y' ELSE 'plain' END AS config, model, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM results_raw GROUP BY model""",
    "sidecar_results": f"""WITH {RESULTS_SQL}, l AS (SELECT l_orderkey AS k, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) AS place FROM lineitem GROUP BY 1)
      SELECT CASE place WHEN 0 THEN 'new' WHEN 1 THEN 'old' WHEN 2 THEN '' END AS folder, count(*) AS n, count(place) AS found FROM results_raw LEFT JOIN l ON line_idx = k GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
