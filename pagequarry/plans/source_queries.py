"""Queries over files: benchmark folders, sorted lookups, traces' heads, artifacts and sidecars by a listing.  The files are written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import benchmark as M
from ..sources import jsonl, listing, lookup
from ..sources.staging import folder
from ..sources.tables import RESULTS_SQL, results, table

CATEGORIES = ("game", "app", "landing", " content_marketing ", "own")


def _place(spark, name):
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _folder(spark, sf_dir):
    """A benchmark's folder: customers as lines of the English edition, nations as whole files of the Chinese one, suppliers beside them."""
    k = F.col("c_custkey")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (k % 5 + 1).cast("int"))
    cases = F.array(F.struct(k.cast("string").alias("id"), F.array(F.struct(F.lit("wait").alias("action"), (k % 7).alias("ms"))).alias("steps")))
    item = F.struct(k.cast("string").alias("id"), F.when(k % 9 != 0, "en").alias("language"), F.col("c_name").alias("prompt"), category.alias("category"), F.when(k % 3 == 0, "hard").otherwise("easy").alias("difficulty"), cases.alias("test_cases"))
    root = _place(spark, "benchmark")
    jsonl.write_lines(table(spark, sf_dir, "customer").select(F.when(k % 40 == 3, "").when(k % 40 == 4, "{broken").otherwise(F.to_json(item)).alias("value")), f"{root}/en/apps")
    n = F.col("n_nationkey")
    whole = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("id"), F.lit("zh").alias("language"), F.col("n_name").alias("prompt"), F.lit("game").alias("category"), F.lit("hard").alias("difficulty"))
    whole.repartitionByRange(25, "id").write.json(f"{root}/zh")  # an object per file
    jsonl.write_lines(table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.col("s_name").alias("id"))).alias("value")), f"{root}/responses")
    return root


def benchmark_folder(spark, sf_dir):
    rows = M.benchmark(spark, _folder(spark, sf_dir), lines="*.txt")
    return rows.select("id", "language", "category", "source_category", "difficulty", F.try_variant_get("test_cases", "$[0].steps[0].ms", "long").alias("ms"))


def benchmark_filtered(spark, sf_dir):
    """Hard games of the English edition; language and difficulty reach the reader of JSON."""
    rows = M.benchmark(spark, _folder(spark, sf_dir), language="en", category="games_simulations,landing", difficulty="hard", lines="*.txt")
    return rows.groupBy("category", "source_category").agg(F.count("*").alias("n"), F.min("prompt").alias("first"))


def record_lookup(spark, sf_dir):
    """Lines of a few orders out of a sorted table."""
    path = _place(spark, "lookup")
    lookup.build(table(spark, sf_dir, "lineitem"), "l_orderkey", path, parts=16)
    return lookup.find(spark, path, "l_orderkey", [1, 700, 701, 10**12]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def trace_heads(spark, sf_dir):
    """Traces of the orders' lines with long pages, of which only the heads are looked at."""
    k, page = F.col("l_orderkey"), F.repeat(F.lit("page "), 2000)
    rid = F.when(k % 17 != 0, F.concat(F.lit('"record_id" : "r'), k.cast("string"), F.lit('", ')))
    score = F.when(k % 5 != 0, F.concat(F.lit('"final_score": '), (k % 101).cast("string"), F.lit(", ")))
    gain = F.concat(F.lit('"improvement": '), (F.col("l_linenumber") - 3).cast("string"))
    body = F.concat(F.lit('"best_html": "'), page, F.lit('"'))
    value = F.concat(F.lit("{"), F.coalesce(rid, F.lit("")), F.coalesce(score, F.lit("")), F.when(k % 7 == 0, F.concat(body, F.lit(", "), gain)).otherwise(F.concat(gain, F.lit(", "), body)), F.lit("}"))
    order = F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 10_000_000 + F.col("l_suppkey")
    return lookup.trace_heads(table(spark, sf_dir, "lineitem").select(value.alias("value"), order.alias("line_idx")))


def _records(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("uid"), F.concat(F.lit("d"), (k % 3).cast("string")).alias("dataset"), (k * 2).alias("line_number"))


def _pages(spark, sf_dir):
    """A listing of pages: which of a record's folders are there depends on its lines."""
    k, q = F.col("l_orderkey"), F.col("l_quantity").cast("long")
    uid, dataset = k.cast("string"), F.concat(F.lit("d"), (k % 3).cast("string"))
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("/game.html"))
    path = (
        F.when(q % 6 == 0, put(dataset, "_", (k * 2).cast("string"), "_default")).when(q % 6 == 1, put("repairtest_", uid, "_test")).when(q % 6 == 2, put("repairtest_", uid, "_repair_1_repair"))
        .when(q % 6 == 3, put("repairtest_", uid, "_repair_2_repair")).when(q % 6 == 4, put(dataset, "_", uid, "_repair_1_repair")).otherwise(put(dataset, "_", uid, "_repair_3_repair"))
    )
    return table(spark, sf_dir, "lineitem").select(path.alias("relative"))


def page_artifacts(spark, sf_dir):
    """Every record's five kinds of pages."""
    records = _records(spark, sf_dir)
    k = F.col("line_number") / 2
    traced = lambda n: records.where(k % n == 0).select(F.concat("dataset", F.lit("_"), "uid").alias("record_id"))
    return listing.page_paths(records, _pages(spark, sf_dir), traced(2), traced(3))


def record_screenshots(spark, sf_dir):
    """Screenshots of records by their own paths, annotations or the files in their folder, three at most."""
    k, line = F.col("o_orderkey"), F.col("l_linenumber")
    own = F.concat(F.lit("rec"), k.cast("string"))
    records = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("uid"), own.alias("folder"), F.when(k % 3 == 0, F.array(F.concat(own, F.lit("/frame_2.png")), F.lit(""), F.concat(own, F.lit("/frame_1.png")), F.concat(own, F.lit("/frame_2.png")))).otherwise(F.array().cast("array<string>")).alias("shots"),
        F.when(k % 3 == 1, F.array(F.lit("frame_5.png"), F.lit(""), F.lit("frame_3.png"))).otherwise(F.array().cast("array<string>")).alias("annotated"),
    )
    there = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("rec"), F.col("l_orderkey").cast("string"), F.lit("/"), F.when(line == 7, "other").otherwise("frame"), F.lit("_"), line.cast("string"), F.lit(".png")).alias("relative")).distinct()
    shots = listing.screenshots(records, there, limit=3)
    return shots.select("uid", F.array_join("shots", ",").alias("shots"))


def sidecar_contents(spark, sf_dir):
    """Results with what their sidecar files hold: files are written by folder, read once and joined by path."""
    root = _place(spark, "sidecars")
    own = results(spark, sf_dir).select("model", F.to_json(F.struct(F.col("line_idx"), F.col("tests_passed").alias("passed"), F.col("tests_total").alias("total"))).alias("value"))
    own.repartition("model").write.partitionBy("model").text(root)
    read = spark.read.option("recursiveFileLookup", "true").text(root).select(F.regexp_extract(F.col("_metadata.file_path"), "model=([^/]+)/", 1).alias("model"), F.from_json("value", "line_idx long, passed long, total long").alias("r"))
    contents = read.select(F.concat("model", F.lit("/"), F.col("r.line_idx").cast("string")).alias("file"), "r.passed", "r.total")
    k = F.col("line_idx")
    rows = results(spark, sf_dir).select(k, F.when(k % 4 != 0, F.concat("model", F.lit("/"), k.cast("string"))).otherwise("none").alias("results_path"))
    found = listing.sidecars(rows, "results_path", contents)
    return found.select("line_idx", F.col("sidecar.passed").alias("passed"), F.col("sidecar.total").alias("total"))


CASE = lambda k: "list_extract([" + ", ".join(f"'{c.strip()}'" for c in CATEGORIES) + f"], CAST({k} % 5 + 1 AS INT))"
FAMILY = "CASE {c} WHEN 'game' THEN 'games_simulations' WHEN 'app' THEN 'apps_tools' WHEN 'landing' THEN 'content_marketing' ELSE {c} END"
ITEMS = f"""c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN 'en' END AS language, c_name AS prompt, {CASE("c_custkey")} AS raw, CASE WHEN c_custkey % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty FROM customer WHERE c_custkey % 40 NOT IN (3, 4)),
  items AS (SELECT id, language, prompt, {FAMILY.format(c="raw")} AS category, CASE WHEN raw IN ('game', 'app', 'landing') THEN raw END AS source_category, difficulty, k % 7 AS ms FROM c
    UNION ALL SELECT 'n' || n_nationkey, 'zh', n_name, 'games_simulations', 'game', 'hard', NULL FROM nation)"""
ORACLES = {
    "benchmark_folder": f"WITH {ITEMS} SELECT id, language, category, source_category, difficulty, ms FROM items",
    "benchmark_filtered": f"WITH {ITEMS} SELECT category, source_category, count(*) AS n, min(prompt) AS first FROM items WHERE language = 'en' AND difficulty = 'hard' AND (category = 'games_simulations' OR source_category = 'landing') GROUP BY 1, 2",
    "record_lookup": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (1, 700, 701)",
    "trace_heads": """WITH t AS (SELECT 'r' || l_orderkey AS record_id, CASE WHEN l_orderkey % 5 <> 0 THEN l_orderkey % 101 ELSE 0 END AS final_score, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE l_linenumber - 3 END AS improvement, l_linenumber * 1000000000000 + l_partkey * 10000000 + l_suppkey AS seq FROM lineitem WHERE l_orderkey % 17 <> 0)
      SELECT record_id, arg_max(final_score, seq) AS final_score, arg_max(improvement, seq) AS improvement FROM t GROUP BY 1""",
    "page_artifacts": """WITH l AS (SELECT DISTINCT l_orderkey AS k, CAST(floor(l_quantity) AS BIGINT) % 6 AS q FROM lineitem), h AS (SELECT k, list(q) AS q FROM l GROUP BY k),
      o AS (SELECT o_orderkey AS k, coalesce(q, []) AS q, 'd' || o_orderkey % 3 || '_' || 2 * o_orderkey || '_default/game.html' AS own, 'd' || o_orderkey % 3 || '_' || o_orderkey AS run, 'repairtest_' || o_orderkey AS test FROM orders LEFT JOIN h ON k = o_orderkey),
      r AS (SELECT *, CASE WHEN list_contains(q, 5) THEN run || '_repair_3_repair/game.html' WHEN list_contains(q, 4) THEN run || '_repair_1_repair/game.html' END AS last, CASE WHEN list_contains(q, 0) THEN own END AS scored FROM o)
      SELECT CAST(k AS VARCHAR) AS uid, kind, CASE WHEN kind IN ('original', 'refine_orig') THEN scored WHEN kind = 'repair_orig' THEN CASE WHEN list_contains(q, 1) THEN test || '_test/game.html' ELSE scored END
        WHEN kind = 'repaired' THEN CASE WHEN list_contains(q, 3) THEN test || '_repair_2_repair/game.html' WHEN list_contains(q, 2) THEN test || '_repair_1_repair/game.html' WHEN k % 2 = 0 THEN last END WHEN k % 3 = 0 THEN last END AS found
      FROM r, (VALUES ('original'), ('repair_orig'), ('repaired'), ('refine_orig'), ('refined')) v(kind)""",
    "record_screenshots": """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), h AS (SELECT k, list(n ORDER BY n) AS n FROM l GROUP BY k), o AS (SELECT o_orderkey AS k, coalesce(n, []) AS n FROM orders LEFT JOIN h ON h.k = o_orderkey),
      s AS (SELECT k, n, CASE k % 3 WHEN 0 THEN list_filter([2, 1], lambda x: list_contains(n, x)) WHEN 1 THEN list_filter([5, 3], lambda x: list_contains(n, x)) ELSE [] END AS own FROM o)
      SELECT CAST(k AS VARCHAR) AS uid, array_to_string(list_transform(CASE WHEN len(own) > 0 THEN own ELSE list_filter(n, lambda x: x < 7)[1:3] END, lambda x: 'rec' || k || '/frame_' || x || '.png'), ',') AS shots FROM s""",
    "sidecar_contents": f"WITH {RESULTS_SQL} SELECT line_idx, CASE WHEN line_idx % 4 <> 0 THEN tests_passed END AS passed, CASE WHEN line_idx % 4 <> 0 THEN tests_total END AS total FROM results_raw",
}
QUERIES = {name: globals()[name] for name in ORACLES}
