"""Reading the given tables, and the evaluation records that are derived from them.

The tables hold no evaluation records, so deterministic columns of orders, line items, pages and events stand for them:
``results`` (one row per evaluated record, several per item and trial), ``test_outcomes`` (one row per test of
a record), ``responses`` (model answers that hold pages) and ``frames`` (captured frames of a page in order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import bounded

FENCE = "```"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer files than this is small enough to be dealt anew to all cores.
FEW_FILES = 32


def spread(df: DataFrame) -> DataFrame:
    """``df``, read from a table, in as many partitions as there are cores (``FEW_FILES`` at most) if the table has fewer files.

    One small file would else keep all work per row in one task.  Tables of many files are never shuffled.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, FEW_FILES)
    return df.repartition(wanted) if len(df.inputFiles()) < wanted else df


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation results in file order: ``line_idx`` is the line."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    segments = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    category = (
        F.when(F.col("c_mktsegment") == "MACHINERY", "game").when(F.col("c_mktsegment") == "BUILDING", "app").when(F.col("c_mktsegment") == "AUTOMOBILE", "dataviz")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "content_marketing").otherwise(" landing ")
    )
    priority = F.substring("o_orderpriority", 1, 1)
    third = F.col("o_custkey") % 3
    return orders.join(segments, orders["o_custkey"] == segments["c_custkey"]).select(
        k.alias("line_idx"),
        F.col("o_custkey").cast("string").alias("item_id"),
        (k % 3).alias("trial"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "completed_with_fallback").otherwise("failed").alias("eval_status"),
        F.when((F.col("o_orderstatus") == "P") & (k % 2 == 0), F.lit(0).cast("long")).otherwise(F.floor("o_totalprice").cast("long") % 101).alias("total"),
        F.when(k % 13 != 0, ((k * 7) % 11).cast("double") / 10).alias("test_pass_rate"),
        ((k * 7) % 11).alias("tests_passed"),
        F.lit(10).cast("long").alias("tests_total"),
        (k % 11).alias("rendering"), ((3 * k) % 21).alias("visual_design"), ((5 * k) % 56).alias("functionality"), ((7 * k) % 11).alias("interaction"), (k % 6).alias("code_quality"),
        category.alias("category"),
        F.when(priority.isin("1", "2"), "hard").when(priority == "3", "medium").otherwise("easy").alias("difficulty"),
        F.when(third == 0, "en").when(third == 1, "zh").otherwise("").alias("language"),
        F.concat(F.lit("st"), (F.col("o_custkey") % 7).cast("string")).alias("sub_type"),
        F.concat(F.lit("m"), (k % 5).cast("string")).alias("model"),
        (k % 4 != 0).alias("has_interaction"),
    )


RESULTS_SQL = """results_raw AS (
  SELECT o_orderkey AS line_idx, CAST(o_custkey AS VARCHAR) AS item_id, o_orderkey % 3 AS trial,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed_with_fallback' ELSE 'failed' END AS eval_status,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 101 END AS total,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 11 AS DOUBLE) / 10 END AS test_pass_rate,
    (o_orderkey * 7) % 11 AS tests_passed, CAST(10 AS BIGINT) AS tests_total,
    o_orderkey % 11 AS rendering, (3 * o_orderkey) % 21 AS visual_design, (5 * o_orderkey) % 56 AS functionality, (7 * o_orderkey) % 11 AS interaction, o_orderkey % 6 AS code_quality,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'game' WHEN 'BUILDING' THEN 'app' WHEN 'AUTOMOBILE' THEN 'dataviz' WHEN 'HOUSEHOLD' THEN 'content_marketing' ELSE ' landing ' END AS category,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'hard' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'medium' ELSE 'easy' END AS difficulty,
    CASE o_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' ELSE '' END AS language,
    'st' || CAST(o_custkey % 7 AS VARCHAR) AS sub_type, 'm' || CAST(o_orderkey % 5 AS VARCHAR) AS model, o_orderkey % 4 <> 0 AS has_interaction
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def test_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of an item's tests by model, with the model's group; ``pos`` orders the observations."""
    item, test = F.col("l_partkey") % 400, F.col("l_linenumber")
    hit = (F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + test * 7 + F.col("l_orderkey") * 13) % 100 < (item * 53 + test * 29) % 121
    return table(spark, sf_dir, "lineitem").select(
        item.cast("string").alias("item_id"),
        test.cast("string").alias("test_id"),
        F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("model"),
        F.when(F.col("l_suppkey") % 2 == 0, "sft").otherwise("base").alias("group"),
        F.when((F.col("l_orderkey") + test) % 3 != 0, F.concat(F.lit("test "), test.cast("string"), F.repeat(F.lit("x"), (item % 4).cast("int")))).otherwise("").alias("name"),
        (F.col("l_quantity").cast("long") % 3 + 1).cast("double").alias("weight"),
        hit.alias("passed"),
        ((F.col("l_orderkey") * 8 + test) * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("pos"), "l_partkey", "l_suppkey",
    )


OUTCOMES_SQL = """tc_results AS (
  SELECT CAST(l_partkey % 400 AS VARCHAR) AS item_id, CAST(l_linenumber AS VARCHAR) AS test_id, 'm' || CAST(l_suppkey AS VARCHAR) AS model,
    CASE WHEN l_suppkey % 2 = 0 THEN 'sft' ELSE 'base' END AS grp,
    CASE WHEN (l_orderkey + l_linenumber) % 3 <> 0 THEN 'test ' || CAST(l_linenumber AS VARCHAR) || repeat('x', CAST((l_partkey % 400) % 4 AS INT)) ELSE '' END AS name,
    CAST(CAST(floor(l_quantity) AS BIGINT) % 3 + 1 AS DOUBLE) AS weight,
    (l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7 + l_orderkey * 13) % 100 < ((l_partkey % 400) * 53 + l_linenumber * 29) % 121 AS passed,
    (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos, l_partkey, l_suppkey
  FROM lineitem)"""


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with added markup by page_id, so that every feature occurs."""
    extra = F.element_at(F.array(*map(F.lit, EXTRA_MARKUP)), (F.col("page_id") % len(EXTRA_MARKUP) + 1).cast("int"))
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.concat("html", extra).alias("html"))


EXTRA_MARKUP = (
    "",
    '<canvas id="c"></canvas><script>requestAnimationFrame(f);document.addEventListener("keydown",e=>{if(e.key)f()})</script>',
    '<form><input><input type="email"><textarea></textarea><select></select><input type=range><input type="checkbox" onchange="f()"></form>',
    '<svg></svg><main><section></section></main><aside></aside><header></header><h2>t</h2><meta name="viewport" content="w">',
    '<script src="https://a.example/x.js"></script><link href="https://a.example/y.css"><img src="https://a.example/x.js"><style>@media (x){} a:hover {transition: 1s;opacity:1} @keyframes k{} b{display:flex;color:var(--c)} c{display: grid;background:linear-gradient(a)}</style>',
    '<div style="a"><p style="b"></p></div><script>el.onclick = f; x.addEventListener("mousedown",f); x.addEventListener("mousemove",f); THREE.Scene; c.getContext("webgl"); new Audio("a")</script><video></video>',
    '<div onclick="f()" onmousedown="g()"></div><script>a.addEventListener("touchstart",f);a.addEventListener("touchmove",g)</script>' + '<i style="c"></i>' * 32,
)


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PAGES_SQL = f"""rich AS (SELECT page_id, html || list_extract([{", ".join(map(_sql_text, EXTRA_MARKUP))}], CAST(page_id % {len(EXTRA_MARKUP)} + 1 AS INT)) AS html FROM pages)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers by page_id, each with a whole page's text: a raw page, a page in a closed fence, one whose fence and tags stay open, a
    fenced drawing of its text, or its text as prose."""
    html, kind = F.col("html"), F.col("page_id") % 5
    prose = F.regexp_replace(html, "<[^>]*>", " ")
    text = (
        F.when(kind == 0, html).when(kind == 1, F.concat(F.lit(f"Here it is.\n{FENCE}html\n"), html, F.lit(f"\n{FENCE}\nDone.")))
        .when(kind == 2, F.concat(F.lit(f"{FENCE}html\n"), F.regexp_replace(html, "</(body|html)>", "")))
        .when(kind == 3, F.concat(F.lit(f'{FENCE}svg\n<svg width="1"><text>'), prose, F.lit(f"</text></svg>\n{FENCE}"))).otherwise(F.concat(F.lit("I cannot make a page. "), prose))
    )
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(F.col("page_id").alias("item_id"), text.alias("response"))


RESPONSES_SQL = f"""responses AS (SELECT page_id AS item_id, CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN 'Here it is.' || chr(10) || '{FENCE}html' || chr(10) || html || chr(10) || '{FENCE}' || chr(10) || 'Done.'
  WHEN 2 THEN '{FENCE}html' || chr(10) || regexp_replace(html, '</(body|html)>', '', 'g') WHEN 3 THEN '{FENCE}svg' || chr(10) || '<svg width="1"><text>' || regexp_replace(html, '<[^>]*>', ' ', 'g') || '</text></svg>' || chr(10) || '{FENCE}'
  ELSE 'I cannot make a page. ' || regexp_replace(html, '<[^>]*>', ' ', 'g') END AS response FROM pages)"""


def positions(df: DataFrame) -> DataFrame:
    """``df`` with the number of each row in the order in which the table is read (``row_idx``, from 0).

    Rows are numbered within their partitions; the sizes of the partitions before (one row each) give the rest, so no window spans the table.
    """
    at = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    sizes = at.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = at.join(F.broadcast(sizes.select(F.col("__part"), before.alias("__before"))), "__part")  # one row per partition
    return placed.withColumn("row_idx", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured frames: record_id, seq, label, layer, diff_from_prev, digest of the image."""
    kind = F.col("event_type")
    label = F.when(kind == "click", "after_click_btn_0").when(kind == "view", "stable").when(kind == "purchase", "form_submitted").when(kind == "signup", "hover_btn_1").otherwise("gameplay_t1")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record_id"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"), label.alias("label"),
        F.when(kind == "view", "observation").when(kind == "error", "deep").otherwise("interaction").alias("layer"), F.least(F.lit(1.0), F.col("value") / 500).alias("diff_from_prev"),
        F.md5(F.col("props").cast("binary")).alias("digest"),
    )


FRAMES_SQL = """frames AS (SELECT user_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
    CASE event_type WHEN 'click' THEN 'after_click_btn_0' WHEN 'view' THEN 'stable' WHEN 'purchase' THEN 'form_submitted' WHEN 'signup' THEN 'hover_btn_1' ELSE 'gameplay_t1' END AS label,
    CASE event_type WHEN 'view' THEN 'observation' WHEN 'error' THEN 'deep' ELSE 'interaction' END AS layer, least(1.0, value / 500) AS diff_from_prev, md5(props) AS digest FROM events)"""
