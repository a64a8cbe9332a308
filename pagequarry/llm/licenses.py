"""License scans, with built-in Spark functions only.

1. *Units*: every line, sentence and paragraph of a file, its leading comment block, and the whole text of a licence file.  Any of
   them may be a licence statement; none is looked for by keywords.
2. *TF-IDF cosine*: document frequencies are counted over all files by one aggregation.  A unit is a sparse vector (term,
   (1 + log count) x idf) and is compared with all templates by a join on terms.  Only units that hold a *leading term* of some
   template are joined: its rarest terms, so many that those left out together have a length below ``SIMILARITY`` and no cosine
   from ``SIMILARITY`` on is lost (Cauchy-Schwarz).  Terms rarer than one in ``RARE`` files weigh alike: a cosine doesn't fall as
   the corpus grows, and the table of the other terms is bounded by ``RARE`` times the mean number of distinct terms of a file.
3. *Own licence*: an SPDX tag as it is declared; else the template with the highest cosine from ``SIMILARITY`` on.  Paragraphs that
   several licences share count only where nothing else is found.
4. *Inheritance*: a licence file licenses its directory; a file without a licence of its own takes that of the nearest ancestor
   directory.  Directories, not files, are joined with their ancestors' paths, so the join doesn't grow with a directory's files.

An own licence depends on a file's text and on whether it is a licence file, and is kept by the digest of both: rows with equal id
and path but other texts keep their own results, and repeated rows stay rows.  Null or empty texts have no unit; a null path has no
directory and inherits nothing.  Ties go to the licence first in alphabetical order, for a directory to the file with the smallest
path.  Long texts are compared whole.  Extra columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .license_texts import templates

SIMILARITY = 0.6
#: Terms in fewer files than one in so many weigh alike.
RARE = 1000
#: Rows (terms, licences by digest, directories) that are broadcast at most; beyond it the join shuffles.
BROADCAST_ROWS = 250_000
TERM = r"[^\p{L}\p{N}]+"
PARAGRAPH, SENTENCE = r"\n[ \t\r]*\n", r"\n|[.;!?][ \t]+"
COMMENT = r"^[ \t]*(#|//|/?\*|--|;|%|<!--)"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), TERM), lambda t: t != "")


def units(text: Column, whole: Column) -> Column:
    """The distinct units of a text."""
    lines = F.split(text, "\n")
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT)), True)
    header = F.array_join(F.slice(lines, 1, F.when(code == 0, F.size(lines)).otherwise(code.cast("int") - 1)), "\n")
    own = F.array(F.when(whole, text).otherwise(""), header)
    return F.filter(F.array_distinct(F.concat(lines, F.split(text, SENTENCE), F.split(text, PARAGRAPH), own)), lambda x: x != "")


def _python_terms(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


class Templates:
    """Weights of templates under the corpus's document frequencies, on the driver: bounded by the templates' words."""

    def __init__(self, rows: list[tuple[str, int, str]], n: int, df: dict[str, int]):
        self.weights: list[dict] = []
        lead: set[str] = set()
        for number, (name, shared, text) in enumerate(rows):
            own = _python_terms(text)
            weight = {t: (1 + math.log(own.count(t))) * idf(n, df.get(t, 0)) for t in own}
            length = math.sqrt(sum(w * w for w in weight.values()))
            left, order = 1.0, sorted(weight, key=lambda t: (df.get(t, 0), -weight[t], t))
            for t in order:
                if left < (SIMILARITY - 1e-6) ** 2:
                    break
                lead.add(t)
                left -= (weight[t] / length) ** 2
            self.weights += [{"term": t, "template": number, "weight": weight[t] / length} for t in sorted(weight)]
        self.lead = sorted(lead)
        self.rows = [{"template": i, "license": name, "shared": shared} for i, (name, shared, _) in enumerate(rows)]


def idf(n: int, df: int) -> float:
    """Of a term in ``df`` of ``n`` files."""
    return math.log(min(RARE, (1 + n) / (1 + df))) + 1.0


def _small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` (materialized), marked for broadcast if it has ``limit`` rows at most."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _literal(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def similarity(texts: DataFrame, chosen: list[tuple[str, int, str]], limit: int = BROADCAST_ROWS) -> DataFrame:
    """(__digest, __whole, license, cosine): the own licences by cosine of texts (__digest, __text, __whole) that have one."""
    spark = texts.sparkSession
    told = texts.where(F.col("__text") != "")
    counted = told.select(F.explode(F.array_distinct(terms(F.col("__text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = texts.count()
    common = materialize(counted.where((F.col("df") + 1) * RARE > n + 1), "license-frequencies")
    vocabulary = sorted({t for _, _, text in chosen for t in _python_terms(text)})
    known = {r.term: r.df for r in common.where(F.col("term").isin(vocabulary)).collect()}
    model = Templates(chosen, n, known)
    leads = lambda words: F.exists(words, lambda t: t.isin(model.lead))
    row = F.struct("__digest", "__whole", F.monotonically_increasing_id().alias("n"))
    files = told.where(leads(terms(F.col("__text"))))
    found = files.select(row.alias("__row"), F.posexplode(units(F.col("__text"), F.col("__whole"))).alias("unit", "text"))
    # One shuffle by file; the aggregations below keep to it.
    words = found.select("__row", "unit", terms(F.col("text")).alias("words")).where(leads(F.col("words"))).repartition("__row")
    pairs = words.select("__row", "unit", F.explode("words").alias("term")).groupBy("__row", "unit", "term").agg(F.count("*").alias("tf"))
    pairs = pairs.join(_small(common, limit), "term", "left")
    weight = (1 + F.log("tf")) * (F.log(F.least(F.lit(float(RARE)), F.lit(1.0 + n) / (1 + F.coalesce("df", F.lit(0))))) + 1)
    table = _literal(spark, model.weights, "term:string,template:int,weight:double")
    table = table.groupBy("term").agg(F.collect_list(F.struct("template", "weight")).alias("in"))
    joined = pairs.withColumn("w", weight).join(F.broadcast(table), "term", "left")
    # Template -1 gathers the unit's own length beside its products with the templates.
    products = F.concat(F.array(F.struct(F.lit(-1).alias("template"), F.col("w").alias("weight"))), F.coalesce("in", F.expr("array()")))
    summed = joined.select("__row", "unit", "w", F.inline(products)).groupBy("__row", "unit", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    lengths = F.sqrt(F.max(F.when(F.col("template") == -1, F.col("dot"))))
    gathered = summed.groupBy("__row", "unit").agg(lengths.alias("length"), F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "dot"))).alias("dots"))
    cosines = gathered.select("__row", F.inline("dots"), "length").select("__row", "template", F.round(F.col("dot") / F.col("length"), 9).alias("cosine"))
    names = _literal(spark, model.rows, "template:int,license:string,shared:int")
    named = cosines.where(F.col("cosine") >= SIMILARITY).join(F.broadcast(names), "template")
    best = named.groupBy("__row.__digest", "__row.__whole").agg(F.min(F.struct("shared", (-F.col("cosine")).alias("less"), "license")).alias("best"))
    return best.select("__digest", "__whole", F.col("best.license").alias("license"), (-F.col("best.less")).alias("cosine"))


def own_licenses(texts: DataFrame, chosen: list[tuple[str, int, str]]) -> DataFrame:
    """(__digest, __whole, own_license, cosine) of the texts that have a licence of their own; one row for each digest and kind."""
    tag = F.regexp_extract("__text", SPDX, 1)
    tagged = texts.where(F.col("__text").isNotNull()).select("__digest", "__whole", tag.alias("license")).where("license <> ''").distinct()
    told = tagged.withColumn("cosine", F.lit(1.0)).withColumn("untagged", F.lit(0))
    found = told.unionByName(similarity(texts, chosen).withColumn("untagged", F.lit(1)))
    first = found.groupBy("__digest", "__whole").agg(F.min(F.struct("untagged", "license", "cosine")).alias("f"))
    return materialize(first.select("__digest", "__whole", F.col("f.license").alias("own_license"), F.col("f.cosine").alias("cosine")), "licenses")


def directory(path: Column) -> Column:
    """The path without its last part; the root is the empty string."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, as (depth, path); the root has depth 0."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    place = lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"))
    return F.transform(F.sequence(F.lit(0), F.array_size(parts)), place)


def scan(
    files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", licence_file: Column | None = None,
    chosen: list[tuple[str, int, str]] | None = None,
) -> DataFrame:
    """One row per file: ``id_col``, path, own_license, cosine, license, origin (own, inherited or none), from_folder.

    ``licence_file`` says which files license their directory (default: file names that begin with LICENSE or COPYING);
    ``chosen`` are templates (license, shared, text) other than the built-in ones.
    """
    if licence_file is None:
        named = F.regexp_extract(F.col(f"`{path_col}`").cast("string"), "([^/]*)$", 1)
        licence_file = F.coalesce(named.rlike("^(?i)(licen[cs]e|copying)"), F.lit(False))
    text = F.col(f"`{text_col}`").cast("string")
    rows = files.select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{path_col}`").cast("string").alias("__path"), licence_file.alias("__whole"),
        F.md5(F.coalesce(text, F.lit(""))).alias("__digest"), text.alias("__text"),
    )
    own = own_licenses(rows.select("__digest", "__text", "__whole"), chosen or templates())
    paths = rows.select("__id", "__path", "__whole", "__digest", directory(F.col("__path")).alias("__folder"))
    mine = paths.join(_small(own, BROADCAST_ROWS), ["__digest", "__whole"], "left")
    licensing = mine.where("__whole and own_license is not null and __folder is not null")
    folders = licensing.groupBy(F.col("__folder").alias("folder")).agg(F.min(F.struct("__path", "own_license")).alias("first"))
    folders = _small(materialize(folders.select("folder", F.col("first.own_license").alias("folder_license")), "license-folders"), BROADCAST_ROWS)
    above = paths.where("__folder is not null").select("__folder").distinct().select("__folder", F.inline(ancestors(F.col("__folder"))))
    nearest = above.join(folders, "folder").groupBy("__folder").agg(F.max(F.struct("depth", "folder", "folder_license")).alias("n"))
    nearest = nearest.select("__folder", F.col("n.folder").alias("from_folder"), F.col("n.folder_license").alias("inherited"))
    nearest = _small(materialize(nearest, "license-nearest"), BROADCAST_ROWS)
    joined = mine.join(nearest, "__folder", "left")
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    licence = F.coalesce("own_license", "inherited").alias("license")
    source = F.when(F.col("own_license").isNull(), F.col("from_folder")).alias("from_folder")
    return joined.select(F.col("__id").alias(id_col), F.col("__path").alias("path"), "own_license", "cosine", licence, origin.alias("origin"), source)


def tree_path(doc_id: Column) -> Column:
    """A place in a directory tree for a numbered document: thousands / hundreds / tens / name.

    Even numbers are licence files of their directory, multiples of ten those of the directory above.
    """
    part = lambda n: F.floor(doc_id / F.lit(n)).cast("string")
    above, leaf = F.concat_ws("/", part(1000), part(100)), F.concat_ws("/", part(1000), part(100), part(10))
    name = F.concat(F.lit("LICENSE-"), doc_id.cast("string"))
    file = F.concat_ws("/", leaf, F.concat(doc_id.cast("string"), F.lit(".txt")))
    placed = F.when(doc_id % 10 == 0, F.concat_ws("/", above, name)).when(doc_id % 2 == 0, F.concat_ws("/", leaf, name)).otherwise(file)
    return F.when(doc_id.isNotNull(), placed)
