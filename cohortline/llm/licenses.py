"""License scans: TF-IDF cosine of headers and files to templates, and inheritance from directories."""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import table, written
from cohortline.llm.license_templates import GENERIC, RESERVED, templates
from cohortline.llm.registry import register

SIMILARITY = 0.7
FILE_SHARE = 0.5
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
#: Terms: letters, and numbers without trailing zero parts, so that 2.0 and 2 are one.
TERM = r"[a-z]+|[1-9][0-9]*(?:\.[1-9][0-9]*)*"
SENTENCE_END = r"([.!?]) "
BLANK_LINE = r"\n[^A-Za-z0-9\n]*\n"
#: Templates by the unit of a text that they are compared with: sentences, blocks, whole texts.
KINDS = ("name", "notice", "text")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _idf(total: int) -> Column:
    """How rare a term is among all files, from the number ``n`` of those that hold it."""
    return F.log((1 + F.lit(total)) / (1 + F.coalesce("n", F.lit(0)))) + 1


def _frequency(times: str) -> Column:
    return 1 + F.log(times)


def _prefix_terms(parts: list, similarity: float) -> list[str]:
    """Terms of which every unit that is near enough to a template of one kind holds one.

    A unit that holds only terms of a template whose weights have a norm below the similarity cannot
    reach it. So the heaviest terms, up to where the norm of the rest falls below it, are enough. A name asks
    for all its telling words: the heaviest of these is enough.
    """
    found = set()
    for _, rows in groupby(sorted(parts, key=lambda r: r["template"]), key=lambda r: r["template"]):
        heaviest = sorted(rows, key=lambda r: (-r["needed"], -r["part"], r["term"]))
        if heaviest[0]["needed"]:
            found.add(heaviest[0]["term"])
            continue
        rest = sum(r["part"] ** 2 for r in heaviest)
        for r in heaviest:
            if math.sqrt(max(rest, 0.0)) < similarity - 1e-6:
                break
            found.add(r["term"])
            rest -= r["part"] ** 2
    return sorted(found)


def _holds_any(terms: str, wanted: list[str]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, wanted)))


def license_hits(files: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``row, license, kind, cosine, share`` of files ``row, text`` that name or hold a license: the nearest template.

    Sentences (cut at line breaks and after full stops and the like) are compared with names of licenses, blocks
    (cut at lines without letters or digits) with notices, whole texts with whole license texts and notices. Units and templates
    are sparse vectors over all their terms: one plus the logarithm of how often a term occurs, times the
    logarithm of how rare it is among all files. From a cosine of ``similarity`` on a unit names the license; a name's telling
    words must all be there, and a sentence of one word names none. A whole text goes before a notice, a notice before a name, a mere reservation
    of rights comes last; then the best cosine decides, then the first license by name. ``share`` is the
    part of the text's words that stands in such units (of the kind with the largest part).
    """
    spark = files.sparkSession
    texts = files.select("row", F.coalesce("text", F.lit("")).alias("text")).select("row", "text", _terms(F.col("text")).alias("terms"))
    total = files.count()
    counts = written(
        texts.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "license-counts"
    )

    fixed = [(n, license, kind, text) for n, (license, kind, text) in enumerate(templates())]  # some hundred rows
    named = spark.createDataFrame(fixed, "template int, license string, kind string, text string")
    held = named.select("template", "license", "kind", F.explode(_terms(F.col("text"))).alias("term"))
    weighted = held.groupBy("template", "license", "kind", "term").agg(F.count("*").alias("times")).join(counts, "term", "left").select(
        "template", "license", "kind", "term", (_frequency("times") * _idf(total)).alias("part"),
        ((F.col("kind") == "name") & ~F.col("term").isin(*GENERIC)).cast("int").alias("needed"),
    )
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("part") * F.col("part"))).alias("norm"), F.sum("needed").alias("asked"))
    parts = written(weighted.join(norms, "template").withColumn("part", F.col("part") / F.col("norm")).drop("norm"), "license-templates")
    fixed_parts = parts.collect()  # as many rows as the templates have terms
    prefix = {kind: _prefix_terms([r for r in fixed_parts if r["kind"] == kind], similarity) for kind in KINDS}

    # a unit holds no term that its text does not hold
    some = texts.where(_holds_any("terms", sorted({term for terms in prefix.values() for term in terms})))
    some = written(some.select("row", "text"), "license-candidates")

    def cut(kind: str, pieces: Column) -> DataFrame:
        units = some.select("row", F.explode(pieces).alias("unit"))
        units = units.select("row", F.xxhash64("unit").alias("unit"), _terms(F.col("unit")).alias("terms"), F.lit(kind).alias("kind"))
        wanted = sorted({*prefix["notice"], *prefix["text"]}) if kind == "text" else prefix[kind]
        return units.where(_holds_any("terms", wanted) & (F.size("terms") >= F.lit(2 if kind == "name" else 1)))

    sentences = F.split(F.regexp_replace("text", SENTENCE_END, "$1\n"), "\n")
    units = cut("name", sentences).unionByName(cut("notice", F.split("text", BLANK_LINE))).unionByName(cut("text", F.array("text")))
    units = written(units, "license-units")
    distinct = units.groupBy("kind", "unit").agg(F.first("terms").alias("terms"))
    counted = distinct.select("kind", "unit", F.explode("terms").alias("term")).groupBy("kind", "unit", "term").agg(F.count("*").alias("times"))
    vectors = written(
        counted.join(counts, "term").select("kind", "unit", "term", (_frequency("times") * _idf(total)).alias("value")), "license-vectors"
    )
    lengths = vectors.groupBy("kind", "unit").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    met = F.broadcast(parts.withColumnRenamed("kind", "of"))
    products = vectors.join(met, "term").where("kind = of OR (kind = 'text' AND of = 'notice')").groupBy(
        "kind", "unit", "template", "license", "of", "asked"
    ).agg(F.sum(F.col("value") * F.col("part")).alias("product"), F.sum("needed").alias("given"))
    cosines = products.where("given = asked").join(lengths, ["kind", "unit"]).withColumn(
        "cosine", F.round(F.col("product") / F.col("length"), 9)
    )
    order = F.struct(
        (F.col("license") == RESERVED).alias("reserved"),
        F.when(F.col("of") == "text", 0).when(F.col("of") == "notice", 1).otherwise(2).alias("rank"),
        (-F.col("cosine")).alias("less"),
        "license",
        F.col("of").alias("kind"),
    )
    best = cosines.where(F.col("cosine") >= similarity).groupBy("kind", "unit").agg(F.min(order).alias("best"))
    # equal units of one text count each; rows of equal name are one file here
    hit = units.join(best, ["kind", "unit"]).groupBy("row", "kind").agg(
        F.min("best").alias("best"), F.sum(F.size("terms")).alias("hit_words")
    ).groupBy("row").agg(F.min("best").alias("best"), F.max("hit_words").alias("hit_words"))
    sizes = some.groupBy("row").agg(F.sum(F.size(_terms(F.col("text")))).alias("all_words"))
    return hit.join(sizes, "row").select(
        "row", F.col("best.license").alias("license"), F.col("best.kind").alias("kind"), (-F.col("best.less")).alias("cosine"),
        (F.col("hit_words") / F.col("all_words")).alias("share"),
    )


def scan_licenses(files: DataFrame, similarity: float = SIMILARITY, file_share: float = FILE_SHARE) -> DataFrame:
    """``row, license, kind, cosine, effective, inherited_from`` per row of files ``row, path, text``.

    A file that names or holds a license (``license_hits``) has it. A license file (by its name, or since most of its words
    name a license) passes it on to its directory and all below: a file without a license of
    its own takes that of the nearest directory above it; of several license files in a
    directory, the one with the highest cosine, then the first license by name. Null texts
    are empty, a null path lies in the top directory, which is ''. Repeated paths are separate
    files; ``row`` names rows, and rows of one name share what any of them names. Texts of any length are compared whole;
    an empty table gives no rows. Other columns are not looked at.
    """
    hits = written(license_hits(files, similarity), "license-hits")
    path = F.coalesce(F.col("path"), F.lit(""))
    directory = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    placed = files.select("row", path.alias("path"), directory.alias("directory"))
    owned = placed.join(hits, "row", "left")
    declared = owned.where(F.col("license").isNotNull() & (F.col("path").rlike(LICENSE_FILE) | (F.col("share") >= file_share)))
    declared = declared.groupBy("directory").agg(
        F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("best")
    ).select(F.col("directory").alias("above"), F.col("best.license").alias("passed"))
    parts = F.split("directory", "/")
    above = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    )
    directories = owned.where("license IS NULL").select("directory").distinct()
    nearest = directories.select("directory", F.explode(above).alias("above")).join(declared, "above").groupBy("directory").agg(
        F.max_by(F.struct("above", "passed"), F.length("above")).alias("nearest")
    )
    return owned.join(nearest, "directory", "left").select(
        "row",
        "license",
        "kind",
        "cosine",
        F.coalesce("license", F.col("nearest.passed")).alias("effective"),
        F.when(F.col("license").isNull(), F.col("nearest.above")).alias("inherited_from"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    """The scan of documents in SQL: all units against all templates, without the filter by heavy terms."""
    fixed = ",\n".join(f"({n}, {_quoted(l)}, {_quoted(k)}, {_quoted(t)})" for n, (l, k, t) in enumerate(templates()))
    generic = ", ".join(map(_quoted, GENERIC))
    idf = "(ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(n, 0))) + 1)"
    return f"""
WITH templates(template, license, kind, body) AS (VALUES {fixed}),
files AS (
  SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS body FROM documents
),
placed AS (
  SELECT doc_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS directory FROM files
),
counts AS (
  SELECT term, count(*) AS n
  FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(body), '{TERM}'))) AS term FROM files) GROUP BY term
),
pieces AS (
  SELECT doc_id, 'name' AS kind, unnest(string_split(regexp_replace(body, '{SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10))) AS piece
  FROM files
  UNION ALL SELECT doc_id, 'notice', unnest(regexp_split_to_array(body, '{BLANK_LINE}')) FROM files
  UNION ALL SELECT doc_id, 'text', body FROM files
),
units AS (
  SELECT row_number() OVER () AS unit, kind, piece, regexp_extract_all(lower(piece), '{TERM}') AS terms
  FROM (SELECT DISTINCT kind, piece FROM pieces)
),
held AS (
  SELECT template, license, kind, term, count(*) AS times
  FROM (SELECT template, license, kind, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM templates)
  GROUP BY ALL
),
weighted AS (
  SELECT template, license, kind, term, (1 + ln(times)) * {idf} AS part,
    CASE WHEN kind = 'name' AND term NOT IN ({generic}) THEN 1 ELSE 0 END AS needed
  FROM held LEFT JOIN counts USING (term)
),
norms AS (SELECT template, sqrt(sum(part * part)) AS norm, sum(needed) AS asked FROM weighted GROUP BY template),
vectors AS (
  SELECT kind, unit, term, (1 + ln(times)) * {idf} AS value
  FROM (
    SELECT kind, unit, term, count(*) AS times
    FROM (SELECT kind, unit, unnest(terms) AS term FROM units WHERE kind <> 'name' OR len(terms) >= 2) GROUP BY ALL
  ) JOIN counts USING (term)
),
lengths AS (SELECT unit, sqrt(sum(value * value)) AS length FROM vectors GROUP BY unit),
cosines AS (
  SELECT unit, license, met, round(product / norm / length, 9) AS cosine
  FROM (
    SELECT v.unit, w.template, w.license, w.kind AS met, sum(value * part) AS product, sum(needed) AS given
    FROM vectors v JOIN weighted w ON v.term = w.term AND (v.kind = w.kind OR (v.kind = 'text' AND w.kind = 'notice'))
    GROUP BY ALL
  ) JOIN norms USING (template) JOIN lengths USING (unit)
  WHERE given = asked
),
best AS (
  SELECT *, license = '{RESERVED}' AS reserved, CASE met WHEN 'text' THEN 0 WHEN 'notice' THEN 1 ELSE 2 END AS rank
  FROM cosines WHERE cosine >= {SIMILARITY}
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY reserved, rank, cosine DESC, license) = 1
),
hit AS (
  SELECT p.doc_id, p.kind, len(u.terms) AS words, b.license, b.met, b.cosine, b.reserved, b.rank
  FROM pieces p JOIN units u USING (kind, piece) JOIN best b USING (unit)
),
shares AS (
  SELECT doc_id, max(words) / any_value(all_words) AS share
  FROM (SELECT doc_id, kind, sum(words) AS words FROM hit GROUP BY doc_id, kind)
  JOIN (SELECT doc_id, len(regexp_extract_all(lower(body), '{TERM}')) AS all_words FROM files) USING (doc_id)
  GROUP BY doc_id
),
owned AS (
  SELECT placed.*, license, met, cosine, share
  FROM placed LEFT JOIN (
    SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY reserved, rank, cosine DESC, license) = 1
  ) USING (doc_id) LEFT JOIN shares USING (doc_id)
),
declared AS (
  SELECT directory AS above, license AS passed FROM owned
  WHERE license IS NOT NULL AND (regexp_matches(path, '{LICENSE_FILE}') OR share >= {FILE_SHARE})
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, license) = 1
),
nearest AS (
  SELECT directory, arg_max(above, length(above)) AS above, arg_max(passed, length(above)) AS passed
  FROM (
    SELECT directory, unnest(list_transform(range(0, len(parts) + 1), lambda n: array_to_string(parts[1:n], '/'))) AS above
    FROM (SELECT DISTINCT directory, string_split(directory, '/') AS parts FROM owned WHERE license IS NULL)
  ) JOIN declared USING (above)
  GROUP BY directory
)
SELECT doc_id, license, met AS kind, round(cosine, 6) AS cosine, coalesce(license, passed) AS effective,
  CASE WHEN license IS NULL THEN above END AS inherited_from
FROM owned LEFT JOIN nearest USING (directory)
"""


@register(_sql())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licenses of all documents; a document's path is its source, language and id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), path.alias("path"), "text")
    return scan_licenses(documents).withColumnRenamed("row", "doc_id").withColumn("cosine", F.round("cosine", 6))
