"""Sources, sinks, work lists and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.plans.registry import query, r6
from pagemill.session import new_folder
from pagemill.sources import linedocs as ld
from pagemill.sources import manifest as mf


@query("s01_scan_manifest", "v_manifest", "SELECT sample, host, lang, key, host || '_' || key AS doc_key, split FROM v_manifest")
def _(t):
    return t.manifest.withColumn("doc_key", F.concat_ws("_", "host", "key"))


@query("s01_scan_files", "v_manifest", """SELECT DISTINCT host, coalesce(nullif(lang, ''), 'none') AS lang, 'lang=' || coalesce(nullif(lang, ''), 'none') AS parent FROM v_manifest""")
def _(t):
    """Pages are laid out as one file per host and language, and the files are listed with the keys their paths tell."""
    root = new_folder(t.spark, "scan")
    pages = t.manifest.select("sample", "host", F.coalesce(F.nullif("lang", F.lit("")), F.lit("none")).alias("lang"))
    pages.repartition("host", "lang").write.partitionBy("host", "lang").parquet(root)
    files = mf.scan_manifest(t.spark, root, "*.parquet", {"host": "/host=([^/]+)/", "lang": "/lang=([^/]+)/"})
    parent = F.regexp_extract(mf.parent_stem_key("path"), "^(.*)_part-", 1)
    return files.where("length > 0").select("host", "lang", parent.alias("parent")).distinct()


@query(
    "s01_parent_stem", "",
    r"""SELECT page_id AS sample, regexp_extract(path, '([^/]+)/[^/]+$', 1) || '_' || regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]*$', '') AS doc_key
    FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages) p""",
)
def _(t):
    """For documents named by their folder: the key is folder and file name without its ending."""
    path = F.regexp_replace("url", "[?#].*$", "")
    return t.pages.select(F.col("page_id").alias("sample"), mf.parent_stem_key(path).alias("doc_key"))


LINE_COLUMNS = """SELECT doc_id, 'doc/' || doc_id AS image_path, 'text_line' AS type, doc_id || '-' || line_no AS id, line_no, x0, y AS y0, x1,
    CASE WHEN x0 IS NOT NULL THEN 2 END AS n_points, CASE WHEN x0 IS NOT NULL THEN 10.0::DOUBLE END AS width, text FROM v_lines"""


@query("s02_scan_line_docs", "v_lines", LINE_COLUMNS)
def _(t):
    rows = ld.scan_line_docs(t.linedoc, "doc")
    return rows.select(
        "doc_id", "image_path", "type", "id", F.col("line_pos").cast("int").alias("line_no"),
        F.element_at("line", 1)["x"].alias("x0"), F.element_at("line", 1)["y"].alias("y0"), F.element_at("line", -1)["x"].alias("x1"),
        F.when(F.col("line").isNotNull(), F.size("line")).alias("n_points"), "width", "text",
    )


SERIES_FIELDS = [f"v.{k}" for k in range(64)]


@query(
    "s03_feature_archive", "v_series",
    "SELECT CAST(vec_id AS VARCHAR) AS id, " + ", ".join(f"max(CASE WHEN pos = {k} THEN value END) AS v_{k}" for k in range(64))
    + " FROM v_series GROUP BY vec_id",
)
def _(t):
    keyed = t.series.select(F.concat(F.col("vec_id"), F.lit(".v."), F.col("pos")).alias("key"), "value")
    wide = ld.unflatten_kv(keyed, SERIES_FIELDS)
    return wide.toDF("id", *[f"v_{k}" for k in range(64)])


@query("s03_flatten_archive", "v_series", "SELECT vec_id || '.v.' || pos AS key, value FROM v_series")
def _(t):
    keyed = t.series.select(F.concat(F.col("vec_id"), F.lit(".v."), F.col("pos")).alias("key"), "value")
    wide = ld.unflatten_kv(keyed, SERIES_FIELDS).toDF("id", *[f"v_{k}" for k in range(64)])
    names = [f"v_{k}" for k in range(64)]
    return ld.flatten_kv(wide, names).select(F.regexp_replace("key", r"\.v_", ".v.").alias("key"), "value")


@query("s04_partitioned_overwrite", "v_manifest", "SELECT sample, host, lang, key, split FROM v_manifest")
def _(t):
    root = new_folder(t.spark, "assets")
    stale = t.manifest.where("split = 'test'").withColumn("key", F.lit("stale"))
    mf.write_asset(stale, root, "prepare", "pages", "manifest")
    path = mf.write_asset(t.manifest, root, "prepare", "pages", "manifest")
    return t.spark.read.parquet(path).select("sample", "host", "lang", "key", F.col("split").cast("string").alias("split"))


@query(
    "s05_export_line_docs", "v_lines",
    """SELECT doc_id, doc_id || '-' || line_no AS id,
      CASE WHEN line_no % 3 = 0 THEN 10.0::DOUBLE ELSE 12.0::DOUBLE END AS width,
      CASE WHEN line_no % 2 = 0 THEN reverse(text) ELSE text END AS text, x0, x1
    FROM v_lines WHERE x0 IS NOT NULL""",
)
def _(t):
    lines = t.line_rows.select(
        "*", F.concat(F.lit("doc/"), "doc_id").alias("image_path"),
        F.when(F.col("line_no") % 3 == 0, F.lit(0.0)).otherwise(F.lit(12.0)).alias("width_template"),
        F.when(F.col("line_no") % 2 == 0, F.reverse("text")).alias("text_template"),
    )
    rows = ld.scan_line_docs(ld.export_line_docs(lines, "doc_id", "line_no", "template"), "doc")
    return rows.select("doc_id", "id", "width", "text", F.element_at("line", 1)["x"].alias("x0"), F.element_at("line", -1)["x"].alias("x1"))


@query(
    "s06_metric_sinks", "",
    """SELECT 'detail' AS kind, CAST(p_partkey AS VARCHAR) AS name, p_retailprice AS value FROM part
    UNION ALL SELECT 'summary', 'p_retailprice', round(avg(p_retailprice), 6) FROM part""",
)
def _(t):
    folder = new_folder(t.spark, "results")
    mf.write_results(t.part.select(F.col("p_partkey").cast("string").alias("sample"), "p_retailprice"), folder)
    detail = t.spark.read.schema("sample string, p_retailprice double").csv(f"{folder}/detail", header=True)
    mean = t.spark.read.schema("metric string, mean double").csv(f"{folder}/summary")
    return detail.select(F.lit("detail").alias("kind"), F.col("sample").alias("name"), F.col("p_retailprice").alias("value")).unionAll(
        mean.select(F.lit("summary"), "metric", r6("mean"))
    )


@query(
    "s07_collect_results", "v_manifest",
    """SELECT m.sample, m.key AS out_key, m.host AS orig_host, length(p.html) AS template_size, l.quality AS truth
    FROM v_manifest m JOIN pages p ON p.page_id = m.sample LEFT JOIN labels l ON l.doc_id = m.sample""",
)
def _(t):
    out = t.manifest.select("sample", F.col("key").alias("out_key"))
    original = t.manifest.select("sample", F.col("host").alias("orig_host"))
    template = t.pages.select(F.col("page_id").alias("sample"), F.length("html").cast("long").alias("template_size"))
    truth = t.labels.select(F.col("doc_id").alias("sample"), F.col("quality").alias("truth"))
    return mf.collect_results(out, original, template, truth)


@query(
    "s08_check_counts", "v_manifest",
    """e(split, expected, hard) AS (VALUES ('train', 200, true), ('val', 25, true), ('test', 25000, false), ('real', NULL, true)),
    c AS (SELECT split, count(*) AS n FROM v_manifest GROUP BY split)
    SELECT e.split, CAST(e.expected AS BIGINT) AS expected, coalesce(n, 0) AS n,
      CASE WHEN coalesce(n, 0) = e.expected OR (e.expected IS NULL AND n > 0) THEN 'ok' WHEN hard OR n IS NULL THEN 'fail' ELSE 'warn' END AS status
    FROM e LEFT JOIN c ON e.split = c.split""",
)
def _(t):
    expected = t.spark.createDataFrame(
        [("train", 200, True), ("val", 25, True), ("test", 25000, False), ("real", None, True)],
        "split string, expected bigint, hard boolean",
    )
    return mf.check_counts(t.manifest, expected)


@query("s09_pending", "", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return mf.pending(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query(
    "s10_incomplete", "v_textlines",
    "SELECT doc_id, count(*) AS missing, CAST(0 AS BIGINT) AS extra FROM v_textlines WHERE length(text) <= 40 GROUP BY doc_id",
)
def _(t):
    return mf.incomplete(t.textlines, t.textlines.where(F.length("text") > 40), "doc_id", "line_no")


@query(
    "s11_split_errors", "",
    """SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'k is a number'
      WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 50 THEN 'k below 50' WHEN event_type = 'error' THEN 'event is valid' END AS error
    FROM events""",
)
def _(t):
    k = F.from_json("props", "k int")["k"]
    checks = {"k is a number": k.isNotNull(), "k below 50": k < 50, "event is valid": F.col("event_type") != "error"}
    return mf.mark_errors(t.events, checks).select("event_id", "error")


@query(
    "s12_limit_samples", "v_manifest",
    """SELECT sample, split FROM v_manifest WHERE split = 'test'
    UNION ALL SELECT sample, split FROM (SELECT sample, split, row_number() OVER (PARTITION BY split ORDER BY sample) AS n
      FROM v_manifest WHERE split <> 'test') WHERE n <= 7""",
)
def _(t):
    return mf.limit_samples(t.manifest.select("sample", "split"), 7, "sample", ["train", "val"])


@query(
    "s13_project_json", "",
    """SELECT event_id, coalesce(json_extract_string(props, '$.task.k'), json_extract_string(props, '$.k')) AS k
    FROM events WHERE lower(trim(event_type)) = 'click'""",
)
def _(t):
    rows = mf.project_json(t.events, "props", {"k": ["$.task.k", "$.k"]})
    return rows.where(mf.same_word(F.col("event_type"), " Click ")).select("event_id", "k")


@query(
    "q01_check_contract", "",
    """SELECT unnest(['type known', 'price set', 'discount range', 'line number positive', 'quantity fits']) AS rule,
      unnest([count(*) FILTER (l_returnflag NOT IN ('A', 'N')), count(*) FILTER (l_extendedprice IS NULL),
        count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05), count(*) FILTER (l_linenumber <= 0),
        count(*) FILTER (l_quantity > l_linenumber * 10)]) AS violations FROM lineitem""",
)
def _(t):
    return mf.check_contract(t.lineitem, {
        "type known": F.col("l_returnflag").isin("A", "N"),
        "price set": F.col("l_extendedprice").isNotNull(),
        "discount range": F.col("l_discount").between(0, 0.05),
        "line number positive": F.col("l_linenumber") > 0,
        "quantity fits": F.col("l_quantity") <= F.col("l_linenumber") * 10,
    })


@query(
    "q02_dedupe_first", "",
    "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS copies, length(text) AS n FROM documents GROUP BY text",
)
def _(t):
    rows = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n"))
    return mf.dedupe_first(rows, ["digest"], ["doc_id"]).select("doc_id", "lang", "copies", "n")


@query("q02_duplicate_report", "", "SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def _(t):
    rows = t.documents.select(F.sha2("text", 256).alias("digest"), "doc_id")
    return mf.dedupe_first(rows, ["digest"], ["doc_id"]).where("copies > 1").select(F.col("doc_id").alias("first_doc"), "copies")
