"""Tables written as files of each kind and read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.plans.registry import query
from evidora.sources import files, office
from evidora.sources.versions import kept_folder
from evidora.sources.views import table

PER_FILE = 500        # rows of a text file, a set of questions or a workbook
_DIGEST = "sha256(coalesce(text, ''))"


def _digest(c: str):
    return F.sha2(F.coalesce(c, F.lit("")), 256).alias("digest")


@query(f"SELECT doc_id, lang, {_DIGEST} AS digest FROM documents")
def text_files(spark, d):
    """All documents as lines of text files, each line an object, found by a walk of their folder."""
    line = F.to_json(F.struct("doc_id", "lang", "text")).alias("value")
    folder = kept_folder(spark, "texts", d, ("documents",), lambda f: table(spark, d, "documents").select(line).write.option("maxRecordsPerFile", PER_FILE).text(f))
    lines = files.plain_texts(files.folder(spark, folder)).select(F.explode(F.split("text", "\n")).alias("line")).where("line != ''")
    return lines.select(F.from_json("line", "doc_id long, lang string, text string").alias("r")).select("r.doc_id", "r.lang", _digest("r.text"))


@query("SELECT concat(conv_id, '-', turn) AS id, text AS question, 'documentary' AS expected_kind, concat('C', conv_id) AS first_id, 1 AS n_expected FROM conversations WHERE role = 'user'")
def golden_questions(spark, d):
    """User turns as sets of questions, an array in each file, that should find their conversation."""
    asked = table(spark, d, "conversations").where("role = 'user'").select(
        F.floor(F.col("conv_id") / PER_FILE).alias("part"),
        F.struct(F.concat("conv_id", F.lit("-"), "turn").alias("id"), F.col("text").alias("question"), F.lit("documentary").alias("expected_kind"), F.struct(F.array(F.concat(F.lit("C"), "conv_id")).alias("expected_doc_ids")).alias("ground_truth")).alias("q"))
    sets = asked.groupBy("part").agg(F.to_json(F.collect_list("q")).alias("value")).select("value")
    folder = kept_folder(spark, "golden", d, ("conversations",), lambda f: sets.write.option("maxRecordsPerFile", 1).text(f))
    expected = F.col("ground_truth.expected_doc_ids")
    return files.golden_set(spark, folder).select("id", "question", "expected_kind", expected[0].alias("first_id"), F.size(expected).alias("n_expected"))


@query(f"SELECT format, doc_id, source, n_chars, {_DIGEST} AS digest FROM documents, (VALUES ('csv'), ('json')) AS f(format)")
def report_files(spark, d):
    """All documents as a report in CSV and in JSON."""
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", "text")
    folder = kept_folder(spark, "report", d, ("documents",), lambda f: files.write_report(rows, f))
    csv = spark.read.schema(rows.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/csv")
    json = spark.read.schema(rows.schema).json(f"{folder}/json")
    return csv.withColumn("format", F.lit("csv")).unionByName(json.withColumn("format", F.lit("json"))).select("format", "doc_id", "source", "n_chars", _digest("text"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
l AS (SELECT r_name AS region, n_name AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey)
SELECT region, concat('# Partners: ', region, chr(10), chr(10), '| nation | customers | suppliers |', chr(10), '| --- | --- | --- |', chr(10), string_agg('| ' || nation || ' | ' || customers || ' | ' || suppliers || ' |', chr(10) ORDER BY nation)) AS text FROM l GROUP BY region""")
def markdown_reports(spark, d):
    """A Markdown report of each region."""
    count = lambda t, k, n: table(spark, d, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias(n))
    rows = (table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(count("customer", "c_nationkey", "customers"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left")
            .select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "suppliers"))))
    folder = kept_folder(spark, "markdown", d, ("nation", "region", "customer", "supplier"), lambda f: files.markdown_report(rows, "Partners", f, "region", ["nation", "customers", "suppliers"]))
    return spark.read.text(folder, wholetext=True).select("region", F.regexp_replace("value", r"\n+$", "").alias("text"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_orderkey) AS orders, cast(sum(o_custkey) AS bigint) AS customers FROM orders GROUP BY o_orderstatus")
def appended_batches(spark, d):
    """All orders, added to a table in a batch for each half of their keys."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")

    def build(folder):
        for half in (0, 1):
            files.append(rows.where(F.pmod("o_orderkey", F.lit(2)) == half), folder)

    folder = kept_folder(spark, "appended", d, ("orders",), build)
    return spark.read.parquet(folder).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders"), F.sum("o_custkey").cast("long").alias("customers"))


@query("SELECT doc_id, sha256(array_to_string([x FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x, concat(' ', chr(9), chr(13))) <> ''], chr(10))) AS digest FROM documents")
def office_texts(spark, d):
    """All documents as office files: their lines but blank ones, with references decoded."""
    made = office.documents(table(spark, d, "documents").select(F.concat("doc_id", F.lit(".docx")).alias("path"), "text"))
    return files.office_text(made).select(F.regexp_extract("path", r"^(-?\d+)\.", 1).cast("long").alias("doc_id"), _digest("text"))


@query(f"""WITH b AS (SELECT concat('customers-', c_nationkey, '-', c_custkey // {PER_FILE}, '.xlsx') AS path, * FROM customer)
SELECT path, concat('# ', path, CASE WHEN count(*) >= 2 THEN concat(chr(10), chr(10), '## Customers', chr(10), chr(10), '| key | name | segment |', chr(10), '| --- | --- | --- |', chr(10),
string_agg(concat('| ', c_custkey, ' | ', replace(c_name, '|', '\\|'), ' | ', c_mktsegment, ' |'), chr(10) ORDER BY c_custkey)) ELSE '' END) AS text FROM b GROUP BY path""")
def workbook_tables(spark, d):
    """Customers as workbooks, one for each nation and stretch of keys, and the tables read from these."""
    path = F.concat(F.lit("customers-"), "c_nationkey", F.lit("-"), F.floor(F.col("c_custkey") / PER_FILE), F.lit(".xlsx")).alias("path")
    of_book = table(spark, d, "customer").groupBy(path).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("rows"))
    lines = F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("segment"))), F.transform("rows", lambda r: F.array(r["c_custkey"].cast("string"), r["c_name"], r["c_mktsegment"])))
    return files.workbooks(office.workbooks(of_book.select("path", lines.alias("lines")), "Customers"))
