"""The canonical fact table, and fact views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vocabulary import DISTRICTS
from ..operators.windows import numbered

FACT_SCHEMA = T.StructType(
    [
        T.StructField("fact_id", T.StringType()),
        T.StructField("district", T.StringType()),
        T.StructField("indicator", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source_document", T.StringType()),
        T.StructField("source_page", T.IntegerType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("ord", T.LongType()),
    ]
)

#: part type, indicator, divisor of its sales, unit
MEASURES = [
    ("ECONOMY", "Total Enrollment", 100.0, "count"),
    ("LARGE", "Boys Enrollment", 200.0, "count"),
    ("MEDIUM", "Girls Enrollment", 200.0, "count"),
    ("PROMO", "Number of Teachers", 1000.0, "count"),
    ("SMALL", "Pupil Teacher Ratio", 50000.0, "ratio"),
    ("STANDARD", "Dropout Rate", 40000.0, "%"),
]
PREFIXES = ["go_", "cse_", "scert_", "education_act_", "service_rule_"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each nation, part type and order year: sales, scaled to the range of an education indicator.

    Nations 0 to 12 bear the known districts' names, the others their own, so both valid and invalid facts occur.
    Sales are summed as decimals, by keys, before the small dimensions are joined.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    sold = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    sums = sold.groupBy("c_nationkey", "p_type", "y").agg(F.sum("price").cast("double").alias("sales"))
    at = F.create_map(*[x for i, m in enumerate(MEASURES) for x in (F.lit(m[0]), F.lit(i))])
    sums = sums.withColumn("m", at[F.col("p_type")]).where("m IS NOT NULL")
    measure = F.element_at(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("by"), F.lit(u).alias("unit")) for _, n, d, u in MEASURES]), F.col("m") + 1)
    k, year = F.col("n_nationkey"), F.col("y") + 20
    district = F.when(k < len(DISTRICTS), F.get(F.array(*map(F.lit, DISTRICTS)), k)).otherwise(F.col("n_name"))
    category = F.when(measure["name"] == "Boys Enrollment", "Boys").when(measure["name"] == "Girls Enrollment", "Girls")
    return sums.join(nation, F.col("c_nationkey") == k).select(
        F.concat(F.lit("F"), F.lpad(k.cast("string"), 2, "0"), F.lit("_"), F.col("m").cast("string"), F.lit("_"), year.cast("string")).alias("fact_id"),
        district.alias("district"),
        measure["name"].alias("indicator"),
        category.alias("category"),
        year.cast("int").alias("year"),
        F.round(F.col("sales") / measure["by"], 2).alias("value"),
        F.when(k % 7 == 3, "count").otherwise(measure["unit"]).alias("unit"),
        F.concat(F.get(F.array(*map(F.lit, PREFIXES)), F.col("n_regionkey")), F.lit("report_"), year.cast("string"), F.lit(".pdf")).alias("source_document"),
        (F.col("m") + 1).cast("int").alias("source_page"),
        ((5 + k % 5) / F.lit(10.0)).alias("confidence_score"),
        (k * 1000 + F.col("m") * 100 + F.col("y") - 1980).cast("long").alias("ord"),
    )


_CASES = " ".join(f"WHEN '{t}' THEN {i}" for i, (t, *_) in enumerate(MEASURES))
_NAMES, _UNITS = ", ".join(f"'{m[1]}'" for m in MEASURES), ", ".join(f"'{m[3]}'" for m in MEASURES)
_BY = ", ".join(f"{m[2]}::DOUBLE" for m in MEASURES)
_DISTRICTS, _PREFIXES = ", ".join(f"'{d}'" for d in DISTRICTS), ", ".join(f"'{p}'" for p in PREFIXES)
#: the same view in SQL
FACTS_SQL = f"""
SELECT 'F' || lpad(n_nationkey::VARCHAR, 2, '0') || '_' || m || '_' || (y + 20) AS fact_id,
  CASE WHEN n_nationkey < {len(DISTRICTS)} THEN ([{_DISTRICTS}])[n_nationkey + 1] ELSE n_name END AS district,
  ([{_NAMES}])[m + 1] AS indicator, CASE m WHEN 1 THEN 'Boys' WHEN 2 THEN 'Girls' END AS category, (y + 20)::INTEGER AS year,
  round(sales / ([{_BY}])[m + 1], 2) AS value, CASE WHEN n_nationkey % 7 = 3 THEN 'count' ELSE ([{_UNITS}])[m + 1] END AS unit,
  ([{_PREFIXES}])[n_regionkey + 1] || 'report_' || (y + 20) || '.pdf' AS source_document, (m + 1)::INTEGER AS source_page,
  (5 + n_nationkey % 5) / 10.0::DOUBLE AS confidence_score, (n_nationkey * 1000 + m * 100 + y - 1980)::BIGINT AS ord
FROM (SELECT c_nationkey, CASE p_type {_CASES} END AS m, year(o_orderdate) AS y, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS sales
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) s
JOIN nation ON c_nationkey = n_nationkey WHERE m IS NOT NULL
"""


#: divisors of a single sale, by measure
ROW_DIVISORS = [1.0, 2.0, 2.0, 100.0, 2000.0, 1000.0]
#: what tells sales apart, and so orders them
SALE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def facts_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each sale, so that facts grow with the tables (values are whole); ``ord`` numbers the sales in their order."""
    sales = numbered(table(spark, sf_dir, "lineitem").select(*SALE), SALE, "ord")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("y"))
    # orders repeat no key, customers and parts neither, so each sale gives a fact at most
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    buyers = orders.join(customer, "o_custkey")  # before they meet the sales, which are more
    sold = sales.join(buyers, "l_orderkey").join(part, "l_partkey").join(F.broadcast(nation), "c_nationkey")
    at = F.create_map(*[x for i, m in enumerate(MEASURES) for x in (F.lit(m[0]), F.lit(i))])
    sold = sold.withColumn("m", at[F.col("p_type")]).where("m IS NOT NULL")
    measure = F.element_at(F.array(*[F.struct(F.lit(m[1]).alias("name"), F.lit(d).alias("by"), F.lit(m[3]).alias("unit")) for m, d in zip(MEASURES, ROW_DIVISORS, strict=True)]), F.col("m") + 1)
    k, year = F.col("c_nationkey"), (F.col("y") + 20).cast("int")
    return sold.select(
        F.concat(F.lit("L"), F.col("ord").cast("string")).alias("fact_id"),
        F.when(k < len(DISTRICTS), F.get(F.array(*map(F.lit, DISTRICTS)), k)).otherwise(F.col("n_name")).alias("district"),
        measure["name"].alias("indicator"),
        F.col("c_mktsegment").alias("category"),
        year.alias("year"),
        F.floor(F.col("l_extendedprice") / measure["by"]).cast("double").alias("value"),
        F.when(k % 7 == 3, "count").otherwise(measure["unit"]).alias("unit"),
        F.concat(F.get(F.array(*map(F.lit, PREFIXES)), F.col("n_regionkey")), F.lit("report_"), year.cast("string"), F.lit(".pdf")).alias("source_document"),
        F.col("l_linenumber").alias("source_page"),
        ((5 + k % 5) / F.lit(10.0)).alias("confidence_score"),
        F.col("ord").cast("long").alias("ord"),
    )


FACT_ROWS_SQL = f"""
SELECT 'L' || ord AS fact_id, CASE WHEN c_nationkey < {len(DISTRICTS)} THEN ([{_DISTRICTS}])[c_nationkey + 1] ELSE n_name END AS district, ([{_NAMES}])[m + 1] AS indicator, c_mktsegment AS category, (y + 20)::INTEGER AS year,
  floor(l_extendedprice / ([{", ".join(f"{d}::DOUBLE" for d in ROW_DIVISORS)}])[m + 1]) AS value, CASE WHEN c_nationkey % 7 = 3 THEN 'count' ELSE ([{_UNITS}])[m + 1] END AS unit,
  ([{_PREFIXES}])[n_regionkey + 1] || 'report_' || (y + 20) || '.pdf' AS source_document, l_linenumber AS source_page, (5 + c_nationkey % 5) / 10.0::DOUBLE AS confidence_score, ord
FROM (SELECT s.*, c_nationkey, c_mktsegment, CASE p_type {_CASES} END AS m, year(o_orderdate) AS y FROM (SELECT *, row_number() OVER (ORDER BY {", ".join(SALE)}) AS ord FROM lineitem) s
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey) JOIN nation ON c_nationkey = n_nationkey WHERE m IS NOT NULL
"""


def legal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: a government order's text for every order, with references, headings, clauses and dates."""
    # patterns cost more than rows weigh, so the small table is dealt to all cores
    o = table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    n, y = F.col("o_orderkey").cast("string"), (F.year("o_orderdate") + 20).cast("string")
    before = (F.year("o_orderdate") + 19).cast("string")
    c = F.col("o_custkey").cast("string")
    text = F.concat(
        F.lit("Government Order No. "), n, F.lit("/"), y, F.lit("\nhereby supersedes G.O. No. "), c, F.lit("/"), before,
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(" in part")).otherwise(F.lit("")),
        F.lit("\nPART "), (F.col("o_orderkey") % 4 + 1).cast("string"), F.lit(" General\nCHAPTER "), (F.col("o_custkey") % 5 + 1).cast("string"), F.lit(" Schools\n1. Short title\n(a) This order covers Section 12(a) of The Education Act, "), before,
        F.lit(" and Rule 7 as amended by notice of "), before,
        F.lit("\n2. Effect\n(b) effective from "), F.date_format("o_orderdate", "d/M/yyyy"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("\nin Guntur by order of the education department")).otherwise(F.lit("")),
        F.lit("\nStep 1: apply"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


LEGAL_SQL = """
SELECT o_orderkey AS doc_id, 'Government Order No. ' || o_orderkey || '/' || (year(o_orderdate) + 20) || chr(10) || 'hereby supersedes G.O. No. ' || o_custkey || '/' || (year(o_orderdate) + 19)
  || CASE WHEN o_orderkey % 3 = 0 THEN ' in part' ELSE '' END || chr(10) || 'PART ' || (o_orderkey % 4 + 1) || ' General' || chr(10) || 'CHAPTER ' || (o_custkey % 5 + 1) || ' Schools' || chr(10) || '1. Short title' || chr(10)
  || '(a) This order covers Section 12(a) of The Education Act, ' || (year(o_orderdate) + 19) || ' and Rule 7 as amended by notice of ' || (year(o_orderdate) + 19) || chr(10) || '2. Effect' || chr(10)
  || '(b) effective from ' || day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'in Guntur by order of the education department' ELSE '' END || chr(10) || 'Step 1: apply' AS text
FROM orders
"""
