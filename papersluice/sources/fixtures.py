"""Input tables derived from the given ones: card texts, recognised lines, image metrics.

The same SQL text runs in Spark and in the checking engine; {table} stands for
how a given table is named there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.session import dealt, read_table, spread

#: Page layout of derived lines: left edge, indent of a second column, line height and pitch, character width, longest width in characters.
LEFT, INDENT, HEIGHT, PITCH, CHAR, LONGEST = 40, 700, 18, 30, 8, 12
PAGE_W, PAGE_H, PADDING = 1000, 1400, 20
#: Cards that a task renders, about a millisecond each once their fields are extracted.
CARDS_A_TASK = 20_000


def cards_sql(customer: str, clean: bool = False, more: str = "") -> str:
    """Identity-card texts rendered from customers; clean: the second recognition pass, without confused characters and missing names; more: further columns of customers."""
    confused, no_name = ("false", "false") if clean else ("c_custkey % 7 = 0", "c_custkey % 13 = 0")
    return f"""
SELECT doc_id{more}, true_type, CASE true_type
  WHEN 'noise' THEN concat('### ', l3, ' ***')
  WHEN 'pan' THEN concat_ws(chr(10), 'INCOME TAX DEPARTMENT', 'GOVT. OF INDIA',
     CASE WHEN no_name THEN NULL ELSE concat('RA', l3, ' KU', l1, 'AR') END,
     concat('Father''s Name: SA', l3, ' KU', l1, 'AR'),
     concat(dd, '/', mm, '/', yyyy), 'Permanent Account Number',
     concat(l3, 'P', l1, CASE WHEN confused THEN translate(d4, '018', 'OIB') ELSE d4 END, l1),
     CASE WHEN twice THEN concat(l3, 'C', l1, e4, l1) END, 'Signature')
  WHEN 'aadhaar' THEN concat_ws(chr(10), 'GOVERNMENT OF INDIA',
     CASE WHEN no_name THEN NULL ELSE concat('Name: Ra', lower(l3), ' Ku', lower(l1), 'ar') END,
     concat(CASE WHEN twice THEN 'Date of Birth / DOB : ' ELSE 'DOB: ' END, dd, '/', mm, '/', yyyy),
     CASE WHEN even THEN 'FEMALE' ELSE 'MALE' END,
     CASE WHEN confused THEN concat('2', substring(d4, 2, 3), e4, d4) ELSE concat(d4, ' ', e4, ' ', d4) END,
     concat('VID: 9', substring(d4, 2, 3), ' ', e4, ' ', d4, ' ', e4),
     concat('Address: ', d4, ' Main Street, Sector ', dd, ', Delhi 11', d4))
  ELSE concat_ws(chr(10), 'REGISTRATION CERTIFICATE',
     concat('Regn No: ', CASE WHEN confused THEN 'XX' ELSE 'DL' END, ' ', dd, ' A', l1, ' ', d4),
     CASE WHEN twice THEN concat('MH-', mm, '-B', l1, '-', e4) END,
     CASE WHEN no_name THEN NULL ELSE concat('Owner: RA', l3, ' KU', l1, 'AR.') END,
     concat('Engine No: E', l3, d4), concat('Chassis No: MA3', l3, d4, e4),
     concat('Reg Date: ', dd, '/', mm, '/', yyyy), 'Fuel: PETROL', 'Class: LMV', 'Seating Cap: 5',
     concat('Insurance upto: ', dd, '/', mm, '/2030'), concat('Mfg Date: ', mm, '/', yyyy)) END AS full_text
FROM (SELECT c_custkey AS doc_id{more},
    CASE WHEN c_custkey % 20 = 19 THEN 'noise' WHEN c_custkey % 3 = 0 THEN 'aadhaar'
         WHEN c_custkey % 3 = 1 THEN 'pan' ELSE 'vehicle_rc' END AS true_type,
    translate(lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '0123456789', 'ABCDEFGHIJ') AS l3,
    translate(CAST(c_custkey % 10 AS STRING), '0123456789', 'ABCDEFGHIJ') AS l1,
    lpad(CAST((c_custkey * 37) % 10000 AS STRING), 4, '0') AS d4,
    lpad(CAST((c_custkey * 7919) % 10000 AS STRING), 4, '0') AS e4,
    lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS dd,
    lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') AS mm,
    CAST(1950 + c_custkey % 80 AS STRING) AS yyyy,
    {confused} AS confused, c_custkey % 11 = 0 AS twice, {no_name} AS no_name, c_custkey % 2 = 0 AS even
  FROM {customer}) k"""


def cards(spark: SparkSession, sf_dir: str, clean: bool = False) -> DataFrame:
    """doc_id, true_type, full_text."""
    return spark.sql(cards_sql("{customer}", clean), customer=customers(spark, sf_dir))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", CARDS_A_TASK)


def layout_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Recognised lines of a text column: doc_id, line_num, text, confidence, x, y, w, h. Odd documents have every fourth line in a second column."""
    p, t = F.col("line_num"), F.col("t")
    return (
        docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_num", "t"))
        .where(F.trim("t") != "")
        .select(
            "doc_id",
            "line_num",
            t.alias("text"),
            (50 + (F.col("doc_id") * 31 + p * 17) % 50).cast("double").alias("confidence"),
            (LEFT + F.when((F.col("doc_id") % 2 == 1) & (p % 4 == 3), INDENT).otherwise(0)).cast("int").alias("x"),
            (PITCH * p).cast("int").alias("y"),
            (CHAR * F.least(F.length(t), F.lit(LONGEST))).cast("int").alias("w"),
            F.lit(HEIGHT).alias("h"),
        )
    )


def lines_sql(source: str, text: str) -> str:
    """layout_lines() for the checking engine; source: a table or a query in parentheses."""
    return f"""SELECT doc_id, CAST(p AS INT) AS line_num, t AS text, CAST(50 + (doc_id * 31 + p * 17) % 50 AS DOUBLE) AS confidence,
  CAST({LEFT} + {INDENT} * (CASE WHEN doc_id % 2 = 1 AND p % 4 = 3 THEN 1 ELSE 0 END) AS INT) AS x, CAST({PITCH} * p AS INT) AS y,
  CAST({CHAR} * least(length(t), {LONGEST}) AS INT) AS w, {HEIGHT} AS h
FROM (SELECT doc_id, unnest(range(len(s))) AS p, unnest(s) AS t FROM (SELECT doc_id, string_split({text}, chr(10)) AS s FROM {source}) z) y WHERE trim(t) <> ''"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_lines(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_lines(cards(spark, sf_dir), "full_text")


CARDS = f"({cards_sql('customer')})"
CLEAN_CARDS = f"({cards_sql('customer', clean=True)})"
DOCUMENT_LINES = f"({lines_sql('documents', 'text')})"
CARD_LINES = f"({lines_sql(CARDS + ' c', 'full_text')})"

METRICS = """SELECT l_orderkey * 10 + l_linenumber AS doc_id, l_extendedprice / 50 AS blur_score, l_quantity * 5 AS brightness_score,
  l_partkey * CAST(10000.0 AS DOUBLE) AS resolution_score, l_discount * 10 AS contrast_score, l_tax / 4 AS edge_density, l_tax AS glare_ratio FROM {table}"""


def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality metrics from line items; doc_id isn't a key."""
    return spark.sql(METRICS.format(table=f"parquet.`{sf_dir}/lineitem.parquet`"))
