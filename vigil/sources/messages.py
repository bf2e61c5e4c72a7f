"""Messages: read from files, or derived from the orders of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One template for each remainder of the order key; the text runs on Spark and on the oracle alike.
TEXT_SQL = f"""CASE k
 WHEN 0 THEN 'Your North Pay account was credited with INR ' || n || '. Ref 9000' || n || '77. Never share your OTP code.'
 WHEN 1 THEN 'Zen Bank: your statement no ' || n || ' is ready.'
 WHEN 2 THEN 'Dear Customer, QuikMart order ' || n || ' is packed. Call +91 98765' || (n % 90000 + 10000)
 WHEN 3 THEN 'NorthPay alert: account will be blocked. Visit http://northpay-' || n || '.xyz/login within 24 hours'
 WHEN 4 THEN 'sola update pending, see https://soal.in/kyc?id=' || n || ' now'
 WHEN 5 THEN 'See photos http://10.0.' || (n % 250) || '.7/x' || n
 WHEN 6 THEN 'Track it here bit.ly/a' || n || ' thanks'
 WHEN 7 THEN 'North Pay receipt https://northpay.click/r/' || n
 WHEN 8 THEN 'Winner! You won a prize. Pay the processing fee within 24 hours or account is closed. Share OTP code ' || n
 WHEN 9 THEN 'Orbit Wallet: do not share OTP code ' || n || ' with anyone, share code never'
 WHEN 10 THEN 'Lumen Post: details at https://www.lumenpost.net/p/' || n
 WHEN 11 THEN 'Dear Ravi Kumar, Zen Bank and Carrow: http://zenbank.verify-' || n || '.top/otp and http://carr0w.com/pay ref 12345678901' || (n % 10)
 WHEN 12 THEN 'Aapka khata band hai, inaam mila, code batao pin ' || n
 WHEN 13 THEN 'Hello from ' || c_name || ', meet at ' || (n % 12) || ' near user@mail.example.com or v1.2.3'
 WHEN 14 THEN '\uff33\uff48\uff41\uff52\uff45 your\u00a0OTP co\u200bde ' || n
 WHEN 15 THEN 'NorthPay notice: pay at https://n\u043erthpay.com/pay/' || n
 ELSE 'Part-time job: earn $' || n || ' today. Carrow pays, ask carrow at xn--80ak6aa92e.com/jobs' END"""
SENDER_SQL = """CASE k WHEN 0 THEN 'AB-NRTHPY' WHEN 1 THEN 'AB-QKMART' WHEN 2 THEN '98' || CAST(10000000 + n AS STRING)
 WHEN 9 THEN 'XY-ORBITW' WHEN 10 THEN 'XY-SHARED' WHEN 11 THEN 'ZZ-UNKNWN' ELSE NULL END"""


def messages_sql(orders: str = "orders", customer: str = "customer") -> str:
    return f"""SELECT msg_id, cust_id, nation_id, segment, {SENDER_SQL} AS sender_hint, {TEXT_SQL} AS text FROM (
      SELECT o_orderkey AS msg_id, o_custkey AS cust_id, c_nationkey AS nation_id, c_mktsegment AS segment, c_name,
             o_orderkey % 17 AS k, o_orderkey % 9000 + 1000 AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey) AS o"""


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt out by ``key`` if it is read in fewer splits than there are cores: what follows is much work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, cust_id, nation_id, segment, sender_hint, text: one message for each order."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(messages_sql("{orders}", "{customer}"), orders=dealt(read("orders").select("o_orderkey", "o_custkey"), "o_orderkey"), customer=read("customer"))


#: Domains that are known to be established, and how old some others are; the same text runs on the oracle.
RANKED_SQL = "SELECT 'northpay-' || (p_partkey % 9000 + 1000) || '.xyz' AS domain FROM {part} WHERE p_partkey % 2 = 0 UNION SELECT 'soal.in' FROM {part}"
AGES_SQL = "SELECT 'verify-' || (p_partkey % 9000 + 1000) || '.top' AS domain, min(p_partkey % 60) AS age_days FROM {part} WHERE p_partkey % 3 <> 1 GROUP BY 1"
#: A link and the domain that it leads to, and HTML around it in seven forms.
HTML_SQL = """SELECT o_orderkey AS msg_id, CASE o_orderkey % 7
 WHEN 0 THEN '<p>Hello, <a href="' || u || '">' || d || '</a></p>'
 WHEN 1 THEN '<A class=''x'' HREF=''' || u || '''><b>www.</b>' || upper(d) || '</A>'
 WHEN 2 THEN '<div><a href=' || u || '>zenbank.in</a> and <a name="top">' || d || '</a></div>'
 WHEN 3 THEN '<a title="a > b" href="' || u || '">Zen&#32;Bank &#x6c;ogin</a>'
 WHEN 4 THEN '<!-- <a href="http://old.example.com/">old</a> --><a href="' || u || '">see <i>' || d || '</i>  </a>'
 WHEN 5 THEN '<script>var x = 1; // <a href="http://js.example.com">x</a></script><a href="/local">' || d || '</a><a href="mailto:x@y.z">mail</a>'
 ELSE 'no link' END AS html FROM (SELECT o_orderkey,
   CASE o_orderkey % 3 WHEN 0 THEN 'https://northpay-' || (o_orderkey % 9000 + 1000) || '.xyz/login?a=1&amp;b=2' WHEN 1 THEN 'http://www.lumenpost.net/p/' || o_orderkey ELSE 'https://carrow.com/t/' || o_orderkey END AS u,
   CASE o_orderkey % 3 WHEN 0 THEN 'northpay-' || (o_orderkey % 9000 + 1000) || '.xyz' WHEN 1 THEN 'lumenpost.net' ELSE 'carrow.com' END AS d FROM {orders}) AS o"""


#: Messages in the seven languages that rules are written for, and one that no rule is.
SPOKEN_SQL = """SELECT o_orderkey AS msg_id, CASE o_orderkey % 9
 WHEN 0 THEN 'आपको इनाम मिला है ' || o_orderkey WHEN 1 THEN 'अपना ओटीपी ' || o_orderkey || ' बताएं' WHEN 2 THEN 'तुमचे खाते उद्या बंद होणार आहे ' || o_orderkey
 WHEN 3 THEN 'আপনি একটি পুরস্কার পেয়েছেন ' || o_orderkey WHEN 4 THEN 'உங்களுக்கு பரிசு கிடைத்தது ' || o_orderkey WHEN 5 THEN 'మీకు బహుమతి వచ్చింది ' || o_orderkey
 WHEN 6 THEN 'aapko inaam mila hai ' || o_orderkey WHEN 7 THEN 'You won a prize ' || o_orderkey ELSE 'विज्ञापन: इनाम ' || o_orderkey END AS text FROM {orders}"""


def spoken_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, text: a message in one of seven languages for each order."""
    return spark.sql(SPOKEN_SQL, orders=dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey"))


def ranked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RANKED_SQL, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def domain_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(AGES_SQL, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def html_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, html: a message in HTML for each order."""
    return spark.sql(HTML_SQL, orders=dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey"))


#: White space of every kind: blanks, tabs, line ends, the separators among control characters, no-break and other wide blanks.
WHITE = r"[\s\x0B\x1C-\x1F\p{Z}]"
#: Files are stripped of the next-line character too.
WHITE_OF_FILES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def is_blank(text: Column) -> Column:
    """Whether a text holds nothing but white space; null for null."""
    return text.rlike(rf"^{WHITE}*\z")


def stripped(text: Column) -> Column:
    """``text`` without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"^{WHITE_OF_FILES}+", ""), rf"{WHITE_OF_FILES}+\z", "")


def from_csv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """text: one trimmed, non-empty value of a CSV column; no rows if the column is missing."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if column not in raw.columns:
        return spark.createDataFrame([], "text string")
    return raw.select(stripped(F.col(f"`{column}`")).alias("text")).where("text <> ''")


def from_lines(spark: SparkSession, path: str) -> DataFrame:
    """text: one trimmed, non-empty line."""
    return spark.read.text(path).select(stripped(F.col("value")).alias("text")).where("text <> ''")


def from_tsv(spark: SparkSession, path: str) -> DataFrame:
    """label, text: split at the first tab; a line without one is a label with an empty text."""
    return spark.read.text(path).selectExpr("substring_index(value, '\t', 1) AS label", "CASE WHEN contains(value, '\t') THEN substr(value, instr(value, '\t') + 1) ELSE '' END AS text")


def shared(texts: DataFrame) -> DataFrame:
    """``texts`` with a blank or null text as null: what a share or a selection without text gives."""
    return texts.withColumn("text", F.when(~is_blank(F.col("text")), F.col("text")))


def entered(texts: DataFrame) -> DataFrame:
    """Rows with a text that is not blank, as typed or pasted by hand; these never have a sender."""
    return texts.where(~is_blank(F.col("text"))).withColumn("sender_hint", F.lit(None).cast("string"))


ROW = "id string, text string, lang string, source string, collected_at string, label int, category string, is_hard_negative boolean, split string, labeled_by string, labeled_at string"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Dataset rows of a JSON-lines file."""
    return spark.read.schema(ROW).json(path)


def write_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
