"""The constructed calls corpus: one call per order, gold and places known from how it is made.

The same SQL runs in Spark and in DuckDB; {orders} and {customer} are the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def _spoken(digits: str, n: int) -> str:
    """SQL for n digits of a string expression as words."""
    case = "CASE substr({d}, {i}, 1) " + " ".join(f"WHEN '{k}' THEN '{w}'" for k, w in enumerate(_WORDS)) + " END"
    return " || ' ' || ".join(case.format(d=digits, i=i) for i in range(1, n + 1))


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_MET = "{orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"

VALUES = f"""
SELECT o.o_orderkey AS doc_id, o.o_custkey AS cust,
  '9' || lpad(CAST((o.o_orderkey * 7919) % 10000000 AS STRING), 7, '0') AS digits,
  '8' || lpad(CAST((o.o_orderkey * 104729) % 1000000000 AS STRING), 9, '0') AS account,
  CAST(100000 + (o.o_custkey * 3571) % 800000 AS STRING) AS postal,
  'Blk ' || CAST(o.o_custkey % 899 + 1 AS STRING) AS block,
  '#' || lpad(CAST(o.o_orderkey % 49 + 1 AS STRING), 2, '0') || '-' || CAST(o.o_orderkey % 299 + 100 AS STRING) AS unit,
  substr('STFG', CAST(o.o_orderkey % 4 + 1 AS INT), 1) || lpad(CAST((o.o_orderkey * 6007) % 10000000 AS STRING), 7, '0') || chr(CAST(65 + o.o_orderkey % 26 AS INT)) AS nric,
  'user' || CAST(o.o_custkey AS STRING) || '@example.com' AS email,
  {_pick("o.o_custkey", ["Alice Tan", "Ravi Kumar", "Mei Ling Wong", "Siti Rahman", "John Lim"])} AS name,
  {_pick("o.o_custkey", ["Tampines", "Bedok", "Toa Payoh", "Ang Mo Kio"])} AS area,
  CASE WHEN o.o_orderkey % 11 = 5 THEN 'negative' WHEN o.o_orderkey % 13 = 6 THEN 'lookalike' WHEN o.o_orderkey % 7 = 3 THEN 'spoken' ELSE 'plain' END AS kind,
  o.o_orderkey % 10 = 0 AS long_call
FROM {_MET}
"""

FILLER = "SPEAKER_00: Thank you for waiting while the system loads. "

CALLS = f"""
SELECT *, CASE kind
  WHEN 'negative' THEN 'SPEAKER_00: Hello there.' || chr(10) || 'SPEAKER_01: I only want to know when you open on Sunday, thanks.'
  WHEN 'lookalike' THEN 'SPEAKER_01: The reference is 123456 and the bill was $22289.53, code 896 372717 1, on the 5th floor.'
  ELSE 'SPEAKER_00: Good morning, how may I help you?' || chr(10)
    || 'SPEAKER_01: My name is ' || name || ' and my NRIC is ' || nric || '.' || chr(10)
    || 'SPEAKER_00: Which account is this about?' || chr(10) || 'SPEAKER_01: It is ' || account || '.' || chr(10)
    || 'SPEAKER_01: I stay at ' || block || ' ' || area || ' Street 21 ' || unit || ' Singapore ' || postal || '.' || chr(10)
    || 'SPEAKER_01: Call me on ' || phone || ' or write to ' || email || '.' || chr(10)
    || CASE WHEN long_call THEN repeat('{FILLER}', 60) || chr(10) ELSE '' END
    || 'SPEAKER_00: To confirm, that is ' || CASE kind WHEN 'spoken' THEN spoken ELSE phone END || ', thank you.'
  END AS text
FROM (SELECT *, substr(digits, 1, 4) || ' ' || substr(digits, 5, 4) AS phone, {_spoken("digits", 8)} AS spoken FROM ({VALUES}) v) w
"""


#: Keys of calls that one task makes texts of.
CALLS_PER_TASK = 50_000


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a DataFrame. Texts are long to scan and keys short to read, so keys are dealt
    out evenly before texts are made: to all cores at least, and to more tasks as there are more
    keys, however few row groups the files have and however the join falls out. A dealt key is not
    deterministic to Spark, which would otherwise move a filter on a text, and the text with it,
    into the few tasks that scan."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // CALLS_PER_TASK))
    keys = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(*orders.columns).repartition(tasks)
    keys = keys.withColumn("o_orderkey", F.col("o_orderkey") + F.monotonically_increasing_id() * 0)
    return spark.sql(CALLS.replace(_MET, "{keys} o"), keys=keys)


def calls_sql() -> str:
    return CALLS.format(orders="orders", customer="customer")


#: Calls with values, as a condition.
FULL = "kind IN ('plain', 'spoken')"
