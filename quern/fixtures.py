"""Posting tables derived from the synthetic star schema, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TITLE = """
CASE k % 10 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Sr. ' WHEN 2 THEN 'Staff ' WHEN 3 THEN 'Principal ' WHEN 4 THEN 'Junior '
    WHEN 6 THEN 'Director of ' WHEN 8 THEN 'Lead ' ELSE '' END
|| CASE c % 9 WHEN 0 THEN 'Data Scientist' WHEN 1 THEN 'Machine Learning Engineer' WHEN 2 THEN 'Data Engineer' WHEN 3 THEN 'Business Analyst'
    WHEN 4 THEN 'Research Scientist' WHEN 5 THEN 'AI Engineer' WHEN 6 THEN 'Software Engineer' WHEN 7 THEN 'Engineering Manager' ELSE 'Decision Scientist' END
|| CASE WHEN k % 101 = 0 THEN ' - Talent Community' WHEN k % 13 = 0 THEN ' (Remote)' ELSE '' END
"""
_LOCATION = """
CASE k % 12 WHEN 0 THEN 'San Francisco, CA' WHEN 1 THEN 'New York, NY, United States' WHEN 2 THEN 'Toronto, ON, Canada' WHEN 3 THEN 'Vancouver, British Columbia'
    WHEN 4 THEN 'Remote - US' WHEN 5 THEN 'Hybrid - New York, NY' WHEN 6 THEN 'London, UK' WHEN 7 THEN 'Seattle, WA' WHEN 8 THEN 'Remote'
    WHEN 9 THEN 'Austin, Texas' WHEN 11 THEN 'Boston, MA / Remote' END
"""
_PERIOD = "CASE k % 10 WHEN 0 THEN 'hour' WHEN 4 THEN 'month' ELSE 'year' END"
_FACTOR = "CASE k % 10 WHEN 0 THEN 2080 WHEN 4 THEN 12 ELSE 1 END"
_DESCRIPTION = """
CASE k % 3 WHEN 0 THEN 'Minimum ' || CAST(k % 12 + 1 AS STRING) || '+ years of experience. '
    WHEN 1 THEN CAST(k % 6 + 1 AS STRING) || '-' || CAST(k % 6 + 4 AS STRING) || ' years of experience required. ' ELSE 'We ship fast. ' END
|| CASE k % 5 WHEN 0 THEN 'Bachelor' || chr(39) || 's degree required. ' WHEN 1 THEN 'PhD preferred. ' WHEN 2 THEN 'MBA or graduate degree welcome. ' ELSE '' END
|| CASE k % 4 WHEN 0 THEN 'We use Python, SQL and AWS. ' WHEN 1 THEN 'Kafka and dbt daily. ' WHEN 2 THEN 'PyTorch with LLMs on Kubernetes. ' ELSE '' END
|| CASE k % 2 WHEN 0 THEN 'Base salary range $' || CAST(90 + k % 60 AS STRING) || ',000 - $' || CAST(160 + k % 80 AS STRING) || ',000 USD per year. ' ELSE '401(k) match up to 100%. ' END
|| CASE k % 6 WHEN 0 THEN 'This is a hybrid role. ' WHEN 1 THEN 'Fully remote team. ' WHEN 2 THEN 'On-site only. ' ELSE '' END
|| CASE k % 8 WHEN 0 THEN 'RSUs and a signing bonus. ' WHEN 1 THEN 'Stock options granted. ' WHEN 2 THEN 'Annual bonus and no relocation. ' WHEN 3 THEN 'Relocation assistance and a retention bonus. ' ELSE '' END
|| CASE WHEN k % 17 = 0 THEN 'Active TS/SCI clearance needed. ' WHEN k % 17 = 1 THEN 'Top Secret clearance is not required. ' WHEN k % 17 = 2 THEN 'Public Trust position. ' ELSE '' END
|| CASE WHEN k % 19 = 0 THEN 'Must be a US citizen. ' WHEN k % 19 = 1 THEN 'Canadian citizen only. ' ELSE '' END
|| CASE WHEN k % 23 = 0 THEN 'We offer visa sponsorship. ' WHEN k % 23 = 1 THEN 'We do not sponsor visas. ' ELSE '' END
|| CASE WHEN k % 29 = 0 THEN 'Join the on-call rotation. ' WHEN k % 29 = 1 THEN 'There is no on-call work. ' ELSE '' END
|| CASE WHEN k % 31 = 0 THEN 'Travel up to 25%. ' WHEN k % 31 = 1 THEN 'No travel. ' ELSE '' END
|| CASE WHEN k % 37 = 0 THEN 'Fluent English and fluent French. ' WHEN k % 37 = 1 THEN 'Native Japanese. ' ELSE '' END
|| CASE k % 9 WHEN 0 THEN 'Full-time. ' WHEN 1 THEN 'Part-time. ' WHEN 2 THEN 'Contract role. ' WHEN 3 THEN 'Summer internship. ' WHEN 4 THEN 'Temporary position. ' ELSE '' END
|| CASE WHEN k % 41 = 0 THEN 'You will manage 8 direct reports. ' ELSE '' END
"""
_JOBS = f"""
SELECT substr({{sha}}(c_name || '|https://x.example/jobs/' || CAST(k AS STRING){{bits}}), 1, 16) AS id, k, 'company_' || CAST(c % 65 AS STRING) AS company_slug,
    'Company ' || CAST(c % 65 AS STRING) AS company_name, {_TITLE} AS title, 'https://x.example/jobs/' || CAST(k AS STRING) AS url, {_LOCATION} AS location_raw,
    k % 2 = 0 AS salary_disclosed,
    CASE WHEN k % 2 = 0 THEN floor(o_totalprice / {_FACTOR} * 100) / 100 END AS salary_max,
    CASE WHEN k % 2 = 0 THEN floor(0.4 * (o_totalprice / {_FACTOR}) * 100) / 100 END AS salary_min,
    CASE WHEN k % 20 = 0 THEN 'CAD' WHEN k % 2 = 0 THEN 'USD' END AS salary_currency,
    CASE WHEN k % 2 = 0 THEN {_PERIOD} END AS salary_period,
    CASE k % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS source,
    CASE WHEN k % 7 <> 0 THEN o_orderdate END AS posted_at, {_DESCRIPTION} AS description_md,
    round(o_totalprice * 0.9 + 10000, 2) AS predicted_salary_usd_v1
FROM """
_ROWS = """(SELECT o_orderkey AS k, o_custkey AS c, o_totalprice, o_orderdate, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey)
"""
#: Snapshot date by index; index s holds job k when s >= k % 3, and not when k % 5 = 0 and s = 3; k % 97 = 0 occurs twice in s = 2.
SNAPSHOT_DATES = ("2026-05-01", "2026-05-08", "2026-05-15", "2026-05-22")
JOBS_ORACLE = _JOBS.format(sha="sha256", bits="") + _ROWS.format(orders="orders", customer="customer")
_MEMBER = "{s} >= k % 3 AND NOT (k % 5 = 0 AND {s} = 3)"


def snapshot_sql(columns: str, source: str, s: int) -> str:
    sql = f"SELECT {columns}, DATE '{SNAPSHOT_DATES[s]}' AS snapshot_date FROM {source} WHERE {_MEMBER.format(s=s)}"
    if s == 2:
        sql += f" UNION ALL SELECT {columns}, DATE '{SNAPSHOT_DATES[s]}' AS snapshot_date FROM {source} WHERE {_MEMBER.format(s=s)} AND k % 97 = 0"
    return sql


_COLUMNS = "id, k, company_slug, title, source"
SNAPSHOTS_ORACLE = "\nUNION ALL BY NAME ".join(f"({snapshot_sql(_COLUMNS + ('' if s == 0 else ', description_md'), 'jobs', s)})" for s in range(4))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of stored orders whose postings make one task.
_DEALT = 1 << 21


def _tasks(orders: DataFrame) -> int:
    """A task for each 2 MB of the table's files, and one for each core at least: how a file is cut into row groups says nothing of the work."""
    spark, size = orders.sparkSession, 0
    for path in orders.inputFiles():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    return max(spark.sparkContext.defaultParallelism, -(-size // _DEALT))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting an order, with ``k`` its number.  Orders are dealt to tasks as numbers, after the join; texts are made where they are read."""
    orders = table(spark, sf_dir, "orders")
    rows = spark.sql(f"SELECT * FROM {_ROWS}", orders=orders, customer=table(spark, sf_dir, "customer"))
    return spark.sql(_JOBS.format(sha="sha2", bits=", 256") + "{rows}", rows=rows.repartition(_tasks(orders)))


def snapshots(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Four dated snapshots of ``jobs``; the first lacks a column, one holds duplicates."""
    base = jobs(spark, sf_dir)
    return [spark.sql(snapshot_sql(_COLUMNS + ("" if s == 0 else ", description_md"), "{jobs}", s), jobs=base) for s in range(4)]
