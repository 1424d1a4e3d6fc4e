"""Career tables derived from the driver's tables, as views with one SQL text for Spark and DuckDB.

``{name}`` stands for another view or a driver table.  The texts are those of
FIXTURES.md; every view grows with the tables it reads, but for the two lists
of titles and degrees that decorate the rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "titles": """SELECT * FROM (VALUES (0,'Founder'),(1,'Co-Founder & CEO'),(2,'Owner'),(3,'Product Owner'),
  (4,'Software Engineer'),(5,'Sales Manager'),(6,'Assistant to Founder'),(7,'Salon Owner / Hairstylist'),
  (8,'Founding Engineer'),(9,'Co-Owner'),(10,'Homeowner Claims Adjuster'),(11,'Co-Founder & Founding Engineer'),
  (12,'Entrepreneur'),(13,'Analyst'),(14,'Future Owner'),(15,'Founders Fellow')) AS t(k, title)""",
    "subtitles": """SELECT * FROM (VALUES (0,'Bachelor of Science (BS), Computer Science'),
  (1,'Bachelor of Arts (B.A.), History, minor in Music'),(2,'Master of Business Administration, MBA'),
  (3,'Bachelor''s degree, Economics'),(4,'Associate of Arts'),(5,'Ph.D., Physics'),(6,'B.S. Nursing'),(7,'(BS)'),
  (8,'Bachelor of Arts, Asian Studies'),(9,'MS Biology'),(10,'Juris Doctor, Law'),
  (11,'Bachelor of Science, Mathematics')) AS t(k, subtitle)""",
    "experience": """SELECT l.l_orderkey*8 + l.l_linenumber AS id, o.o_custkey AS member_id, t.title AS title,
  CASE WHEN l.l_suppkey % 17 = 0 THEN NULL WHEN l.l_suppkey % 13 = 0 THEN 'Self-Employed'
    ELSE concat('Firm ', CAST(l.l_suppkey % 40 AS VARCHAR(10)),
      CASE l.l_suppkey % 3 WHEN 0 THEN ' Inc' WHEN 1 THEN ' LLC' ELSE '' END) END AS company_name,
  CASE WHEN l.l_partkey % 5 = 0 THEN NULL
    ELSE concat('https://uk.example.com/company/firm-', CAST(l.l_partkey AS VARCHAR(10)),
      CASE l.l_partkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '?trk=x' ELSE '' END) END AS company_url,
  CASE WHEN l.l_linenumber = 7 THEN NULL
    WHEN l.l_linenumber % 2 = 0 THEN concat('March ', CAST(year(o.o_orderdate) AS VARCHAR(10)))
    ELSE CAST(year(o.o_orderdate) AS VARCHAR(10)) END AS date_from,
  CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE CAST(year(l.l_shipdate) AS VARCHAR(10)) END AS date_to
  FROM {lineitem} l
  JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  JOIN {titles} t ON t.k = (l.l_partkey + l.l_suppkey) % 16""",
    "education": """SELECT c.c_custkey AS id, c.c_custkey AS member_id,
  CASE WHEN c.c_custkey % 11 = 0 THEN 'University of Phoenix'
    WHEN c.c_custkey % 4 = 0 THEN concat(' The University of ', n.n_name)
    WHEN c.c_custkey % 4 = 1 THEN concat('Univ of ', n.n_name)
    ELSE concat('University of ', n.n_name) END AS title, s.subtitle AS subtitle,
  CASE WHEN c.c_custkey % 19 = 0 THEN NULL
    WHEN c.c_custkey % 23 = 0 THEN 'https://www.example.com/edu/school'
    ELSE concat('https://www.example.com/school/', CAST(n.n_nationkey AS VARCHAR(10))) END AS school_url,
  CAST(1986 + c.c_custkey % 8 AS VARCHAR(10)) AS date_from,
  CASE WHEN c.c_custkey % 29 = 0 THEN 'n/a' ELSE CAST(1990 + c.c_custkey % 8 AS VARCHAR(10)) END AS date_to,
  n.n_nationkey AS unitid
  FROM {customer} c
  JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  JOIN {subtitles} s ON s.k = c.c_custkey % 12""",
    "universities": """SELECT n_nationkey AS unitid, concat('University of ', n_name) AS instnm FROM {nation}
  UNION ALL SELECT 100 + r_regionkey AS unitid,
  CASE WHEN r_regionkey < 2 THEN 'Duplicate State College' ELSE concat(r_name, ' State College') END AS instnm
  FROM {region}""",
    "companies": """SELECT concat('http://www.example.com/company/firm-', CAST(p_partkey AS VARCHAR(10))) AS url,
  CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE CAST(1880 + p_partkey % 160 AS VARCHAR(10)) END AS founded
  FROM {part}""",
    "company_scores": """SELECT concat('Firm ', CAST(s_suppkey % 40 AS VARCHAR(10)),
  CASE s_suppkey % 3 WHEN 0 THEN ' Inc' WHEN 1 THEN ' LLC' ELSE '' END) AS company_name,
  avg((s_acctbal + 1000) / 11000) AS fb_ad_prob FROM {supplier} GROUP BY 1""",
    "entities": """SELECT concat('FIRM ', CAST(s_suppkey % 40 AS VARCHAR(10)),
  CASE s_suppkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Corp' ELSE '' END) AS entity_name
  FROM {supplier} WHERE s_suppkey % 40 < 30 GROUP BY 1
  UNION ALL SELECT 'The Co.' AS entity_name""",
    "entities_more": """SELECT entity_name FROM {entities}
  UNION SELECT concat('Firm ', CAST(s_suppkey % 7 AS VARCHAR(10)), ' ',
  split_part('Inc,Ltd,LLC,PLC,LP,LLP,GmbH,AG,SA,BV,NV,Oy,Pty', ',', CAST(1 + s_suppkey % 13 AS INT))) AS entity_name
  FROM {supplier}""",
    "profiles": """SELECT c_custkey AS id,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS DOUBLE) / 100 END AS prob_female
  FROM {customer}
  UNION ALL SELECT 100000 + c_custkey AS id, CAST(NULL AS DOUBLE) AS prob_female
  FROM {customer} WHERE c_custkey < 20""",
}

#: Tables whose rows only decorate others.
SMALL = ("region", "nation", "supplier", "part", "customer", "orders", "labels", "benchmark")

#: Host and generic school URL of the fixture views.
HOST = "example.com"
GENERIC_SUFFIX = "example.com/edu/school"


def parts_of(name: str) -> list[str]:
    """Views and tables a view reads."""
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.

    Big inputs come in more splits than there are cores and are left alone.  A
    row group would be worked on by one task up to the first shuffle, however
    many splits its file is cut into, so a table of fewer row groups than cores
    is dealt out to all cores.  Only the footers are read to count them.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if name in SMALL or splits_with_rows(df, cores) >= cores else df.repartition(cores)


def splits_with_rows(df: DataFrame, least: int) -> int:
    """Splits that hold rows; their number in all, where that is already below ``least``."""
    splits = df.rdd.getNumPartitions()
    return splits if splits < least else df.select(F.spark_partition_id().alias("split")).distinct().count()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view or a driver table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    return spark.sql(VIEWS[name], **{p: load(spark, sf_dir, p) for p in parts_of(name)})


def with_clauses(*names: str) -> str:
    """The views and what they read as the WITH list of an oracle query."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in done:
            for p in parts_of(name):
                add(p)
            done.append(name)

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in done)
