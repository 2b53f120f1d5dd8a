"""Maps the driver's tables to cohort tables (persons, events, hospital spells, doses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per person with demographics and condition flags."""
    k = F.col("c_custkey")
    every = {
        "sev_obesity": 11, "chronic_heart_disease": 13, "chronic_kidney_disease": 17, "diabetes": 19,
        "chronic_liver_disease": 23, "chronic_resp_disease": 29, "chronic_neuro_disease": 31,
        "immunosuppressed": 37, "learndis": 41, "sev_mental": 43, "flu_vaccine": 3, "cev": 47,
        "hscworker": 59, "care_home": 61, "endoflife": 67, "housebound": 71,
    }
    places = (
        load(spark, sf_dir, "nation")
        .join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    return (
        load(spark, sf_dir, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            (k + 1).cast("long").alias("patient_id"),
            (66 + (k * 7) % 30).cast("int").alias("age"),
            F.when(k % 97 == 0, None).when(k % 2 == 0, "F").otherwise("M").alias("sex"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            F.when(k % 53 != 0, (k * 311) % 32844).cast("int").alias("imd"),
            F.when(k % 7 < 5, (k % 7 + 1).cast("string")).alias("ethnicity"),
            F.when(k % 6 < 5, (k % 6 + 1).cast("string")).alias("ethnicity_6_sus"),
            *[(k % m == 0).alias(c) for c, m in every.items()],
            (k % 101 != 0).alias("has_follow_up_previous_year"),
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dated event of a person."""
    pri, price = F.col("o_orderpriority"), F.col("o_totalprice")
    kind = (
        F.when(pri == "1-URGENT", "pfizer").when(pri == "2-HIGH", "az").when(pri == "3-MEDIUM", "admission")
        .when((pri == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "F"), "postest")
        .when(pri == "4-NOT SPECIFIED", "test")
        .when(price > 400000, "death").when(price < 20000, "dereg").otherwise("other")
    )
    return load(spark, sf_dir, "orders").select(
        (F.col("o_custkey") + 1).cast("long").alias("patient_id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderkey").alias("event_id"),
        price.alias("value"),
        kind.alias("kind"),
    )


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hospital spells; a tenth have no discharge date."""
    eid = F.col("event_id")
    return events(spark, sf_dir).where("kind = 'admission'").select(
        "patient_id", "event_id", F.col("date").alias("admitted_date"),
        F.when(eid % 10 != 0, F.date_add("date", (eid % 20 + 1).cast("int"))).alias("discharged_date"),
        (eid % 4 == 0).alias("infectious"),
    )


def doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered treatment days from the index date on; two brands on one day make a duplicate."""
    days = (
        events(spark, sf_dir)
        .where(F.col("kind").isin("pfizer", "az") & (F.col("date") >= "1997-01-01"))
        .groupBy("patient_id", "date")
        .agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    )
    return days.select(
        "patient_id", "date",
        F.when(F.col("lo") != F.col("hi"), "duplicate").otherwise(F.col("lo")).alias("type"),
        F.row_number().over(W.partitionBy("patient_id").orderBy("date")).cast("long").alias("dose"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timestamped event log, one row per event of a user."""
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("patient_id"), "ts", F.to_date("ts").alias("date"),
        "event_type", "value",
    )


# The same mapping as portable SQL, used as common table expressions of the check queries.
SQL = {
    "person": """
 SELECT CAST(c_custkey+1 AS BIGINT) AS patient_id, CAST(66+(c_custkey*7)%30 AS INT) AS age,
 CASE WHEN c_custkey%97=0 THEN NULL WHEN c_custkey%2=0 THEN 'F' ELSE 'M' END AS sex, r_name AS region, c_mktsegment AS segment,
 CASE WHEN c_custkey%53=0 THEN NULL ELSE CAST((c_custkey*311)%32844 AS INT) END AS imd,
 CASE WHEN c_custkey%7<5 THEN CAST(c_custkey%7+1 AS STRING) END AS ethnicity,
 CASE WHEN c_custkey%6<5 THEN CAST(c_custkey%6+1 AS STRING) END AS ethnicity_6_sus,
 c_custkey%11=0 AS sev_obesity, c_custkey%13=0 AS chronic_heart_disease, c_custkey%17=0 AS chronic_kidney_disease,
 c_custkey%19=0 AS diabetes, c_custkey%23=0 AS chronic_liver_disease, c_custkey%29=0 AS chronic_resp_disease,
 c_custkey%31=0 AS chronic_neuro_disease, c_custkey%37=0 AS immunosuppressed, c_custkey%41=0 AS learndis,
 c_custkey%43=0 AS sev_mental, c_custkey%3=0 AS flu_vaccine, c_custkey%47=0 AS cev, c_custkey%59=0 AS hscworker,
 c_custkey%61=0 AS care_home, c_custkey%67=0 AS endoflife, c_custkey%71=0 AS housebound, c_custkey%101<>0 AS has_follow_up_previous_year
 FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "ev": """
 SELECT CAST(o_custkey+1 AS BIGINT) AS patient_id, CAST(o_orderdate AS DATE) AS date, o_orderkey AS event_id, o_totalprice AS value,
 CASE WHEN o_orderpriority='1-URGENT' THEN 'pfizer' WHEN o_orderpriority='2-HIGH' THEN 'az' WHEN o_orderpriority='3-MEDIUM' THEN 'admission'
  WHEN o_orderpriority='4-NOT SPECIFIED' AND o_orderstatus='F' THEN 'postest' WHEN o_orderpriority='4-NOT SPECIFIED' THEN 'test'
  WHEN o_totalprice>400000 THEN 'death' WHEN o_totalprice<20000 THEN 'dereg' ELSE 'other' END AS kind FROM orders""",
    "spell": """
 SELECT patient_id, event_id, date AS admitted_date,
 CASE WHEN event_id%10=0 THEN NULL ELSE date + CAST(event_id%20+1 AS INT) END AS discharged_date, event_id%4=0 AS infectious
 FROM ev WHERE kind='admission'""",
    "dose": """
 SELECT patient_id, date, CASE WHEN count(DISTINCT kind)>1 THEN 'duplicate' ELSE min(kind) END AS type,
 CAST(row_number() OVER (PARTITION BY patient_id ORDER BY date) AS BIGINT) AS dose
 FROM ev WHERE kind IN ('pfizer','az') AND date >= DATE '1997-01-01' GROUP BY patient_id, date""",
    "act": """
 SELECT event_id, user_id AS patient_id, ts, CAST(ts AS DATE) AS date, event_type, value FROM events""",
}


def with_sql(*names: str, **extra: str) -> str:
    """A WITH clause holding the named fixture tables (and those they need) and further ones."""
    need = [n for n in SQL if n in names or (n == "ev" and {"spell", "dose"} & set(names))]
    parts = [f"{n} AS ({SQL[n]})" for n in need] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"
