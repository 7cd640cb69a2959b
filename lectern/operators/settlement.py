"""Labour settlement over an employment table, in decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINIMUM_WAGE, TRANSPORT = 1_500_000, 180_000


def labour_settlement(employment: DataFrame) -> DataFrame:
    """Days by the 30/360 count, and the amounts owed at the end of each contract."""
    s, e = F.col("start_date"), F.col("end_date")
    money = lambda c: F.round(c, 2).cast("decimal(18,2)")
    dec = lambda c: c.cast("decimal(18,6)")
    days = F.greatest(F.lit(1), (F.year(e) - F.year(s)) * 360 + (F.month(e) - F.month(s)) * 30 + (F.dayofmonth(e) - F.dayofmonth(s)) + 1)
    salary = F.col("base_salary").cast("decimal(18,2)")
    df = employment.select("emp_id", "reason", "contract_type", "vacation_days_taken", salary.alias("salary"), days.alias("days"), F.when(F.col("transport") & (salary <= 2 * MINIMUM_WAGE), F.lit(TRANSPORT)).otherwise(F.lit(0)).cast("decimal(18,2)").alias("transport_allowance"), F.least(F.lit(360), (F.month(e) - 1) * 30 + F.dayofmonth(e)).alias("year_days"), ((F.month(e) - 1) % 6 * 30 + F.dayofmonth(e)).alias("half_days"))
    df = df.withColumn("base", F.col("salary") + F.col("transport_allowance"))
    df = df.withColumn("severance", money(F.col("base") * F.col("year_days") / 360)).withColumn("bonus", money(F.col("base") * F.col("half_days") / 360))
    df = df.withColumn("interest", money(F.col("severance") * F.col("year_days") * F.lit("0.12").cast("decimal(4,2)") / 360))
    pending = F.greatest(F.lit(0).cast("decimal(18,6)"), dec(F.col("days").cast("decimal(10,0)") * 15 / 360) - F.col("vacation_days_taken"))
    df = df.withColumn("vacation", money(F.col("salary") * pending / 30))
    more = dec(F.greatest(F.lit(0), F.col("days") - 360).cast("decimal(10,0)") / 360)
    low = F.col("salary") < 10 * MINIMUM_WAGE
    owed = F.when(low, 30 + more * 20).otherwise(20 + more * 15)
    indemnity = F.when(F.col("reason") != "SIN_JUSTA_CAUSA", F.lit(0)).when(F.col("contract_type") == "INDEFINIDO", F.col("salary") * dec(owed) / 30).when(F.col("contract_type") == "FIJO", F.col("salary") * 3).otherwise(F.lit(0))
    df = df.withColumn("indemnity", money(F.coalesce(indemnity, F.lit(0))))
    total = F.col("severance") + F.col("interest") + F.col("bonus") + F.col("vacation") + F.col("indemnity")
    return df.select("emp_id", "days", "transport_allowance", "severance", "interest", "bonus", "vacation", "indemnity", money(total).alias("total"))
