"""Queries over ordered events and pages: extras of the platform."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.plans.registry import query
from stratalex.sources.readers import clean_transliteration
from stratalex.sources.tables import table
from stratalex.streaming import events as ev

r6 = lambda c: F.round(c, 6)


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    w = ev.tumbling(table(spark, sf, "events"))
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH x AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS events FROM s GROUP BY 1""")
def event_sessions(spark, sf):
    s = ev.sessions(table(spark, sf, "events"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


@query("""WITH x AS (SELECT user_id, event_type AS e1, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e2 FROM events), n AS (SELECT e1, e2, count(*) AS c FROM x WHERE e2 IS NOT NULL GROUP BY 1, 2)
SELECT e1, e2, c, round(c * 1.0 / sum(c) OVER (PARTITION BY e1), 6) AS p FROM n""")
def event_transitions(spark, sf):
    x = table(spark, sf, "events").withColumn("e2", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    n = x.where("e2 is not null").groupBy(F.col("event_type").alias("e1"), "e2").agg(F.count(F.lit(1)).alias("c"))
    return n.withColumn("p", r6(F.col("c") / F.sum("c").over(Window.partitionBy("e1"))))


def _clean_sql(x):
    for rx, to in ((r"<![^>]*>", ""), ("<->", " "), ("<~>", " "), (r"<\$>", ""), ("[-=]+$", ""), (r"\[([^:\]]*?):[^\]]*?\]", r"\1"), (r"\[([^\]]*?)\]", r"\1"), (r"\{([^}]*)\}", r"\1")):
        x = f"regexp_replace({x}, '{rx}', '{to}', 'g')"
    x = f"lower({x})"
    for rx, to in ((r"\.", " "), ("[*?,'']", ""), (r"@\d+;?", ""), (r"\s+", " "), ("[^a-z ]", "")):
        x = f"regexp_replace({x}, '{rx}', '{to}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages) SELECT page_id, count(*) AS lines, CAST(sum(length({_clean_sql('line')})) AS BIGINT) AS chars, md5(max({_clean_sql('line')})) AS last_md5 FROM l GROUP BY 1")
def markup_cleaning(spark, sf):
    l = table(spark, sf, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("line")).select("page_id", clean_transliteration(F.col("line")).alias("t"))
    return l.groupBy("page_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("t")).alias("chars"), F.md5(F.max("t")).alias("last_md5"))
