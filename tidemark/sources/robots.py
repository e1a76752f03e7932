"""robots.txt: rules of all hosts as one table, and which addresses they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _applicable(policies: DataFrame, agent: str) -> DataFrame:
    """policies: host, text. The lines (host, grp, pos, key, value) of the groups that hold for the agent: those that name it, else `*`.

    A group is a run of user-agent lines and what follows them; what stands before the first one says nothing.
    """
    lines = policies.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.select("host", "pos", F.regexp_extract(line, r"^([^:]*):(.*)$", 1).alias("k"), F.regexp_extract(line, r"^([^:]*):(.*)$", 2).alias("v"))
    lines = lines.select("host", "pos", F.lower(F.trim("k")).alias("key"), F.trim("v").alias("value"))
    delay = F.col("value").rlike(r"^\+?(\d+|\.\d)")
    lines = lines.where(F.col("key").isin("user-agent", "allow", "disallow") | ((F.col("key") == "crawl-delay") & delay))
    w = Window.partitionBy("host").orderBy("pos")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    lines = lines.withColumn("_s", starts.cast("int")).withColumn("grp", F.sum("_s").over(w)).where("grp > 0").drop("_s")
    name = agent.lower().split("/")[0]
    is_agent = F.col("key") == "user-agent"
    own = is_agent & (F.col("value") != "*") & F.lit(name).contains(F.lower("value"))
    by_group, by_host = Window.partitionBy("host", "grp"), Window.partitionBy("host")
    lines = lines.withColumns({"_own": F.max(own).over(by_group), "_any": F.max(is_agent & (F.col("value") == "*")).over(by_group)})
    lines = lines.withColumn("_named", F.max("_own").over(by_host))
    return lines.where(F.when(F.col("_named"), F.col("_own")).otherwise(F.col("_any"))).select("host", "grp", "pos", "key", "value")


def _pattern(path: Column) -> Column:
    """A rule's path as a regular expression: `*` is anything, a `$` at the end is the end."""
    out = F.regexp_replace(path, r"([.+?^${}()|\[\]\\])", r"\\$1")
    out = F.regexp_replace(out, r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(out, r"\\\$$", r"\$"))


def allowed(urls: DataFrame, policies: DataFrame, agent: str) -> DataFrame:
    """urls with a column `allowed`. The longest rule that matches decides, allow wins ties; without policy or match: allowed.

    A host's rules become one array on one row, so an address meets its host once and no row is multiplied.
    """
    rules = _applicable(policies.where("text IS NOT NULL"), agent).where("key <> 'user-agent' AND key <> 'crawl-delay' AND value <> ''")
    rules = rules.groupBy("host").agg(F.collect_list(F.struct(F.length("value").alias("n"), (F.col("key") == "allow").alias("ok"), _pattern(F.col("value")).alias("p"))).alias("_rules"))
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1)
    rows = urls.withColumns({"_host": host, "_path": F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))})
    rows = rows.join(rules.withColumnRenamed("host", "_host"), "_host", "left")
    best = F.array_max(F.transform(F.filter("_rules", lambda r: F.rlike(F.col("_path"), r.p)), lambda r: F.struct(r.n.alias("n"), r.ok.alias("ok"))))
    return rows.withColumn("allowed", F.coalesce(best.ok, F.lit(True))).drop("_host", "_path", "_rules")


def crawl_delay_ms(policies: DataFrame, agent: str) -> DataFrame:
    """(host, delay_ms): the longest delay that holds for the agent, 0 without one."""
    number = F.regexp_extract("value", r"^\+?(\d+\.?\d*|\.\d+)", 1).cast("double")
    last = F.max_by(number, "pos")
    found = _applicable(policies.where("text IS NOT NULL"), agent).where("key = 'crawl-delay'").groupBy("host", "grp").agg(last.alias("d"))
    found = found.groupBy("host").agg(F.max("d").alias("d"))
    return policies.select("host").distinct().join(found, "host", "left").select("host", (F.coalesce("d", F.lit(0.0)) * 1000).alias("delay_ms"))


def deactivates_missing(complete: Column, incomplete: Column, reached_end: Column, queue_empty: Column) -> Column:
    """A crawl may switch off what it didn't see only if it covers all, left nothing out and came to an end."""
    return F.coalesce(complete & ~incomplete & (reached_end | queue_empty), F.lit(False))
