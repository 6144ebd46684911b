"""Sources by channel: their registrations as a table, and all rules run over messages that are routed once."""

from __future__ import annotations

import importlib
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions.contacts import clean_link, links_of
from ..schemas import DEAD_LETTERS, RAW_JOB, REGISTRATION
from .dedup import scratch_dir, spread

RAW_COLUMNS = [x.split()[0] for x in RAW_JOB.split(", ")]
#: Parts that a failed rule's messages are tried in, and how often a failed part is parted again.
PARTS, DEPTH = 16, 2


def raw_passthrough(messages: DataFrame) -> DataFrame:
    """Posts that no rule knows, under the title raw_post, with the links of the message; empty ones go."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    null = F.lit(None).cast("string")
    kept = messages.where(F.coalesce(text, F.lit("")) != "")
    # what was exported and is no link stays as it is
    odd = F.filter(F.transform("contact_links", lambda x: F.trim(x)), lambda x: (x != "") & clean_link(x).isNull())
    links = F.array_distinct(F.concat(F.coalesce(odd, F.array().cast("array<string>")), links_of(kept)))
    return kept.select(F.lit("raw_post").alias("title"), null.alias("company"), text.alias("description"), null.alias("salary"), null.alias("location"), "source", "url", F.coalesce("date", F.current_timestamp()).alias("posted_at"), links.alias("contact_links"))


def read_registrations(spark: SparkSession, path: str) -> DataFrame:
    """(plugin_name, channel, source, enabled, rule) of the files <path>/<plugin>/config.yaml: one scan of small texts.

    A file holds lines "name: value"; a value may be quoted, and a comment may follow it. Without a source the channel is
    taken, without a rule posts pass as they are. A file without a channel has a null one. Folders whose names begin with
    two underscores are left out. No files give no rows; a path that is not there is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    schema = f"{REGISTRATION}, rule STRING"
    try:
        files = spark.read.text(f"{path}/*/config.yaml", wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    value = lambda name: F.nullif(F.regexp_extract("value", rf"(?m)^{name}[ \t]*:[ \t]*[\"']?([^\"'#\r\n]*?)[\"']?[ \t]*(?:#.*)?\r?$", 1), F.lit(""))
    name = F.regexp_extract(F.url_decode("_metadata.file_path"), r"([^/]+)/config\.yaml$", 1)
    enabled = ~F.lower(F.coalesce(value("enabled"), F.lit("true"))).isin("false", "no", "off", "0")
    rows = files.select(name.alias("plugin_name"), value("channel").alias("channel"), F.coalesce(value("source"), value("channel")).alias("source"), enabled.alias("enabled"), value("rule").alias("rule"))
    return rows.where(~F.col("plugin_name").startswith("__"))


class Registry:
    """Sources by channel: rows of (plugin_name, channel, source, enabled) and the rule of each source.

    A rule takes a DataFrame of messages and returns raw jobs. The first registration of a channel wins, in order of
    plugin name; disabled ones are left out; a source without a rule passes its posts on as they are."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.rules: dict = {}
        #: (plugin_name, outcome, reason) of registrations that were read from files.
        self.outcomes: list[tuple] = []

    def register(self, plugin_name: str, channel: str, source: str | None = None, rule=None, enabled: bool = True) -> None:
        self.rows.append((plugin_name, channel, source or plugin_name, enabled))
        if rule:
            self.rules[source or plugin_name] = rule

    @classmethod
    def discovered(cls, spark: SparkSession, path: str, rules: dict | None = None) -> Registry:
        """The registry of the files below ``path`` (``read_registrations``; one row a source comes to the driver).

        A rule is named in its file as "module:name", or found in ``rules`` by plugin name. A file without a channel, or
        whose rule cannot be loaded, is broken: it is left out, does not take its channel, and the others load."""
        out = cls()
        for row in read_registrations(spark, path).orderBy("plugin_name").collect():
            outcome, reason, rule = "loaded", None, (rules or {}).get(row.plugin_name)
            if not row.enabled:
                outcome = "disabled"
            elif row.channel is None:
                outcome, reason = "broken", "no channel"
            else:
                try:
                    if row.rule:
                        module, _, name = row.rule.partition(":")
                        rule = getattr(importlib.import_module(module), name)
                    if rule is not None and not callable(rule):
                        raise TypeError(f"{row.rule} is no rule")
                except Exception as e:  # whatever a rule's module raises costs this source alone
                    outcome, reason = "broken", f"{type(e).__name__}: {e}"
            if outcome == "loaded" and any(x[1] == row.channel for x in out.rows):
                outcome, reason = "duplicate channel", row.channel
            if outcome == "loaded":
                out.register(row.plugin_name, row.channel, row.source, rule)
            out.outcomes.append((row.plugin_name, outcome, reason))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        seen: dict[str, tuple] = {}
        for row in sorted(x for x in self.rows if x[3] and not x[0].startswith("__")):
            seen.setdefault(row[1], row)
        return spark.createDataFrame(list(seen.values()), REGISTRATION)

    def dispatch(self, messages: DataFrame, threads: int = 4) -> tuple[DataFrame, DataFrame]:
        """(raw jobs, dead letters) of the messages of registered channels.

        Messages are read once: they are joined with the registry (a few rows, broadcast), dealt over all cores and written to
        one folder for each rule; a rule reads its folder alone, and its result is written. What a rule raises, on the driver or
        in a task, costs its own messages: they are tried again in PARTS parts by hash, failed parts once more in as many, and what
        still fails goes to the dead letters with the error, unless every part fails, as then the rule is broken."""
        spark = messages.sparkSession
        base = f"{scratch_dir(spark)}/routed-{uuid.uuid4().hex}"
        routes = {source: i for i, source in enumerate(sorted(self.rules))}
        route = F.lit(-1)
        for source, i in routes.items():
            route = F.when(F.col("source") == source, i).otherwise(route)
        joined = messages.join(F.broadcast(self.table(spark)), "channel").withColumn("route", route)
        joined = spread(joined)
        joined.write.partitionBy("route").parquet(f"{base}/messages")
        routed = spark.read.schema(joined.schema).parquet(f"{base}/messages")
        part_of = lambda depth: F.pmod(F.xxhash64(F.lit(depth), "channel", "id", "url"), F.lit(PARTS))

        def tried(rule, rows: DataFrame, path: str) -> str | None:
            try:
                rule(rows).select(*RAW_COLUMNS).write.mode("overwrite").parquet(path)
                return None
            except Exception as e:
                lines = str(e).strip().splitlines()
                return f"{type(e).__name__}: {lines[0] if lines else ''}"[:300]

        def run(rule, rows: DataFrame, path: str, depth: int = 0, error: str | None = None) -> list[tuple[DataFrame, str]]:
            """Runs a rule, or parts what is known to fail; what cannot be done, with its error. Results lie below ``path``."""
            error = error or tried(rule, rows, f"{path}/out")
            if error is None:
                return []
            if depth == DEPTH:
                return [(rows, error)]
            failed, there = [], [r.part for r in rows.select(part_of(depth).alias("part")).distinct().collect()]
            for i in sorted(there):
                part = rows.where(part_of(depth) == i)
                if e := tried(rule, part, f"{path}/{depth}-{i}/out"):
                    failed.append((i, part, e))
            if len(failed) == len(there):
                return [(rows, error)]
            return [x for i, part, e in failed for x in run(rule, part, f"{path}/{depth}-{i}", depth + 1, e)]

        jobs = [(raw_passthrough, -1, "raw"), *((self.rules[source], i, i) for source, i in routes.items())]
        with ThreadPoolExecutor(threads) as pool:
            failures = [x for found in pool.map(lambda x: run(x[0], routed.where(F.col("route") == x[1]), f"{base}/jobs/{x[2]}"), jobs) for x in found]
        raw = spark.read.schema(RAW_JOB).option("recursiveFileLookup", True).parquet(f"{base}/jobs")
        dead = spark.createDataFrame([], DEAD_LETTERS)
        for rows, error in failures:
            dead = dead.unionByName(rows.select("plugin_name", "channel", F.col("id").cast("long").alias("id"), "url", F.lit(error).alias("error")))
        return raw, dead

    def ingest(self, messages: DataFrame) -> DataFrame:
        """The raw jobs of ``dispatch``."""
        return self.dispatch(messages)[0]


def outcomes_table(spark: SparkSession, registry: Registry) -> DataFrame:
    return spark.createDataFrame(registry.outcomes, _parse_datatype_string("plugin_name STRING, outcome STRING, reason STRING"))
